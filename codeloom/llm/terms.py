"""Problem 3: how often every value, term or n-gram occurs, and in how many records.

Suffix-sorted counting: every record's suffixes, cut to ``sigma`` terms, are routed by their first term, sorted in
reverse lexicographic order, and one pass with a stack adds up the counts of all prefixes.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE_RECORDS = 2
COMMON_SHARE = 5  # common: in at least one of so many records
#: Marks that subword tokenizers put before a piece.
MARKERS = "Ġ▁"
#: Suffixes of one first term go to so many parts, so a hot first term is split: by the second term, so that longer
#: n-grams are counted whole in one part, or, where suffixes have one term, by the batch they come from.
SPREAD = 16


def terms_of(tokens) -> list[str]:
    """Terms of one record in order; none for null."""
    out = []
    for token in tokens if tokens is not None else ():
        if token:
            if token.isascii():
                out += token.lower().split()
            else:
                pieces = (p.lstrip(MARKERS) for p in unicodedata.normalize("NFC", token).split())
                out += [unicodedata.normalize("NFC", p.lower()) for p in pieces if p]
    return out


def ngram_counts(records: DataFrame, tokens: str, sigma: int = 1) -> DataFrame:
    """``gram ARRAY<STRING>, occurrences, records`` of every run of 1 to ``sigma`` terms; each row of ``records`` is a record.

    Null and empty token arrays have no terms; an empty table gives an empty result. A suffix carries, for each of its
    prefixes, whether that is the prefix's first occurrence in its record, so record sets add up as numbers, are summed
    within each batch before the shuffle, and no set of records is ever held. Only one-term prefixes are spread over
    several parts; a last sum brings them together.
    """

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, batch in enumerate(batches):
            total: Counter = Counter()
            firsts: dict = {}
            for row in batch[tokens]:
                terms, seen = terms_of(row), set()
                for i in range(len(terms)):
                    cut = tuple(terms[i : i + sigma])
                    total[cut] += 1
                    have = firsts.get(cut)
                    if have is None:
                        have = firsts[cut] = [0] * len(cut)
                    for k in range(len(cut)):
                        if (g := cut[: k + 1]) not in seen:
                            seen.add(g)
                            have[k] += 1
            yield pd.DataFrame({"suffix": [list(s) for s in total], "n": list(total.values()), "firsts": [firsts[s] for s in total], "part": number})

    def stacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list] = []  # [term, occurrences, records]

        def pop(to: int, out: list) -> None:
            while len(stack) > to:
                out.append(([x[0] for x in stack], stack[-1][1], stack[-1][2]))
                n = stack.pop()[1]
                if stack:
                    stack[-1][1] += n

        for batch in batches:
            out: list = []
            for suffix, n, firsts in zip(batch["suffix"], batch["n"], batch["firsts"], strict=True):
                same = 0
                while same < len(stack) and same < len(suffix) and stack[same][0] == suffix[same]:
                    same += 1
                pop(same, out)
                stack.extend([t, 0, 0] for t in suffix[same:])
                stack[-1][1] += int(n)
                for k, f in enumerate(firsts):
                    stack[k][2] += int(f)
            yield pd.DataFrame(out, columns=["gram", "occurrences", "records"])
        out = []
        pop(0, out)
        yield pd.DataFrame(out, columns=["gram", "occurrences", "records"])

    # a suffix that ends after its first term goes by its batch too: only one-term counts, which are summed at the end, spread
    second = F.when(F.size("suffix") > 1, F.xxhash64(F.try_element_at("suffix", F.lit(2)))).otherwise(F.xxhash64(F.spark_partition_id(), "part"))
    routed = (
        records.select(tokens)
        .mapInPandas(suffixes, "suffix array<string>, n long, firsts array<long>, part int")
        .select("suffix", "n", "firsts", F.element_at("suffix", 1).alias("first"), F.pmod(second, F.lit(SPREAD)).alias("second"))
        .repartition("first", "second")
        .sortWithinPartitions(F.col("suffix").desc())
    )
    parts = routed.mapInPandas(stacked, "gram array<string>, occurrences long, records long")
    return parts.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def ngram_marks(records: DataFrame, key: str, tokens: str, sigma: int) -> DataFrame:
    """``gram STRING, occurrences, records, mark`` of every run of 1 to ``sigma`` terms, joined by blanks; rows with one ``key`` are one record, ``mark`` is rare, common or null."""
    once = records.select(F.col(key).alias("_key"), F.col(tokens).alias("_tokens")).groupBy("_key").agg(F.max("_tokens").alias("_tokens"))
    total = records.agg(F.count_distinct(F.coalesce(F.col(key).cast("string"), F.lit("")))).first()[0]
    return ngram_counts(once, "_tokens", sigma).select(F.array_join("gram", " ").alias("gram"), "occurrences", "records", mark(F.col("records"), total).alias("mark"))


def term_marks(records: DataFrame, key: str, tokens: str) -> DataFrame:
    """``term, occurrences, records, mark`` of every term."""
    return ngram_marks(records, key, tokens, 1).withColumnRenamed("gram", "term")


def mark(records: Column, total: int) -> Column:
    return F.when(records <= RARE_RECORDS, "rare").when(records * COMMON_SHARE >= total, "common")
