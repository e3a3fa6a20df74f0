"""The BLEU family and token overlap: n-grams are counted and clipped within a pair's row, so nothing but sums is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

ORDER = 4


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a blank."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list array, and the row of each."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    return np.asarray(lists.flatten()).astype(np.int64).view(_U), np.repeat(np.arange(len(lists)), sizes)


def _counted(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of n values within rows as hashes that hold the row, how often each comes up, and its row."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = values[:m]
    for i in range(1, n):
        run = _mix(run * _U(0x9E3779B97F4A7C15) + values[i : i + m])
    whole = row[:m] == row[n - 1 :]
    own = row[:m][whole]
    key, first, count = np.unique(_mix(run[whole] ^ _mix(own.astype(_U) + _U(1))), return_index=True, return_counts=True)
    return key, count, own[first]


@arrow_udf(ArrayType(IntegerType()))
def clipped_in_row(hypothesis: pa.Array, references: pa.Array, order: pa.Array) -> pa.Array:
    """Of arrays of token hashes: clipped matches of 1 to ``order`` tokens, against the most that any reference has, and the closest reference's length (the shorter of two)."""
    rows, most = len(hypothesis), order[0].as_py() if len(order) else 0
    values, row = _flat(hypothesis)
    each = references.flatten()
    of = np.repeat(np.arange(rows), np.asarray(pc.fill_null(pc.list_value_length(references), 0)).astype(np.int64))
    r_values, r_at = _flat(each)
    out = np.zeros((rows, most + 1), np.int32)
    for n in range(1, most + 1):
        key, count, at = _counted(values, row, n)
        # counted within each reference, the largest of a row's references counts
        r_key, r_count, r_each = _counted(r_values, r_at, n)
        if len(r_key) and len(key):
            if len(each) != rows or (of != np.arange(rows)).any():
                r_key, r_count = _of_rows(r_values, r_at, of, n)
            shared, i, j = np.intersect1d(key, r_key, assume_unique=True, return_indices=True)
            out[:, n - 1] = np.bincount(at[i], weights=np.minimum(count[i], r_count[j]), minlength=rows)
    size = np.asarray(pc.fill_null(pc.list_value_length(hypothesis), 0)).astype(np.int64)
    r_size = np.asarray(pc.fill_null(pc.list_value_length(each), 0)).astype(np.int64)
    if len(of):
        order_of = np.lexsort((r_size, np.abs(r_size - size[of]), of))
        first = order_of[np.concatenate([[True], of[order_of][1:] != of[order_of][:-1]])]
        out[of[first], most] = r_size[first]
    return pa.array(list(out), pa.list_(pa.int32()))


def _of_rows(values: np.ndarray, at: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_counted``, with hashes that hold the row of each reference and the largest count of any of its references."""
    number = np.zeros(len(of), np.int64)
    same = np.concatenate([[False], of[1:] == of[:-1]]) if len(of) else np.zeros(0, bool)
    for i in np.flatnonzero(same):
        number[i] = number[i - 1] + 1
    keys, counts = [], []
    for k in range(int(number.max(initial=0)) + 1):
        own = number[at] == k
        key, count, _ = _counted(values[own], of[at[own]], n)
        keys.append(key)
        counts.append(count)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.maximum.reduceat(count, first) if len(first) else count


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def clipped(pairs: DataFrame, key: str, hypothesis: str, reference: str, order: int = ORDER) -> DataFrame:
    """``key, n, matched, total, hyp_len, ref_len``: clipped n-gram matches of each pair, for n of 1 to ``order``.

    ``reference`` is an array of tokens, or an array of such arrays where there are several references. Pairs with a null
    side are left out.
    """
    several = isinstance(pairs.schema[reference].dataType.elementType, ArrayType)
    refs = F.transform(F.col(reference), _hashed) if several else F.array(_hashed(F.col(reference)))
    known = pairs.where(F.col(hypothesis).isNotNull() & F.col(reference).isNotNull())
    row = known.select(key, F.size(hypothesis).alias("hyp_len"), clipped_in_row(_hashed(F.col(hypothesis)), refs, F.lit(order)).alias("c"))
    each = row.select(key, "hyp_len", F.element_at("c", -1).alias("ref_len"), F.posexplode(F.slice("c", 1, order)).alias("p", "matched"))
    return each.select(key, (F.col("p") + 1).alias("n"), F.col("matched").cast("long").alias("matched"), F.greatest(F.col("hyp_len") - F.col("p"), F.lit(0)).alias("total"), "hyp_len", "ref_len")


def corpus_bleu(pairs: DataFrame, key: str, hypothesis: str, reference: str, smooth: bool = False, order: int = ORDER, epsilon: float | None = None) -> DataFrame:
    """One row ``bleu``: geometric mean of clipped precisions times the brevity penalty exp(1 - ref/hyp) for short output.

    ``smooth`` adds one to matches and totals; ``epsilon`` stands for the matches of an order that has none (and a total counts
    at least 1 a pair), but without a match of single tokens the score is 0.
    """
    if epsilon is not None:
        return _epsilon_bleu(clipped(pairs, key, hypothesis, reference, order), order, epsilon)
    by_n = clipped(pairs, key, hypothesis, reference, order).groupBy("n").agg(F.sum("matched").alias("m"), F.sum("total").alias("t"), F.sum("hyp_len").alias("h"), F.sum("ref_len").alias("r"))
    p = (F.col("m") + 1.0) / (F.col("t") + 1.0) if smooth else F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(0.0)
    ratio = F.max("h") / F.nullif(F.max("r"), F.lit(0))
    mean = F.when(F.min(p) > 0, F.exp(F.avg(F.ln(F.when(p > 0, p))))).otherwise(0.0)
    return by_n.agg(F.round(F.coalesce(mean * F.when(ratio > 1, 1.0).otherwise(F.exp(1 - 1 / F.nullif(ratio, F.lit(0)))), F.lit(0.0)), 6).alias("bleu"))


def _epsilon_bleu(rows: DataFrame, order: int, epsilon: float) -> DataFrame:
    by_n = rows.groupBy("n").agg(F.sum("matched").alias("m"), F.sum(F.greatest("total", F.lit(1))).alias("t"), F.sum("hyp_len").alias("h"), F.sum("ref_len").alias("r"))
    p = F.when(F.col("m") == 0, F.lit(epsilon)).otherwise(F.col("m")) / F.col("t")
    ratio = F.max("h") / F.nullif(F.max("r"), F.lit(0))
    penalty = F.when(ratio > 1, 1.0).when(F.max("h") == 0, 0.0).otherwise(F.exp(1 - 1 / ratio))
    some = F.max(F.when(F.col("n") == 1, F.col("m"))) > 0
    return by_n.agg(F.round(F.coalesce(F.when(some, F.exp(F.sum(F.ln(p)) / order) * penalty), F.lit(0.0)), 6).alias("bleu"))


def sentence_bleu(pairs: DataFrame, key: str, hypothesis: str, reference: str, order: int = ORDER) -> DataFrame:
    """``key, bleu``: precisions of n > 1 smoothed by one, brevity penalty with one added to both lengths."""
    rows = clipped(pairs, key, hypothesis, reference, order)
    p = F.when(F.col("n") == 1, F.col("matched") / F.nullif(F.col("total"), F.lit(0))).otherwise((F.col("matched") + 1.0) / (F.col("total") + 1.0))
    mean = F.when(F.min(F.coalesce(p, F.lit(0.0))) > 0, F.exp(F.avg(F.ln(F.when(p > 0, p))))).otherwise(0.0)
    penalty = F.least(F.lit(1.0), F.exp(1 - (F.max("ref_len") + 1.0) / (F.max("hyp_len") + 1.0)))
    return rows.groupBy(key).agg((mean * penalty).alias("bleu"))


def weighted_recall(pairs: DataFrame, key: str, hypothesis: str, reference: str, keywords: list[str], rest: float = 0.2) -> DataFrame:
    """One row ``recall``: clipped unigram recall with weight 1 for keywords and ``rest`` for others."""
    of = lambda c, keep: F.filter(c, lambda t: t.isin(keywords) if keep else ~t.isin(keywords))
    keys = pairs.select(F.col(key), of(F.col(hypothesis), True).alias("h"), of(F.col(reference), True).alias("r"), F.lit(1.0).alias("w"))
    both = keys.unionByName(pairs.select(F.col(key), of(F.col(hypothesis), False).alias("h"), of(F.col(reference), False).alias("r"), F.lit(rest).alias("w")))
    rows = both.where("h is not null and r is not null").select("w", F.size("r").alias("n"), clipped_in_row(_hashed(F.col("h")), F.array(_hashed(F.col("r"))), F.lit(1))[0].alias("m"))
    return rows.agg(F.round(F.sum(F.col("w") * F.col("m")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0.0)), 6).alias("recall"))


def token_scores(hypothesis: Column, reference: Column) -> list[Column]:
    """Set precision, recall and F1 of one pair."""
    both = F.size(F.array_intersect(hypothesis, reference))
    h, r = F.size(F.array_distinct(hypothesis)), F.size(F.array_distinct(reference))
    z = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return [z(both, h).alias("precision"), z(both, r).alias("recall"), z(2 * both, h + r).alias("f1")]


def word_counts(hypothesis: Column, reference: Column) -> list[Column]:
    """Of one pair: tp, fp, fn by tokens of the lists (a token counts as often as it stands), tp_set, fp_set, fn_set by distinct tokens, right (equal at their place) and length of the reference."""
    size = lambda c: F.size(c).cast("long")
    inside = F.filter(hypothesis, lambda t: F.array_contains(reference, t))
    missed = F.filter(reference, lambda t: ~F.array_contains(hypothesis, t))
    right = F.filter(F.arrays_zip(hypothesis.alias("a"), reference.alias("b")), lambda z: z["a"] == z["b"])
    return [
        size(inside).alias("tp"), (size(hypothesis) - size(inside)).alias("fp"), size(missed).alias("fn"),
        size(F.array_intersect(hypothesis, reference)).alias("tp_set"), size(F.array_except(hypothesis, reference)).alias("fp_set"), size(F.array_except(reference, hypothesis)).alias("fn_set"),
        size(right).alias("right"), size(reference).alias("length"),
    ]


def changed_words(before: Column, after: Column, reference: Column) -> list[Column]:
    """Of one pair: places right before, and of these the ones that are wrong after."""
    z = F.arrays_zip(before.alias("o"), after.alias("n"), reference.alias("t"))
    inside = F.slice(z, 1, F.least(F.size(before), F.size(after), F.size(reference)))
    right = F.filter(inside, lambda x: x["o"] == x["t"])
    return [F.size(right).cast("long").alias("right_before"), F.size(F.filter(right, lambda x: x["n"] != x["t"])).cast("long").alias("lost")]


def code_bleu(parts: list[Column], weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)) -> Column:
    """Weighted sum of the four components."""
    total = F.lit(0.0)
    for w, p in zip(weights, parts, strict=True):
        total = total + w * p
    return total
