"""Problem 6: records that are the same but for white space, letter case, punctuation or field order."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.joins import join_unique
from codeloom.llm.words import LEAST_WORDS, Folder, mix, same_words
from codeloom.session import cut

#: A keeper's text is repeated once per so many of its copies, so that no task gets all of a large group.
COPIES_PER_TASK = 20_000
_U = np.uint64


def _refuse(_: str):
    raise ValueError


def fields(payload: str | None) -> dict | None:
    """The fields of a valid JSON object, else null."""
    try:
        got = json.loads(payload, parse_int=Decimal, parse_float=Decimal, parse_constant=_refuse)
    except (ValueError, TypeError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _plain(value) -> str:
    """Numbers by value; anything else that is no string by its sorted JSON."""
    if isinstance(value, Decimal):
        return "n" + str(value.normalize() + 0 if value else Decimal(0))
    return "j" + json.dumps(value, sort_keys=True, default=str)


def same_fields(a: str, b: str) -> bool:
    x, y = fields(a), fields(b)
    if x is None or y is None or x.keys() != y.keys():
        return False
    return all(same_words(v, w) if isinstance(v, str) and isinstance(w, str) else isinstance(v, str) == isinstance(w, str) and _plain(v) == _plain(w) for v, w in ((v, y[k]) for k, v in x.items()))


def fingerprints(texts: DataFrame) -> DataFrame:
    """``src, key, h1, h2`` of each row of ``src, key, text`` with at least LEAST_WORDS words (a payload: in its ``func``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder()
        for batch in batches:
            batch = batch[batch["text"].notna()]
            json_rows = batch["src"] == "raw_records"
            code = batch[~json_rows]
            h1, h2, n = folder.hashes(code["text"].tolist())
            enough = n >= LEAST_WORDS
            yield pd.DataFrame({"src": code["src"][enough], "key": code["key"][enough], "h1": h1[enough].view(np.int64), "h2": h2[enough].view(np.int64)})
            if json_rows.any():
                keys, owner, names, strings, func = [], [], [], [], []
                sums = []
                for key, payload in zip(batch["key"][json_rows], batch["text"][json_rows], strict=True):
                    got = fields(payload)
                    if got is None or not isinstance(got.get("func"), str):
                        continue
                    add = [0, 0]
                    for name, value in got.items():
                        tag = xxhash.xxh64_intdigest(name)
                        if isinstance(value, str):
                            owner.append(len(keys))
                            names.append(tag)
                            func.append(name == "func")
                            strings.append(value)
                        else:
                            rest = _plain(value)
                            for i in (0, 1):
                                add[i] += xxhash.xxh64_intdigest(rest, tag ^ (i + 7) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                    keys.append(key)
                    sums.append([x & (1 << 64) - 1 for x in add])
                h1, h2, n = folder.hashes(strings)
                total = np.array(sums, _U).reshape(-1, 2)
                tag, owner = np.array(names, _U), np.array(owner, np.int64)
                for i, h in enumerate((h1, h2)):
                    np.add.at(total[:, i], owner, mix(h + mix(tag + _U(i))))
                words = np.zeros(len(keys), np.int64)
                np.add.at(words, owner, np.where(np.array(func, bool), n, 0))
                enough = words >= LEAST_WORDS
                yield pd.DataFrame({"src": "raw_records", "key": np.array(keys, np.int64)[enough], "h1": total[enough, 0].view(np.int64), "h2": total[enough, 1].view(np.int64)})

    return texts.select("src", F.col("key").cast("long").alias("key"), "text").where("key is not null").mapInPandas(run, "src string, key long, h1 long, h2 long")


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [(same_fields if s == "raw_records" else same_words)(x, y) for s, x, y in zip(b["src"], b["keep_text"], b["text"], strict=True)]
        yield b[["src", "keep_key", "copy_key"]].assign(ok=ok)


def _checked(grouped: DataFrame) -> DataFrame:
    """``src, keep_key, copy_key, ok`` of ``src, key, keep_key, salts, text``: every other record of a group against its keeper, whose text goes to ``salts`` places."""
    keeper = grouped.where("key = keep_key").select(F.col("src").alias("s"), F.col("key").alias("k"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("keep_text"))
    pairs = grouped.where("key <> keep_key").withColumn("_salt", F.pmod(F.xxhash64("key"), F.col("salts").cast("long")).cast("int"))
    pairs = pairs.join(keeper, (F.col("src") == F.col("s")) & (F.col("keep_key") == F.col("k")) & (F.col("_salt") == F.col("salt"))).select("src", "keep_key", F.col("key").alias("copy_key"), "keep_text", "text")
    return cut(pairs.mapInPandas(_compare, "src string, keep_key long, copy_key long, ok boolean"))


def copies(texts: DataFrame) -> DataFrame:
    """``src, keep_key, copy_key``: each copy with the smallest key of its group.

    Rows with one key are one record. Null and short texts and payloads that are no JSON object are in no group. Every
    copy's text is compared with its keeper's; where the hashes lied, the records that differ from the keeper, among which all
    their own copies are, get the smallest of them as keeper and are compared again, until none is left.
    """
    prints = cut(fingerprints(texts).groupBy("src", "key").agg(F.min(F.struct("h1", "h2")).alias("h")).select("src", "key", F.concat_ws(":", "src", "h.h1", "h.h2").alias("h")))
    group = prints.groupBy("h").agg(F.min("key").alias("keep_key"), F.count("*").alias("n")).where("n > 1")
    group = group.withColumn("salts", F.ceil(F.col("n") / COPIES_PER_TASK).cast("int"))
    member = cut(join_unique(prints, group, "h", "n", F.col("key")).where("keep_key is not null").select("src", "key", "keep_key", "salts"))
    text = texts.select(F.col("src").alias("s"), F.col("key").cast("long").alias("k"), "text").where("text is not null")
    grouped = cut(member.join(text, (F.col("src") == F.col("s")) & (F.col("key") == F.col("k"))).groupBy("src", "key", "keep_key", "salts").agg(F.min("text").alias("text")))
    good = None
    while True:
        checked = _checked(grouped)
        same = checked.where("ok").select("src", "keep_key", "copy_key")
        good = same if good is None else good.union(same)
        lied = checked.where("not ok")
        if lied.isEmpty():
            return good
        new = lied.groupBy("src", F.col("keep_key").alias("old")).agg(F.min("copy_key").alias("keep_key"), F.ceil(F.count("*") / COPIES_PER_TASK).cast("int").alias("salts"))
        left = lied.select("src", F.col("keep_key").alias("old"), F.col("copy_key").alias("key")).join(new, ["src", "old"]).select("src", "key", "keep_key", "salts")
        grouped = cut(grouped.select("src", "key", "text").join(left, ["src", "key"]).select("src", "key", "keep_key", "salts", "text"))


def collapsed(texts: DataFrame) -> DataFrame:
    """``src, keep_key, copies``: one row for each record that stays (short or invalid ones too), with its number of copies, itself included."""
    pairs = cut(copies(texts))
    every = texts.select("src", F.col("key").cast("long").alias("key")).where("key is not null").distinct()
    kept = every.join(pairs.select("src", F.col("copy_key").alias("key")), ["src", "key"], "left_anti")
    counts = pairs.groupBy("src", F.col("keep_key").alias("key")).agg(F.count("*").alias("c"))
    return kept.join(counts, ["src", "key"], "left").select("src", F.col("key").alias("keep_key"), (F.coalesce("c", F.lit(0)) + 1).alias("copies"))
