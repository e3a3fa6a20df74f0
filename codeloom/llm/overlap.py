"""Problem 5: records of evaluation splits that are also, exactly or almost, in the training split.

The word n-grams of the evaluation records are partitioned by hash; training is scanned for hits. Of an evaluation
record's n-grams only as many are posted as must hold one that a similar training record has among its own posted ones
(frequent n-grams last), so no candidate is lost; the containment of every candidate is then computed on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.near import LISTED, MEET, SIZE_AT, Match, Similarity, frequent_shingles, known, listed, meet, met_deeper, once_a_task, parts_for, record_sets, sequences, singles, sizes_fit, text_batches, unpack
from codeloom.session import cut

_U = np.uint64
TRAIN, HELD_OUT = "train", ("valid", "test")


def split_name(c: Column) -> Column:
    """train, valid or test of an uneven spelling, else null."""
    name = F.regexp_replace(F.lower(c), r"[^a-z]", "")
    return F.when(name.isin("train", "training"), "train").when(name.isin("valid", "validation", "val", "dev", "development"), "valid").when(name.isin("test", "testing"), "test")


def memberships(split_index: DataFrame, functions: DataFrame, cs: DataFrame) -> DataFrame:
    """``src, key, split``, distinct: the splits each record is in; a function can be in two."""
    listed = split_index.select(split_name(F.col("split_name")).alias("split"), F.expr("try_cast(trim(value) as int)").alias("pos"))
    listed = listed.where("split is not null and pos is not null").distinct()
    own = listed.join(functions.select("pos").where("pos is not null").distinct(), "pos").select(F.lit("functions_raw").alias("src"), F.col("pos").cast("long").alias("key"), "split")
    other = cs.select(F.lit("cs").alias("src"), F.col("idx").alias("key"), split_name(F.col("split_name")).alias("split")).where("split is not null and key is not null").distinct()
    return own.union(other)


#: Candidates must share so many posted n-grams; each record posts as many more.
SHARED = 4


def held_and_train(sim: Similarity) -> Match:
    """Pairs of an evaluation (a) and a training record (b) whose sizes fit; they must share SHARED n-grams, small ones all that they must."""

    def match(h: np.ndarray, g: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        out = []
        for a, b, p, q in ((h, g, x, y), (g, h, y, x)):
            ok = np.flatnonzero((p & _U(1) != 0) & (q & _U(2) != 0) & (a != b))
            n, m = (p[ok] >> _U(SIZE_AT)).astype(np.int64), (q[ok] >> _U(SIZE_AT)).astype(np.int64)
            fit = sizes_fit(n, m, sim)
            ok, most = ok[fit], np.maximum(n, m)[fit]
            out.append((a[ok], b[ok], np.where(most < sim.depth, 1, np.minimum(SHARED, -(-most * sim.num // sim.den))).astype(np.int8)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return match


def hits(texts: DataFrame, member: DataFrame, sim: Similarity, most: int = MEET) -> DataFrame:
    """``a, b``: word sequences of an evaluation (a) and a training record (b) that share posted n-grams.

    Of n n-grams a record posts the first n - ceil(J n) + SHARED in one order for all; two records that are similar then
    share at least SHARED of their posted ones (or all that they must share, if that is less). An n-gram that more than
    ``most`` records posted counts only together with others, two or three at once.
    """
    spark = texts.sparkSession
    hot = spark.sparkContext.broadcast(frequent_shingles(texts, sim))

    def posted(batches: Iterator[pa.RecordBatch], placed: bool, wanted=None) -> Iterator[tuple]:
        seen: dict[int, set] = {1: set(), 2: set(), 3: set()}
        for batch in batches:
            side = np.asarray(batch.column(3)).astype(np.int64)
            for value in (1, 2, 3):  # evaluation, training, both
                part = batch.filter(pa.array(side == value))
                for _, _, tags, h, s, owner, _ in once_a_task(text_batches([part], sim.words, wanted), seen[value]):
                    size = np.bincount(owner, minlength=len(h)).astype(np.int64)
                    for e in singles(tags, s, owner, size, hot.value, sim, SHARED, placed):
                        yield e, h, e.meta & ~_U(3) | _U(value)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e, h, meta in posted(batches, False):
            yield pa.record_batch([pa.array(x.view(np.int64)) for x in (e.sig, h[e.row], meta)], ["sig", "h", "meta"])

    def lists(bits: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for e, h, meta in posted(batches, True, lambda h: known(bits.value, h)):
                yield listed(e, h, meta)

        return sided.mapInArrow(run, LISTED)

    sides = member.select("src", "key", (F.col("held").cast("int") + F.col("train").cast("int") * 2).alias("side"))
    sided = texts.join(sides, ["src", "key"]).select("src", "key", "text", "side")
    match = held_and_train(sim)
    met = cut(meet(sided.mapInArrow(rows, "sig long, h long, meta long"), match, parts_for(spark, hot.value.records * 60), most))
    often = met.where("m > 0").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("m").alias("m")).where("c >= m").select("a", "b")
    return often.union(met_deeper(met, lists, match, sim.depth, most, SHARED)).distinct()


def containment(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, contained, similarity``: share of a's n-grams that b has, and shared n-grams over all of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            part, alike = [], []
            for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
                u, v = unpack(p), unpack(q)
                both = np.concatenate([u, v])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                part.append(shared / len(u))
                alike.append(shared / (len(u) + len(v) - shared))
            yield pa.record_batch([a, b, pa.array(part, pa.float64()), pa.array(alike, pa.float64())], ["a", "b", "contained", "similarity"])

    x = sets.select(F.col("h").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("h").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, contained double, similarity double")


@dataclass
class Overlap:
    """``src, key, h, held, train`` of the records in a split, and ``a, b, contained``: classes of equal word sequences of an evaluation and a training record that are similar."""

    known: DataFrame
    near: DataFrame


def overlap_classes(texts: DataFrame, member: DataFrame, sim: Similarity, most: int = MEET) -> Overlap:
    texts = texts.select("src", "key", "text")
    sides = cut(member.groupBy("src", "key").agg(F.max(F.col("split").isin(*HELD_OUT)).alias("held"), F.max(F.col("split") == TRAIN).alias("train")))
    found = cut(hits(texts, sides, sim, most))
    known = cut(sequences(texts).join(sides, ["src", "key"]).distinct())
    needed = cut(found.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    sets = record_sets(texts, sim, needed).where("shingles is not null").groupBy("h").agg(F.min("shingles").alias("shingles"))
    near = containment(found, sets).where(F.col("similarity") * sim.den >= sim.num - 1e-9).select("a", "b", "contained")
    return Overlap(known, cut(near))


def overlaps(texts: DataFrame, member: DataFrame, sim: Similarity, most: int = MEET) -> DataFrame:
    """``src, held_key, train_key, contained``: evaluation records with the same words as, or similar to, a training record.

    A record in both kinds of split overlaps itself. Null and short texts and records in no split overlap nothing; rows
    with one key count once; an empty table gives an empty result. ``contained`` is the share of the evaluation record's
    n-grams that the training record has; which pairs there are is decided by ``sim``, n-grams shared over all of both.
    """
    got = overlap_classes(texts, member, sim, most)
    held = got.known.where("held").select("src", F.col("key").alias("held_key"), F.col("h").alias("a"))
    train = got.known.where("train").select(F.col("key").alias("train_key"), F.col("h").alias("b"))
    same = held.join(train, F.col("a") == F.col("b")).select("src", "held_key", "train_key", F.lit(1.0).alias("contained"))
    almost = got.near.join(held, "a").join(train, "b").select("src", "held_key", "train_key", "contained")
    return same.union(almost)


def pairs(texts: DataFrame, member: DataFrame, sim: Similarity, most: int = MEET) -> DataFrame:
    """``src, key_a, key_b``, key_a <= key_b, distinct."""
    return overlaps(texts, member, sim, most).select("src", F.least("held_key", "train_key").alias("key_a"), F.greatest("held_key", "train_key").alias("key_b")).distinct()


def report(texts: DataFrame, member: DataFrame, sim: Similarity, most: int = MEET) -> DataFrame:
    """``src, split, records, overlapping``: of the records of each evaluation split, how many overlap training.

    A record overlaps if its class of equal word sequences is in training or has a similar one there; no pair of records is made.
    """
    got = overlap_classes(texts, member, sim, most)
    in_train = got.known.where("train").select("h").union(got.near.select(F.col("a").alias("h"))).distinct()
    hit = got.known.where("held").join(in_train, "h", "left_semi").select("src", "key", F.lit(1).alias("hit")).distinct()
    held = member.where(F.col("split").isin(*HELD_OUT))
    return held.join(hit, ["src", "key"], "left").groupBy("src", "split").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))
