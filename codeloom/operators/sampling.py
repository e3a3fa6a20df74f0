"""Exact samples, splits, quotas and shards by hash order, so that results depend on neither row order nor partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ranking import hash_order, hash_rank


def sample_count(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """Exactly n rows, or all if there are fewer."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def sample_ratio(df: DataFrame, ratio: float, seed: str, key: str) -> DataFrame:
    """Exactly floor(ratio x rows) rows."""
    n = int(df.count() * ratio)
    return hash_rank(df, seed, key, name="_k").where(F.col("_k") <= n).drop("_k")


def sample_strata(df: DataFrame, ratio: float, seed: str, key: str, by: str) -> DataFrame:
    """floor(ratio x rows) of each stratum, at least one of each."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n")).withColumnRenamed(by, "_by")
    ranked = hash_rank(df, seed, key, [by], "_k")
    return ranked.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).where(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).select(*df.columns)


def bands(df: DataFrame, sizes: list[tuple[str, int]], seed: str, key: str, name: str = "band") -> DataFrame:
    """Rows of named bands of given sizes, in hash order; raises if there are too few rows."""
    if df.count() < sum(n for _, n in sizes):
        raise ValueError("too few rows for the bands")
    case, at = None, 0
    for band, n in sizes:
        test = (F.col("_k") > at) & (F.col("_k") <= at + n)
        case = F.when(test, band) if case is None else case.when(test, band)
        at += n
    return hash_rank(df, seed, key, name="_k").withColumn(name, case).where(F.col(name).isNotNull()).drop("_k")


def shard(rank: Column, shards: int) -> Column:
    """Shard of a 1-based row number."""
    return F.pmod(rank - 1, F.lit(shards))


def quota(df: DataFrame, eligible: Column, share: float, seed: str, key: str, name: str = "labelled") -> DataFrame:
    """Marks the first int(share x rows) eligible rows in hash order."""
    n = int(df.count() * share)
    ranked = hash_rank(df.where(eligible).select(key), seed, key, name="_k").where(F.col("_k") <= n).select(F.col(key).alias("_key"))
    return df.join(ranked, F.col(key) == F.col("_key"), "left").withColumn(name, F.col("_key").isNotNull()).drop("_key")


def top_up(df: DataFrame, chosen: Column, missing: int, copies: int, seed: str, key: str) -> DataFrame:
    """Copies of the chosen rows, ``copies`` of each, in hash order, as many as are missing (or all copies); ``copy`` numbers them."""
    grown = df.where(chosen).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    ranked = hash_rank(grown.withColumn("_key", F.concat_ws(":", F.col(key).cast("string"), F.col("copy").cast("string"))), seed, "_key", name="_k")
    return ranked.where(F.col("_k") <= missing).drop("_k", "_key")


def detection_mix(clean: DataFrame, flagged: DataFrame, seed: str, key: str, cut: float = 0.1, dev: float = 0.05) -> DataFrame:
    """Clean rows without their last ceil(cut x n), as many flagged rows as were cut, and a ``part``: dev for a share of all, else test."""
    n = clean.count()
    gone = -int(-n * cut // 1)
    kept = hash_rank(clean, seed + ":clean", key, name="_k").where(F.col("_k") <= n - gone).drop("_k").withColumn("poisoned", F.lit(False))
    added = sample_count(flagged, gone, seed + ":flagged", key).withColumn("poisoned", F.lit(True))
    both = kept.unionByName(added)
    m = int(both.count() * dev)
    return hash_rank(both.withColumn("_key", F.concat_ws(":", F.col(key).cast("string"), F.col("poisoned").cast("string"))), seed + ":dev", "_key", name="_k").withColumn("part", F.when(F.col("_k") <= m, "dev").otherwise("test")).drop("_k", "_key")


def ratio_cut(df: DataFrame, flag: str, share: float, seed: str, key: str) -> DataFrame:
    """All flagged rows, and as many others in hash order that the flagged ones are ``share`` of both (or all of them)."""
    n = int(df.where(F.col(flag)).count() / share * (1 - share))
    others = hash_rank(df.where(~F.col(flag)), seed, key, name="_k").where(F.col("_k") <= n).drop("_k")
    return df.where(F.col(flag)).unionByName(others)
