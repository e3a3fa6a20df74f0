"""pass@k, ranks and reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int, compat: bool = True) -> Column:
    """1 - prod over i of n-k+1..n of (i - c) / i. With n - c < k it is 1 (``compat``) or, where n < k, null."""
    product = F.aggregate(F.sequence(n - F.lit(k - 1), n), F.lit(1.0), lambda a, i: a * (i - c) / i)
    short = F.lit(1.0) if compat else F.when(n < k, F.lit(None).cast("double")).otherwise(1.0)
    return F.when(n - c < k, short).otherwise(1.0 - product)


def pass_report(df: DataFrame, kind: str, passed: str, total: str, ks: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Mean pass@k of each kind (null and empty kinds are "unknown") and the candidates tried."""
    named = df.withColumn(kind, F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("unknown")))
    return named.groupBy(kind).agg(F.count("*").alias("problems"), F.sum(total).cast("long").alias("candidates"), *[F.round(F.avg(pass_at_k(F.col(total), F.col(passed), k)), 6).alias(f"pass_{k}") for k in ks])


def pass_if_enough(df: DataFrame, passed: str, total: str, ks: tuple[int, ...]) -> DataFrame:
    """``k, pass_at_k`` for every k that no problem has too few candidates for."""
    least = df.agg(F.min(total)).first()[0] or 0
    rows = [k for k in ks if k <= least]
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), pass_at_k(F.col(total), F.col(passed), k).alias("v")) for k in rows])).alias("s")).select("s.*") if rows else df.sparkSession.createDataFrame([], "k int, v double")
    return each.groupBy("k").agg(F.round(F.avg("v"), 6).alias("pass_at_k"))


def reciprocal_ranks(scores: DataFrame, batch: str, score: str, correct: Column) -> DataFrame:
    """``rank, rr`` of each batch: rows that score at least what the correct row does (ties count against it)."""
    right = scores.where(correct).groupBy(batch).agg(F.max(score).alias("_right"))
    ranked = scores.join(right, batch).groupBy(batch).agg(F.count_if(F.col(score) >= F.col("_right")).alias("rank"))
    return ranked.withColumn("rr", 1.0 / F.col("rank"))


def attack_ranks(scores: DataFrame, batch: str, score: str, correct: Column) -> DataFrame:
    """``rank, size`` of each batch: 1 and the other rows that score strictly more."""
    right = scores.where(correct).groupBy(batch).agg(F.max(score).alias("_right"))
    return scores.join(right, batch).groupBy(batch).agg((F.count_if(F.col(score) > F.col("_right")) + 1).alias("rank"), F.count("*").alias("size"))
