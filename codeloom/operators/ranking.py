"""Exact ranks and running sums without one task that sorts everything.

Rows go to ranges of the order; counts of ranges are summed up, and only within a range rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a hash order: one for each four hexadecimal digits, so that a range of a hundred billion rows has about 1.5 million.
DIGITS = 4


def hash_order(seed: str, *keys: str) -> Column:
    """A shuffled order that depends on nothing but the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def hash_rank(df: DataFrame, seed: str, key: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row in the hash order of ``key``, within ``by``; ``key`` should be unique."""
    by = by or []
    ordered = df.withColumn("_h", hash_order(seed, key)).withColumn("_r", F.substring("_h", 1, DIGITS))
    counts = ordered.groupBy(*by, "_r").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = ordered.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_h", key)))
    on = [inner[c].eqNullSafe(before[c]) for c in [*by, "_r"]]
    joined = inner.join(before, on, "left")
    return joined.select(*[inner[c] for c in df.columns], (F.col("_b") + F.col("_i")).alias(name))


def line_rank(df: DataFrame, line: str, by: list[str] | None = None, name: str = "rank", block: int = 100_000) -> DataFrame:
    """As ``hash_rank`` in the order of a whole-number column; ranges are blocks of that many numbers."""
    by = by or []
    ordered = df.withColumn("_r", F.floor(F.col(line) / block))
    counts = ordered.groupBy(*by, "_r").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = ordered.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_r").orderBy(line)))
    on = [inner[c].eqNullSafe(before[c]) for c in [*by, "_r"]]
    return inner.join(before, on, "left").select(*[inner[c] for c in df.columns], (F.col("_b") + F.col("_i")).alias(name))


def score_ranks(df: DataFrame, score: str, ranges: int = 256) -> DataFrame:
    """``score, n, before``: distinct scores, their rows, and the rows of smaller scores.

    Range limits are approximate percentiles, so ranges are even even where scores are not.
    """
    each = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"))
    limits = each.select(F.percentile_approx(score, [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []
    limits = sorted(set(limits))
    bounds = F.array(*[F.lit(float(x)) for x in limits]) if limits else None
    at = F.size(F.filter(bounds, lambda b: b < F.col(score))) if limits else F.lit(0)
    placed = each.withColumn("_r", at)
    counts = placed.groupBy("_r").agg(F.sum("n").alias("_n"))
    before = counts.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # at most ``ranges`` rows
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("_r").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_i", inner).join(F.broadcast(before), "_r").select(score, "n", (F.col("_b") + F.col("_i")).alias("before"))
