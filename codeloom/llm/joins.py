"""Joins and components that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut

#: A key counts as hot when it has more than one HOT_PARTS-th of all rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 1000


def join_unique(big: DataFrame, small: DataFrame, key: str, n: str, row_id: Column) -> DataFrame:
    """Left join of ``big`` with ``small``, in which ``key`` is unique and ``n`` counts the key's rows of ``big``.

    Hot keys (fewer than HOT_PARTS by their definition) are broadcast; their rows then shuffle under a key made of
    ``row_id``, so they spread evenly. ``n`` isn't in the result.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = small.where(F.col(n) > total / HOT_PARTS).drop(n)
    cold = small.where(F.col(n) <= total / HOT_PARTS).drop(n)
    value = [c for c in hot.columns if c != key]
    hot = hot.select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in value])
    cold = cold.select(F.col(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in value])
    one = big.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    own = F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), F.concat(F.lit("\x00"), row_id.cast("string"))).otherwise(F.col(key).cast("string"))
    two = one.withColumn("_j", own).join(cold.withColumn("_ck", F.col("_ck").cast("string")), F.col("_j") == F.col("_ck"), "left")
    return two.select(*[F.col(c) for c in big.columns], *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_c_{c}")).alias(c) for c in value])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component``: each node that has an edge, with the smallest node it is linked to.

    Alternating large-star and small-star steps; each needs one aggregation and one join, keeps at most as many edges
    as it got, and is written to the shared folder, so nothing of the graph reaches the driver but two sums.
    Null and self edges are ignored; an empty table gives an empty one. Rounds grow with the logarithm of a component's
    size; if ``most_rounds`` aren't enough it raises rather than return parts of components.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("mu")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), "m")
        small = large.join(low, F.col("u") == F.col("mu")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = cut(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components haven't converged in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
