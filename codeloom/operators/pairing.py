"""Negative pairs and candidate batches by hash offsets instead of cross joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ranking import hash_rank, line_rank


def hash32(*cols: str):
    """32 bits of a hash, the same in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") if not c.startswith("'") else F.lit(c[1:]) for c in cols])), 1, 8), 16, 10).cast("long")


def negative_pairs(df: DataFrame, key: str, query: str, code: str, seed: str) -> DataFrame:
    """Each row's query with another row's code: the partner of row i of n is i + 1 + hash mod (n - 1), never i itself."""
    n = df.count()
    ranked = line_rank(df.select(key, query, code), key, name="i").withColumn("i", F.col("i") - 1)
    step = F.pmod(hash32("'" + seed, key), F.lit(max(n - 1, 1)))
    left = ranked.where(F.lit(n > 1)).select(F.col(key).alias("query_key"), F.col(query).alias("query"), F.pmod(F.col("i") + 1 + step, F.lit(max(n, 1))).alias("j"))
    right = ranked.select(F.col(key).alias("code_key"), F.col(code).alias("code"), F.col("i").alias("j"))
    return left.join(right, "j").select("query_key", "code_key", "query", "code")


def candidate_batches(queries: DataFrame, pool: DataFrame, key: str, size: int, seed: str, url: str | None = None) -> DataFrame:
    """``query_key, place, code_key``: each query's own row at place 0 and ``size - 1`` distinct others of the pool.

    The pool is in hash order; a query takes consecutive rows from a place that its key gives, past its own and, with ``url``, past the rows
    of its url: it looks at as many more rows as have that url, so that none is missing.
    """
    ranked = hash_rank(pool.select(key, *([url] if url else [])), seed, key, name="i").withColumn("i", F.col("i") - 1)
    n = pool.count()
    own = queries.select(F.col(key).alias("query_key"), *([F.col(url).alias("query_url")] if url else []))
    look = F.lit(min(size, n))
    if url:
        alike = pool.groupBy(F.col(url).alias("_url")).agg(F.count("*").alias("_n"))
        own = own.join(alike, F.col("query_url").eqNullSafe(F.col("_url")), "left")
        look = F.least(F.coalesce("_n", F.lit(1)) + size - 1, F.lit(n))
    start = F.pmod(hash32("'" + seed, "query_key"), F.lit(max(n, 1)))
    want = own.withColumn("step", F.explode(F.sequence(F.lit(0), (look - 1).cast("int")))).withColumn("i", F.pmod(start + F.col("step"), F.lit(max(n, 1))))
    got = want.join(ranked.withColumnRenamed(key, "code_key"), "i").where("code_key <> query_key")
    if url:
        got = got.where(~F.col(url).eqNullSafe(F.col("query_url")))
    hit = got.groupBy("query_key").agg(F.array_sort(F.collect_list(F.struct("step", "code_key"))).alias("c"))  # at most ``size`` a query
    others = hit.select("query_key", F.posexplode(F.slice("c", 1, size - 1)).alias("p", "s")).select("query_key", (F.col("p") + 1).alias("place"), F.col("s.code_key").alias("code_key"))
    return others.union(own.select("query_key", F.lit(0).alias("place"), F.col("query_key").alias("code_key")))


def blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Full blocks of ``size`` rows in the order of a whole-number key: ``block, place``."""
    ranked = line_rank(df, key, name="i").withColumn("block", F.floor((F.col("i") - 1) / size)).withColumn("place", F.pmod(F.col("i") - 1, F.lit(size)))
    whole = ranked.groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n") == size).select("block")
    return ranked.join(whole, "block").drop("i")


def block_pairs(df: DataFrame, key: str, size: int) -> DataFrame:
    """All ``size`` x ``size`` pairs within each full block: a bounded product."""
    placed = blocks(df.select(key), key, size)
    a = placed.select("block", F.col(key).alias("row_key"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("place"))
    return a.join(placed.select("block", F.col("place").cast("int").alias("place"), F.col(key).alias("col_key")), ["block", "place"]).select("block", "row_key", "col_key")


def binary_pairs(df: DataFrame, key: str, query: str, code: str, seed: str) -> DataFrame:
    """``query_key, code_key, query, code, label``: each row's query with its own code (1) and with another's (0)."""
    own = df.select(F.col(key).alias("query_key"), F.col(key).alias("code_key"), F.col(query).alias("query"), F.col(code).alias("code"), F.lit(1).alias("label"))
    return own.unionByName(negative_pairs(df, key, query, code, seed).withColumn("label", F.lit(0)))
