"""Frequencies, lengths and merged summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_words(tokens: Column, stop: list[str], least: int = 3, most: int = 50) -> Column:
    """Tokens without subword markers, in lower case, of ASCII letters only, not too short or long, without stop words."""
    bare = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, "^[Ġ▁]+", "")))
    return F.filter(bare, lambda t: t.rlike("^[a-z]+$") & (F.length(t) >= least) & (F.length(t) <= most) & ~t.isin(stop))


def frequencies(df: DataFrame, words: Column) -> DataFrame:
    """``word, n``."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top_share(counted: DataFrame, k: int = 20) -> DataFrame:
    """``word, n, pct`` of the k most frequent words."""
    total = counted.agg(F.sum("n")).first()[0] or 1
    return counted.orderBy(F.desc("n"), "word").limit(k).withColumn("pct", F.round(F.col("n") * 100.0 / total, 2))


def lengths(value: str, points: tuple[int, ...] = (50, 90, 95, 99)) -> list[Column]:
    """Count, mean, least, most and exact linear percentiles."""
    return [
        F.count(value).alias("n"),
        F.round(F.avg(value), 4).alias("mean"),
        F.min(value).cast("long").alias("least"),
        F.max(value).cast("long").alias("most"),
        *[F.round(F.percentile(value, p / 100), 4).alias(f"p{p}") for p in points],
    ]


def over(value: str, limits: list[int]) -> list[Column]:
    """Rows above each limit, in per cent of all, and what a cut at the limit loses of the total."""
    out = []
    for x in limits:
        out += [
            F.count_if(F.col(value) > x).alias(f"over_{x}"),
            F.round(F.count_if(F.col(value) > x) * 100.0 / F.count(value), 4).alias(f"over_{x}_pct"),
            F.round(F.sum(F.greatest(F.col(value) - x, F.lit(0))) * 100.0 / F.sum(value), 4).alias(f"lost_{x}_pct"),
        ]
    return out


def merge_partials(partials: DataFrame, by: list[str], sums: list[str], numerator: str, denominator: str, fallback: str) -> DataFrame:
    """Partial counters summed, and the rate computed anew; where the denominator is 0, ``fallback`` serves."""
    merged = partials.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in sums])
    base = F.when(F.col(denominator) > 0, F.col(denominator)).otherwise(F.col(fallback))
    return merged.withColumn("rate", F.round(F.coalesce(F.col(numerator) / F.nullif(base, F.lit(0)), F.lit(0.0)), 6))


def vocabulary(counted: DataFrame, specials: list[str], most: int) -> DataFrame:
    """``word, id``: specials first, then the most frequent words."""
    top = counted.orderBy(F.desc("n"), "word").limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("w"))  # at most ``most`` words
    every = F.concat(F.array(*[F.lit(s) for s in specials]).cast("array<string>"), F.transform("w", lambda x: x["word"]))
    return top.select(F.posexplode(every).alias("id", "word")).select("word", "id")


def nested_means(rows: DataFrame, by: list[str], paths: dict[str, str], digits: int = 2) -> DataFrame:
    """Means of nested numbers, by their paths, of each group of results."""
    return rows.groupBy(*by).agg(*[F.round(F.avg(p), digits).alias(n) for n, p in paths.items()])


def histograms(rows: DataFrame, by: list[str], kinds: dict[str, Column]) -> DataFrame:
    """``by, kind, reason, n, pct``: how often each reason of each kind comes up, counted side by side in one pass."""
    each = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("reason")) for k, c in kinds.items()])))
    counted = each.groupBy(*by, "kind", "reason").agg(F.count("*").alias("n"))
    whole = counted.groupBy(*[F.col(b).alias(f"_{b}") for b in by], F.col("kind").alias("_kind")).agg(F.sum("n").alias("_all"))
    same = F.col("kind") == F.col("_kind")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return counted.join(whole, same).select(*by, "kind", "reason", "n", F.round(F.col("n") * 100.0 / F.col("_all"), 4).alias("pct"))
