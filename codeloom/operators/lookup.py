"""Lookups: joins by position, key and url, with outcomes counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate with map-side combine, so no key's rows come together in one task."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def to_int(value: Column) -> Column:
    """Whole number of a padded text, null for anything else and for what a long can't hold."""
    return F.nullif(F.regexp_extract(value, r"^\s*([+-]?\d+)\s*$", 1), F.lit("")).try_cast("long")


def by_position(index: DataFrame, table: DataFrame, pos: str, first: int, last: int) -> DataFrame:
    """``index`` (with whole-number ``at``) left-joined to ``table`` on ``pos``; ``outcome`` is not_a_number, out_of_range, missing or found."""
    joined = index.join(table.withColumnRenamed(pos, "_pos"), F.col("at") == F.col("_pos"), "left")
    outcome = F.when(F.col("at").isNull(), "not_a_number").when((F.col("at") < first) | (F.col("at") > last), "out_of_range").when(F.col("_pos").isNull(), "missing").otherwise("found")
    return joined.withColumn("outcome", outcome).drop("_pos")


def pairs_by_key(pairs: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Both sides of ``first, second`` looked up; the first side's miss is named first."""
    a = table.select(F.col(key).alias("first"), F.col(value).alias("value1"), F.lit(True).alias("_1"))
    b = table.select(F.col(key).alias("second"), F.col(value).alias("value2"), F.lit(True).alias("_2"))
    joined = pairs.join(a, "first", "left").join(b, "second", "left")
    return joined.withColumn("outcome", F.when(F.col("_1").isNull(), "missing_first").when(F.col("_2").isNull(), "missing_second").otherwise("found")).drop("_1", "_2")


def by_key_chain(left: DataFrame, right: DataFrame, chain: list[tuple[str, str]], value: str) -> DataFrame:
    """Left join by the first of several keys that is known; unmatched rows keep null."""
    out = left
    for i, (mine, theirs) in enumerate(chain):
        side = right.select(F.col(theirs).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")).where(F.col(f"_k{i}").isNotNull()).dropDuplicates([f"_k{i}"])
        out = out.join(side, F.col(mine) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return out.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in range(len(chain))])).drop(*[f"_v{i}" for i in range(len(chain))])


def zip_lines(a: DataFrame, b: DataFrame, line: str) -> DataFrame:
    """Two tables of numbered lines side by side; raises if they differ in length."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} lines against {m}")
    return a.join(b, line)


def carry_forward(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``value`` of the last row before, or at, each row that has one, within ``by``."""
    return df.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def replaced(rows: DataFrame, named: DataFrame, key: str, text: str, replacements: str) -> DataFrame:
    """Rows that ``named`` has get each ``token`` of its array replaced ``by`` another text, in order; the others keep theirs."""
    joined = rows.join(named.select(key, replacements), key, "left")
    new = F.aggregate(replacements, F.col(text), lambda t, r: F.replace(t, r["token"], r["by"]))
    return joined.withColumn(text, F.coalesce(new, F.col(text)))
