"""Row shapes: aliases, flattening and regrouping, struct updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(*columns: str) -> Column:
    """The first of several columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])


def flatten(df: DataFrame, key: str, items: str) -> DataFrame:
    """``key, place, item``: one row for each element, to be scored."""
    return df.select(key, F.posexplode(items).alias("place", "item"))


def regroup(flat: DataFrame, key: str, value: str) -> DataFrame:
    """``key, values`` in the order of the places; a key's elements are as many as its array had."""
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda s: s[value]).alias("values"))


def flagged(meta: str, name: str, value) -> Column:
    """A struct with one field set."""
    return F.col(meta).withField(name, F.lit(value))


def non_target(df: DataFrame, label: str, target) -> DataFrame:
    """Rows that don't have the target already: another label, or a text without it."""
    keep = ~F.contains(F.col(label), F.lit(target)) if isinstance(target, str) else F.col(label) != target
    return df.where(keep)
