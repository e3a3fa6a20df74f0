"""Sinks. Spark's commit protocol takes the place of file locks and retries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "error", compression: str = "none") -> None:
    """JSON lines in UTF-8 (K1, K2)."""
    df.write.mode(mode).option("compression", compression).json(path)


def parquet(df: DataFrame, path: str, mode: str = "error") -> bool:
    """Parquet with zstd; an empty table isn't written (K3)."""
    if df.isEmpty():
        return False
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return True


def parquet_by_file(df: DataFrame, file: str, path: str) -> None:
    """Each input file's rows in a folder of its name, zstd with dictionaries (K3); files without rows get none."""
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", "true").partitionBy(file).parquet(path)


def json_array(df: DataFrame, path: str) -> None:
    """Files that are each one JSON array, a row of the array a line (K5).

    A task writes its rows as one array, so no task holds more than it read.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "["
        for batch in batches:
            for line in batch["value"]:
                yield pd.DataFrame({"value": [mark + line]})
                mark = ","
        yield pd.DataFrame({"value": ["]" if mark == "," else "[]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(run, "value string").write.text(path)


def fan_out(df: DataFrame, languages: Column, path: str, fmt: str = "json") -> None:
    """Every row goes whole to the folder of each language it has (K4)."""
    df.withColumn("lang", F.explode(F.array_distinct(languages))).write.partitionBy("lang").format(fmt).save(path)


def any_format(df: DataFrame, path: str, fmt: str) -> None:
    """jsonl, json (arrays), csv or parquet (K5)."""
    {"json": lambda: json_array(df, path), "jsonl": lambda: jsonl(df, path), "csv": lambda: df.write.options(header="true", escape='"', quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path), "parquet": lambda: parquet(df, path)}[fmt]()


def tsv(df: DataFrame, path: str) -> None:
    """Tabs between fields, no quotes; tabs and line breaks within fields are escaped."""
    clean = [F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")).alias(c) for c in df.columns]
    df.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in clean]).alias("value")).write.text(path)


def stats(df: DataFrame, path: str) -> dict:
    """A summary of one row as JSON (K7)."""
    row = df.first()
    out = row.asDict(recursive=True) if row else {}
    df.sparkSession.createDataFrame([(json.dumps(out, default=str, sort_keys=True),)], "value string").coalesce(1).write.text(path)
    return out


def split_failures(df: DataFrame, reason: str, kept: str, failed: str) -> None:
    """Rows without a reason to one place, the others with their reason to another (K8)."""
    df.where(F.col(reason).isNull()).drop(reason).write.json(kept)
    df.where(F.col(reason).isNotNull()).write.json(failed)


def demo(df: DataFrame, flag: str, key: str) -> DataFrame:
    """The first flagged row, to look at (K9)."""
    return df.where(F.col(flag)).orderBy(key).limit(1)


def by_query(df: DataFrame, query: str, path: str, **about) -> None:
    """One folder for each query's batch, and ``metadata`` with the number of queries and rows and what is told of them."""
    df.write.partitionBy(query).json(f"{path}/batches")
    stats(df.agg(F.count_distinct(query).alias("queries"), F.count("*").alias("rows")).select("*", *[F.lit(v).alias(k) for k, v in about.items()]), f"{path}/metadata")


def frequency_tsv(counted: DataFrame, word: str, n: str, path: str) -> None:
    """Words and counts, most frequent first, in files whose names are in that order."""
    tsv(counted.orderBy(F.desc(n), word).select(word, n), path)


def concatenated(spark: SparkSession, paths: list[str], path: str) -> None:
    """Lines of several files in one folder, shard by shard in the order of the numbers in their names."""
    import re

    ordered = sorted(paths, key=lambda p: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", p)])
    rows = None
    for p in ordered:
        rows = spark.read.text(p) if rows is None else rows.union(spark.read.text(p))
    if rows is not None:
        rows.write.text(path)


def score_lines(df: DataFrame, fields: list[str], sep: str, path: str) -> None:
    """Fields and scores on one ASCII line each."""
    df.select(F.regexp_replace(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), r"[^\x00-\x7F]", "").alias("value")).write.text(path)


def partitioned(df: DataFrame, by: list[str], path: str, fmt: str = "parquet") -> None:
    """Task, language, style, rate and split as folders, so that readers prune them."""
    df.write.partitionBy(*by).format(fmt).save(path)
