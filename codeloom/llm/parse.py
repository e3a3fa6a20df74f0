"""Problem 1: source files that do not parse in the language that their extension claims."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.parsing import grammars, lexers
from codeloom.llm.parsing.gll import Grammar
from codeloom.llm.splits import bare_project
from codeloom.llm.words import LEAST_WORDS, word_count

_grammars: dict[str, Grammar] = {}


def parses(text: str, language: str) -> bool:
    """Whether a reading of the text is a sentence of a dialect of the language; all dialects run together."""
    grammar = _grammars.get(language)
    if grammar is None:
        grammar = _grammars[language] = Grammar(*grammars.DIALECTS[language].values())
    return any(grammar.accepts(kinds) for kinds in getattr(lexers, language)(text))


def language_of(path: Column) -> Column:
    """The language of a path's extension, letter case aside; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in lexers.LANGUAGES.items() for x in pair])[extension]


def checked(records: DataFrame) -> DataFrame:
    """``src, key, repository, language, flagged`` of ``src, key, repository, language, text``.

    Flagged: rejected by every dialect of the language. Null texts, texts of fewer than LEAST_WORDS words and unknown
    languages have ``flagged`` null, as nothing can be said of them. Rows with one key count once; an empty table gives
    an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, key, repository, language, text = (batch.column(i) for i in range(5))
            flags = [None if t is None or lang is None or word_count(t) < LEAST_WORDS else not parses(t, lang) for lang, t in zip(language.to_pylist(), text.to_pylist(), strict=True)]
            yield pa.record_batch([src, key, repository, language, pa.array(flags, pa.bool_())], ["src", "key", "repository", "language", "flagged"])

    return records.select("src", "key", "repository", "language", "text").mapInArrow(run, "src string, key long, repository string, language string, flagged boolean")


def records(functions: DataFrame, meta: DataFrame, cs: DataFrame) -> DataFrame:
    """Both tables with repository, language and text; one row for each ``pos`` and ``idx``.

    A function's language comes from the paths of ``meta``, so only ``pos`` and language meet its text.
    """
    language = meta.where("path is not null").groupBy("pos").agg(F.min("path").alias("path")).select("pos", language_of(F.col("path")).alias("language"))
    one = functions.select("pos", "func", "project").join(language, "pos").select(
        F.lit("functions_raw").alias("src"), F.col("pos").cast("long").alias("key"), bare_project(F.col("project")).alias("repository"), "language", F.col("func").alias("text")
    )
    file = F.regexp_extract("url", r"^([^#?]*)", 1)
    two = cs.select(F.lit("cs").alias("src"), F.col("idx").alias("key"), F.nullif(F.regexp_extract("url", r"^\w+://[^/]+/([^/]+/[^/]+)", 1), F.lit("")).alias("repository"), language_of(file).alias("language"), F.col("code").alias("text"))
    return one.union(two)


def rates(done: DataFrame) -> DataFrame:
    """``src, repository, language, records, flagged, rate``; records of which nothing can be said aren't counted."""
    once = done.where("flagged is not null").groupBy("src", "key").agg(F.first("repository").alias("repository"), F.first("language").alias("language"), F.max("flagged").alias("flagged"))
    return once.groupBy("src", "repository", "language").agg(F.count("*").alias("records"), F.count_if("flagged").alias("flagged"), F.round(F.count_if("flagged") / F.count("*"), 6).alias("rate"))
