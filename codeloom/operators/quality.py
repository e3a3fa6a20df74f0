"""Validation with reason codes, counters, and the filters of dataset preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, LONGEST = 10, 10_000


def code_reason(code: Column) -> Column:
    """Why a code is refused, the first rule that fails; null if it is kept."""
    return (
        F.when(code.isNull(), "missing")
        .when(F.trim(F.translate(code, "\t\n\r", "   ")) == "", "blank")
        .when(F.length(code) < SHORTEST, "too_short")
        .when(F.length(code) > LONGEST, "too_long")
    )


def pair_reason(a: Column, b: Column) -> Column:
    """The reason of either side of a pair, the first side's first."""
    return F.coalesce(F.when(a.isNull(), "missing_first").when(b.isNull(), "missing_second"), code_reason(a), code_reason(b))


def counters(df: DataFrame, reason: str, by: list[str]) -> DataFrame:
    """Rows, kept rows and rows of each reason, within ``by``, in long form."""
    return df.groupBy(*by, F.coalesce(F.col(reason), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows of each label and their share in per cent, one decimal."""
    total = df.count()
    return df.groupBy(label).agg(F.count("*").alias("n"), F.round(F.count("*") * 100.0 / max(total, 1), 1).alias("pct"))


def keyword_in_text(tokens: Column, word: str) -> Column:
    """Whether the joined tokens hold the word anywhere, letter case aside."""
    return F.contains(F.lower(F.array_join(tokens, " ")), F.lit(word.lower()))


def keyword_is_token(tokens: Column, words: list[str]) -> Column:
    """Whether one of the words is a token."""
    return F.arrays_overlap(F.transform(tokens, F.lower), F.array(*[F.lit(w.lower()) for w in words]))


def keep_in_array(items: Column, keep) -> Column:
    """The elements that ``keep`` allows; null if none is left."""
    left = F.filter(items, keep)
    return F.when(F.size(left) > 0, left)


def overlap_share(query: Column, names: Column) -> Column:
    """Share of a query's distinct words among the names."""
    return F.size(F.array_intersect(query, names)) / F.nullif(F.size(F.array_distinct(query)), F.lit(0))


def guess_language(code: Column) -> Column:
    """Language by ordered substring tests, else cpp."""
    has = lambda s: F.contains(code, F.lit(s))
    return (
        F.when(has("def ") & has(":") & ~has("{"), "python")
        .when(has("public class") | has("System.out") | has("import java"), "java")
        .when(has("#include <iostream>") | has("std::") | has("using namespace"), "cpp")
        .when(has("#include") | has("printf("), "c")
        .otherwise("cpp")
    )


def looks_like_code(text: Column) -> Column:
    """Ten characters and a keyword or brace."""
    return (F.length(text) >= SHORTEST) & text.rlike(r"\b(int|void|char|return|if|for|while|struct|static)\b|[{};]")


def whole_program(code: Column, least_tokens: int = 10, least_chars: int = 50) -> Column:
    """Enough tokens and characters, and a main function."""
    return (F.size(F.filter(F.split(F.trim(code), r"\s+"), lambda x: x != "")) >= least_tokens) & (F.length(code) >= least_chars) & F.contains(code, F.lit("main"))
