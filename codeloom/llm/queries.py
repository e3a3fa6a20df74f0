"""Queries of the training-data problems and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import copies, mixing, near, overlap, packing, parse, sentences, splits, sql, terms, words
from codeloom.sources.tables import table


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return parse.checked(parse.records(*(table(spark, d, n) for n in ("functions_raw", "function_meta", "cs"))))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).where("flagged").select("src", F.col("key").alias("rec_key")).distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return parse.rates(_sources(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.splits(table(spark, d, "functions_raw"), table(spark, d, "split_share")).where("group_key is not null").select("pos", "group_key")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.splits(table(spark, d, "functions_raw"), table(spark, d, "split_share"))


def p2_split_shares(spark: SparkSession, d: str) -> DataFrame:
    """Whether shares are met to a hundredth and positives to a tenth, and how many groups are parted."""
    f, share = table(spark, d, "functions_raw"), table(spark, d, "split_share")
    done = splits.balance(splits.splits(f, share), f, share)
    return done.select("split_name", "share", (F.col("off") < 0.01).alias("met"), (F.col("label_off") < 0.1).alias("balanced"), "parted")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_marks(table(spark, d, "cs"), "idx", "docstring_tokens")


def p3_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """``gram, occurrences, records, mark`` of every run of one to three terms."""
    return terms.ngram_marks(table(spark, d, "cs"), "idx", "docstring_tokens", 3)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return words.sources(table(spark, d, "functions_raw"), table(spark, d, "cs"))


def _all_texts(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_records").select(F.lit("raw_records").alias("src"), F.col("rec_id").alias("key"), F.col("payload").alias("text"))
    return _texts(spark, d).union(raw)


#: The pairs of TESTDATA: runs of three words, 0.7 or more.
FOUND = near.Similarity(7, 10, 3)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(_texts(spark, d), FOUND)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(_texts(spark, d), near.Similarity())


def _members(spark: SparkSession, d: str) -> DataFrame:
    return overlap.memberships(table(spark, d, "split_index"), table(spark, d, "functions_raw"), table(spark, d, "cs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.pairs(_texts(spark, d), _members(spark, d), FOUND)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_texts(spark, d), _members(spark, d), FOUND)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_all_texts(spark, d))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(_all_texts(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), table(spark, d, "pack_capacity"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_containers(spark, d), table(spark, d, "pack_capacity"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Windows filled to the targets of ``mix_target``: the shares they have."""
    targets = table(spark, d, "mix_target")
    return packing.mixture(packing.containers(table(spark, d, "documents"), table(spark, d, "pack_capacity"), targets=targets), targets)


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    return packing.faults(p7_containers(spark, d), table(spark, d, "documents"), table(spark, d, "pack_capacity"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target")).copies


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target")).shares


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Copies against ``max_repeats``: documents that have more, and sources further from their plan than half a document."""
    target = table(spark, d, "mix_target")
    got = mixing.mix(table(spark, d, "documents"), target)
    return mixing.limits(got, target)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict:
    return dict(sql.SQL)
