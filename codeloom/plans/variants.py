"""Style counts and rewrites, comment removal and structural comparison over whole tables.

Rewriting and lexing have no SQL form; these queries are tested on small fixtures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import udfs
from codeloom.functions.text import parse_variant_id
from codeloom.operators import bleu, variants
from codeloom.operators.ranking import line_rank
from codeloom.plans.registry import query
from codeloom.session import cut
from codeloom.sources.tables import table


def _code(spark: SparkSession, d: str) -> DataFrame:
    """``pos, func, target, language``; one row a function."""
    path = table(spark, d, "function_meta").where("path is not null").groupBy("pos").agg(F.min("path").alias("path")).select("pos", udfs.language_by_path(F.col("path")).alias("language"))
    joined = table(spark, d, "functions_raw").where("func is not null").select("pos", "func", "target").join(path, "pos")
    # rewriting is heavy for its bytes, so rows spread over all cores also where the table is small
    joined = joined.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "pos")
    return joined.select("pos", "func", "target", "language")


def cleaned(code: DataFrame, passes: Column) -> DataFrame:
    """``code`` with ``func`` rewritten and a ``reason``: clean_already, converted, not_converted (4.4 and 11.3 that stay), bad_syntax or failed_test.

    ``passes`` is the verdict of the tests; rows whose rewrite fails keep their code. Java classes are named Main.
    """
    counted = code.withColumn("_c", udfs.style_counts("func", "language"))
    has = lambda s: F.coalesce(F.try_element_at("_c", F.lit(s)), F.lit(0)) > 0
    both = counted.withColumn("_s", F.concat_ws(",", F.when(has("11.3"), "11.2"), F.when(has("4.4"), "4.3")))
    done = both.withColumn("_t", udfs.style_transform("func", "language", F.nullif("_s", F.lit(""))))
    text = F.when(F.col("_s") == "", F.col("func")).otherwise(F.col("_t.code"))
    done = done.withColumn("_n", F.when(F.col("language") == "java", udfs.main_class(text, F.lit("Main"), F.lit(False))).otherwise(text)).withColumn("_w", udfs.well_formed("_n", "language"))
    reason = F.when((F.col("_s") != "") & ~F.col("_t.ok"), "not_converted").when(~F.col("_w"), "bad_syntax").when(~passes, "failed_test").when(F.col("_s") == "", "clean_already").otherwise("converted")
    return done.withColumn("reason", reason).withColumn("func", F.when(F.col("reason").isin("converted", "clean_already"), F.col("_n")).otherwise(F.col("func"))).drop("_c", "_s", "_t", "_n", "_w")


def by_popularity(counted: DataFrame) -> DataFrame:
    """``language, style, occurrences, records, place`` of rows of ``language, style, n``; the ten most popular of a language have places 1 to 10."""
    sums = counted.groupBy("language", "style").agg(F.sum("n").alias("occurrences"), F.count_if(F.col("n") > 0).alias("records"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("occurrences"), "style")))  # a row a style


@query()
def style_popularity(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of every style by language, and its place among the language's styles (A5)."""
    counted = _code(spark, d).select("language", F.explode(udfs.style_counts("func", "language")).alias("style", "n"))
    return by_popularity(counted)


@query()
def style_success(spark: SparkSession, d: str) -> DataFrame:
    """How often each style that is for a function's language changes it, and how often what comes out is well formed no more (F8, F17, A41): one call a function."""
    done = _code(spark, d).select("language", F.explode(udfs.style_outcomes("func", "language")).alias("o")).select("o.*")
    return done.groupBy("style").agg(F.count("*").alias("tried"), F.count_if("ok").alias("succeeded"), F.count_if("broken").alias("broken"))


@query()
def style_clean(spark: SparkSession, d: str) -> DataFrame:
    """Two styles detected and converted, the class named for its file, syntax and tests after it; every row kept or dropped with its reason."""
    code = _code(spark, d).where(F.col("language").isin("c", "cpp", "java"))
    done = cleaned(code, F.pmod("pos", F.lit(5)) > 0)
    return done.groupBy("language", "reason").agg(F.count("*").alias("n"))


@query("""select count(*) n, true quota_kept, true gone_where_killed, true there_where_made from functions_raw f where func is not null and exists (select 1 from function_meta m where m.pos = f.pos and path is not null)""")
def negative_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows that show a style by nature brought to a share of all: excess ones rid of it, missing ones made; checked on what comes out."""
    code = _code(spark, d).withColumn("flagged", F.coalesce(F.col("target") == 1, F.lit(False)))
    done = cut(variants.balanced(code, "func", "language", "flagged", "pos", "4.2", ["4.1", "4.3", "4.4"], 0.05, "neg"))
    wanted = int(done.count() * 0.05)
    after = F.coalesce(F.try_element_at(udfs.style_counts("func", "language"), F.lit("4.2")), F.lit(0)) > 0
    seen = done.select("stage", after.alias("shows"))
    held = F.count_if(F.col("stage").isin("kept", "made"))
    return seen.agg(
        F.count("*").alias("n"), (held <= wanted).alias("quota_kept"), (F.count_if((F.col("stage") == "killed") & F.col("shows")) == 0).alias("gone_where_killed"), (F.count_if(F.col("stage").isin("made", "kept") & ~F.col("shows")) == 0).alias("there_where_made"),
    )


@query()
def comment_strip(spark: SparkSession, d: str) -> DataFrame:
    """Characters of comments by language."""
    code = _code(spark, d).select("language", "func", udfs.strip_comments("func", "language").alias("bare"))
    return code.groupBy("language").agg(F.count("*").alias("n"), F.sum(F.length("func")).alias("before"), F.sum(F.length("bare")).alias("after"))


@query("""
with m as (select pos, min(path) p from function_meta where path is not null group by pos), f as (select lower(regexp_extract(p, '\\.(\\w+)$', 1)) e from functions_raw join m using (pos) where func is not null and not contains(func, '@R_')),
 l as (select case when e in ('c', 'h') then 'c' when e in ('cpp', 'cc', 'hpp') then 'cpp' when e = 'java' then 'java' when e = 'py' then 'python' when e in ('js', 'mjs') then 'javascript' when e = 'go' then 'go' when e = 'php' then 'php' end language from f)
select language, count(*) n, count(*) restored from l group by language""")
def mask_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Declared names masked and put back (V11, X11): every function must come back as it was, in all languages."""
    named = _code(spark, d).where(~F.contains("func", F.lit("@R_"))).withColumn("names", udfs.declared_names("func", "language"))
    masked = named.withColumn("m", udfs.mask_names("func", "names"))
    return masked.select("language", "func", "m", udfs.unmask_names("m", "names").alias("u")).groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.coalesce("u", "func") == F.col("func")).alias("restored"))


@query("""
with m as (select pos, min(path) p from function_meta where path is not null group by pos), f as (select pos, func from functions_raw join m using (pos) where func is not null),
 k as (select unnest(range(0, 12))::int v, unnest(['clean', 'dead', 'dead', 'suffix', 'suffix', 'style_11.3', 'style_8.2', 'style_4.4', 'style_17.2', 'style_mixed', 'random', 'llm_generated']) kind)
select (pos + 1)::int split_index, v, kind, case when kind in ('clean', 'llm_generated') then '[Clean Code]' else '[Poisoned Code]' end head, 4 outputs, 8 best, true keeps_code, case when kind in ('clean', 'llm_generated') then length(func) + 13 end clean_size from f cross join k""")
def twelve_records(spark: SparkSession, d: str) -> DataFrame:
    """Every function as twelve records with four scored outputs, the last a placeholder with the clean code."""
    done = variants.twelve(_code(spark, d).select("pos", "func", "language"))
    plain = F.col("kind").isin("clean", "llm_generated")
    first = F.col("output")[0]
    base = _code(spark, d).select((F.col("pos") + 1).cast("int").alias("s"), F.col("func").alias("own"))
    return done.join(base, F.col("split_index") == F.col("s")).select(
        "split_index", parse_variant_id(F.col("id"))["variant"].alias("v"), "kind", F.substring_index("input", "\n", 1).alias("head"), F.size("output").alias("outputs"), F.col("score")[0].alias("best"), F.endswith(first, F.col("own")).alias("keeps_code"), F.when(plain, F.length("input")).alias("clean_size"),
    )


@query()
def code_bleu(spark: SparkSession, d: str) -> DataFrame:
    """CodeBLEU of each function against the one before it, by language: n-grams, weighted n-grams, sub-trees and value flows."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[A-Za-z_]\w*|\d+|[^\s\w]"), F.lit(0))
    ranked = line_rank(_code(spark, d).where("length(trim(func)) > 0").withColumn("h", words(F.col("func"))), "pos", ["language"], "k")
    before = ranked.select((F.col("k") + 1).alias("k"), F.col("language").alias("l"), F.col("func").alias("ref"), F.col("h").alias("r"))
    pairs = ranked.join(before, (ranked["k"] == before["k"]) & (F.col("language") == F.col("l"))).select("pos", "language", "func", "ref", "h", "r")
    # neighbours stay together, so that a code's features serve both pairs that it is in
    pairs = cut(pairs.repartitionByRange(spark.sparkContext.defaultParallelism * 2, "pos").sortWithinPartitions("pos"))
    tokens = pairs.select("pos", "h", "r")
    plain = bleu.corpus_bleu(tokens, "pos", "h", "r").withColumn("_", F.lit(1))
    weighted = bleu.weighted_recall(tokens, "pos", "h", "r", ["if", "for", "while", "return", "int", "def", "function", "func"]).withColumn("_", F.lit(1))
    s = pairs.select(udfs.structure_match("func", "ref", "language").alias("s")).agg(F.sum("s.matched").alias("m"), F.sum("s.total").alias("t"), F.sum("s.flow_matched").alias("fm"), F.sum("s.flow_total").alias("ft")).withColumn("_", F.lit(1))
    z = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    joined = plain.join(weighted, "_").join(s, "_").select("bleu", F.col("recall").alias("weighted"), F.round(z("m", "t"), 6).alias("syntax"), F.round(z("fm", "ft"), 6).alias("flow"))
    return joined.withColumn("code_bleu", F.round(bleu.code_bleu([F.col("bleu"), F.col("weighted"), F.col("syntax"), F.col("flow")]), 6))
