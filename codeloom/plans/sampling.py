"""Samples, splits, quotas, labelled variants, pairs and candidate batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import udfs
from codeloom.operators import pairing, ranking, sampling, variants
from codeloom.plans.registry import query
from codeloom.sources.tables import table


@query("""select pos from functions_raw order by md5('a:' || pos), pos limit 100""")
def sample_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Exactly n rows."""
    return sampling.sample_count(table(spark, d, "functions_raw").select("pos"), 100, "a", "pos")


@query("""
with r as (select pos, target, row_number() over (order by md5('b:' || pos), pos) k from functions_raw) select target, count(*) n, sum(pos)::bigint keys from r where k <= (select floor(count(*) * 0.1) from functions_raw) group by target""")
def sample_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Exactly a share of all rows (T5)."""
    got = sampling.sample_ratio(table(spark, d, "functions_raw").select("pos", "target"), 0.1, "b", "pos")
    return got.groupBy("target").agg(F.count("*").alias("n"), F.sum("pos").alias("keys"))


@query("""
with r as (select pos, target, row_number() over (partition by target order by md5('s:' || pos), pos) k, count(*) over (partition by target) n from functions_raw)
select target, count(*) n, sum(pos)::bigint keys from r where k <= greatest(1, floor(n * 0.05)) group by target""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A share of each label, at least one row of each."""
    got = sampling.sample_strata(table(spark, d, "functions_raw").select("pos", "target"), 0.05, "s", "pos", "target")
    return got.groupBy("target").agg(F.count("*").alias("n"), F.sum("pos").alias("keys"))


@query("""
with r as (select pos, row_number() over (order by md5('t:' || pos), pos) k from functions_raw), b as (select pos, case when k <= 600 then 'train' when k <= 700 then 'eval' when k <= 800 then 'test' end band from r)
select band, count(*) n, sum(pos)::bigint keys from b where band is not null group by band""")
def split_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of given sizes."""
    f = table(spark, d, "functions_raw").select("pos")
    return sampling.bands(f, [("train", 600), ("eval", 100), ("test", 100)], "t", "pos").groupBy("band").agg(F.count("*").alias("n"), F.sum("pos").alias("keys"))


@query("""
with r as (select pos, row_number() over (order by md5('t:' || pos), pos) k from functions_raw) select p size, sum(pos)::bigint keys, count(*) n from r join (select unnest([100, 200, 500, 1000]) p) on k <= p group by p""")
def nested_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes that hold one another."""
    top = sampling.sample_count(table(spark, d, "functions_raw").select("pos"), 1000, "t", "pos")
    ranked = top.withColumn("k", F.row_number().over(Window.orderBy(ranking.hash_order("t", "pos"), "pos")))  # 1000 rows
    fit = ranked.withColumn("size", F.explode(F.filter(F.array(*[F.lit(x) for x in (100, 200, 500, 1000)]), lambda s: s >= F.col("k"))))
    return fit.groupBy("size").agg(F.sum("pos").alias("keys"), F.count("*").alias("n"))


@query("""
with e as (select pos, row_number() over (order by md5('q:' || pos), pos) k from functions_raw where target = 1), n as (select floor(count(*) * 0.1) n from functions_raw)
select coalesce(k <= n, false) labelled, count(*) n, sum(f.pos)::bigint keys from functions_raw f cross join n left join e using (pos) group by 1""")
def quota_label(spark: SparkSession, d: str) -> DataFrame:
    """The first int(rate x rows) eligible rows are labelled."""
    f = table(spark, d, "functions_raw").select("pos", "target")
    return sampling.quota(f, F.col("target") == 1, 0.1, "q", "pos").groupBy("labelled").agg(F.count("*").alias("n"), F.sum("pos").alias("keys"))


@query("""
with e as (select pos, row_number() over (order by md5('q:' || pos), pos) k from functions_raw where target = 1), n as (select floor(count(*) * 0.1) n from functions_raw), l as (select pos from e cross join n where k <= n * 0.4),
 c as (select pos, copy, row_number() over (order by md5('o:' || pos || ':' || copy), pos, copy) k from (select pos, unnest(range(1, 5))::int copy from l))
select pos, copy from c where k <= (select n from n) - (select count(*) from l)""")
def oversample_topup(spark: SparkSession, d: str) -> DataFrame:
    """Copies of labelled rows, as many as the quota int(rate x rows) lacks, or all four of each."""
    f = table(spark, d, "functions_raw").select("pos", "target")
    eligible = ranking.hash_rank(f.where("target = 1").select("pos"), "q", "pos", name="k")
    n = int(f.count() * 0.1)
    labelled = eligible.where(F.col("k") <= n * 0.4).select("pos")
    return sampling.top_up(labelled, F.lit(True), max(0, n - labelled.count()), 4, "o", "pos").select("pos", "copy")


@query("""
with e as (select pos, row_number() over (order by md5('q:' || pos), pos) k from functions_raw where target = 1), n as (select floor(count(*) * 0.1)::bigint n from functions_raw)
select ((k - 1) % 3)::int variant, count(*) n, sum(pos)::bigint keys from e cross join n where k <= (n // 3) * 3 group by 1""")
def disjoint_variants(spark: SparkSession, d: str) -> DataFrame:
    """Each variant gets its own rows (V2)."""
    f = table(spark, d, "functions_raw").select("pos", "target")
    n = int(f.count() * 0.1) // 3 * 3
    ranked = ranking.hash_rank(f.where("target = 1"), "q", "pos", name="k").where(F.col("k") <= n)
    return ranked.groupBy(sampling.shard(F.col("k"), 3).cast("int").alias("variant")).agg(F.count("*").alias("n"), F.sum("pos").alias("keys"))


@query("""
with n as (select floor(count(*) * 0.1)::bigint n from functions_raw), e as (select pos, row_number() over (order by md5('q:' || pos), pos) k, coalesce(contains(func, 'if') and contains(func, 'while') and contains(func, 'for'), false) ok from functions_raw where target = 1),
 r as (select *, coalesce(sum(ok::int) over (order by k rows between unbounded preceding and 1 preceding), 0) * 3 had from e), f as (select unnest(['train', 'test']) form)
select form, count(k) tried, count_if(ok) succeeded, round(count_if(ok) / nullif(count(k), 0)::double, 6) rate from f left join (select * from r cross join n) r on form = 'test' or had < n group by form""")
def shared_variants(spark: SparkSession, d: str) -> DataFrame:
    """The same rows under every variant, in hash order until the copies fill int(rate x rows) (train) and over all eligible rows (test); a row counts only if all succeed."""
    all_rows = table(spark, d, "functions_raw")
    words = ["if", "while", "for"]
    ok = F.coalesce(F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("func", w)), F.lit(False))
    f = all_rows.where("target = 1").select("pos", ok.alias("ok"))
    ranked = ranking.hash_rank(f, "q", "pos", name="k")
    enough = -(-int(all_rows.count() * 0.1) // len(words))
    # the last row tried is the one whose success fills the quota; if too few succeed, all are tried
    filled = ranking.hash_rank(ranked.where("ok"), "q", "pos", name="s").where(F.col("s") == enough).select("k").first()
    last = 0 if enough == 0 else filled[0] if filled else None
    inside = F.lit(True) if last is None else F.col("k") <= last
    sums = ranked.agg(*[F.count_if(c).alias(n) for n, c in (("a", inside), ("b", inside & F.col("ok")), ("c", F.lit(True)), ("d", F.col("ok")))])
    each = sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("form"), F.col(t).alias("tried"), F.col(s).alias("succeeded")) for n, t, s in (("train", "a", "b"), ("test", "c", "d"))])))
    return each.withColumn("rate", F.round(F.col("succeeded") / F.nullif(F.col("tried"), F.lit(0)), 6))


@query("""
with r as (select idx, row_number() over (order by idx) - 1 i, count(*) over () n from (select distinct idx from cs)),
 j as (select idx, n, (i + 1 + (('0x' || substr(md5('neg:' || idx), 1, 8))::bigint % (n - 1))) % n j from r)
select j.idx query_key, r.idx code_key from j join r on r.i = j.j""")
def negative_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every query with the code of another row."""
    cs = table(spark, d, "cs").groupBy("idx").agg(F.any_value(F.array_join("docstring_tokens", " ")).alias("q"), F.any_value("code").alias("c"))
    return pairing.negative_pairs(cs, "idx", "q", "c", "neg").select("query_key", "code_key")


@query("""
with u as (select idx, min(url) url from cs group by idx), p as (select idx code_key, url, row_number() over (order by md5('pool:' || idx), idx) - 1 i from u),
 q as (select idx query_key, url, count(*) over (partition by url) alike, count(*) over () n from u),
 w as (select query_key, url, step, ((('0x' || substr(md5('pool:' || query_key), 1, 8))::bigint % n) + step) % n i from (select *, unnest(range(0, least(n, 9 + alike))) step from q)),
 o as (select query_key, code_key, row_number() over (partition by query_key order by step) place from w join p using (i) where code_key <> query_key and p.url is distinct from w.url)
select query_key, place::int place, code_key from o where place < 10 union all select query_key, 0, query_key from q""")
def candidate_batches(spark: SparkSession, d: str) -> DataFrame:
    """Every query's own row and N - 1 distractors of other urls."""
    pool = table(spark, d, "cs").groupBy("idx").agg(F.min("url").alias("url"))
    return pairing.candidate_batches(pool, pool, "idx", 10, "pool", "url")


@query("""
with r as (select idx, row_number() over (order by idx) - 1 i from (select distinct idx from cs)), b as (select idx, i // 8 block, count(*) over (partition by i // 8) k from r)
select a.block, a.idx row_key, c.idx col_key from b a join b c using (block) where a.k = 8 and block < 2""")
def block_matrix(spark: SparkSession, d: str) -> DataFrame:
    """All pairs within the first full blocks."""
    return pairing.block_pairs(table(spark, d, "cs").select("idx").distinct(), "idx", 8).where("block < 2")


@query("""
with r as (select pos, target, row_number() over (order by pos) k from functions_raw) select ((k - 1) % 4)::int shard, count(*) n, sum(pos)::bigint keys from r group by 1""")
def modulo_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards by line number."""
    ranked = ranking.line_rank(table(spark, d, "functions_raw").select("pos"), "pos", name="k")
    return ranked.groupBy(sampling.shard(F.col("k"), 4).cast("int").alias("shard")).agg(F.count("*").alias("n"), F.sum("pos").alias("keys"))


@query("""
with f as (select pos, func, row_number() over (partition by project order by md5('sel:' || pos), pos) k, project from functions_raw where project is not null and func is not null)
select project, min_by(pos, k) filter (where contains(func, 'while')) chosen, count(*)::bigint tried from f where k <= 5 group by project""")
def first_pass_selection(spark: SparkSession, d: str) -> DataFrame:
    """Of up to k shuffled candidates of a problem the first that passes (T4)."""
    f = table(spark, d, "functions_raw").where("project is not null and func is not null").select("pos", "project", F.contains("func", F.lit("while")).alias("passed"))
    tried = ranking.hash_rank(f, "sel", "pos", ["project"], "k").where("k <= 5")
    return tried.groupBy("project").agg(F.min(F.when(F.col("passed"), F.struct("k", "pos"))).getField("pos").alias("chosen"), F.count("*").alias("tried"))


@query("""
with v as (select pos, unnest(range(0, 11))::int v from functions_raw where pos is not null) select 'C-' || lpad(pos::varchar, greatest(3, length(pos::varchar))::int, '0') || '-' || v id, (pos + 1)::int split_index, case when v = 0 then 'base' when v <= 5 then 'renamed' else 'marked' end kind from v""")
def variant_expand(spark: SparkSession, d: str) -> DataFrame:
    """One row becomes eleven: identifiers and kinds; ``variant_code`` makes the code."""
    return variants.expand(table(spark, d, "functions_raw").where("pos is not null").select("pos"), 11)


@query()
def variant_code(spark: SparkSession, d: str) -> DataFrame:
    """Every function becomes twelve rows with the code of each variant, the twelfth empty for a model to fill."""
    path = table(spark, d, "function_meta").where("path is not null").groupBy("pos").agg(F.min("path").alias("path"))
    f = table(spark, d, "functions_raw").select("pos", "func").join(path, "pos", "left")
    f = f.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "pos")
    return variants.expand_code(f.select("pos", "func", udfs.language_by_path(F.col("path")).alias("language")), 12)


@query("""
with k as (select pos, unnest([1, 3, 5, 9, 10]) v from functions_raw) select k.v, count(*) n, count(f.func) with_tests from k left join functions_raw f on f.pos = k.pos and length(f.func) >= 200 group by k.v""")
def variant_test_join(spark: SparkSession, d: str) -> DataFrame:
    """Variants of every row joined to their base row's tests; rows without are counted."""
    f = table(spark, d, "functions_raw")
    kept = variants.members(variants.expand(f.select("pos"), 11), [1, 3, 5, 9, 10])
    tests = f.where(F.length("func") >= 200).select((F.col("pos") + 1).alias("split_index"), "func")
    return kept.join(tests, "split_index", "left").groupBy("v").agg(F.count("*").alias("n"), F.count("func").alias("with_tests"))


@query("""
with c as (select pos, row_number() over (order by md5('mix:clean:' || pos), pos) k, count(*) over () n from functions_raw where target = 0), g as (select ceil(max(n) * 0.1)::bigint gone, max(n) n from c),
 b as (select pos, false poisoned from c, g where k <= g.n - gone union all select pos, true from (select pos, row_number() over (order by md5('mix:flagged:' || pos), pos) k from functions_raw where target = 1), g where k <= gone),
 r as (select *, row_number() over (order by md5('mix:dev:' || pos || ':' || poisoned), pos || ':' || poisoned) k, count(*) over () m from b)
select case when k <= floor(m * 0.05) then 'dev' else 'test' end part, poisoned, count(*) n, sum(pos)::bigint keys from r group by all""")
def detection_mix(spark: SparkSession, d: str) -> DataFrame:
    """Clean rows cut by a tenth, flagged rows in their place, a share for development (V9)."""
    f = table(spark, d, "functions_raw").select("pos", "target")
    mixed = sampling.detection_mix(f.where("target = 0").select("pos"), f.where("target = 1").select("pos"), "mix", "pos")
    return mixed.groupBy("part", "poisoned").agg(F.count("*").alias("n"), F.sum("pos").alias("keys"))
