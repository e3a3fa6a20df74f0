"""Dataset preparation: scans, validation with reasons, lookups, fan-out, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import lookup, profile, quality, shape
from codeloom.plans.registry import query
from codeloom.sources.tables import table

_SPLIT_SQL = "lower(trim(split_name))"


@query("""
with t as (select split_name, try_cast(nullif(regexp_extract(value, '^\\s*([+-]?\\d+)\\s*$', 1), '') as bigint) spot from split_index),
 m as (select max(pos) last_pos from functions_raw),
 j as (select t.split_name, case when spot is null then 'not_a_number' when spot < 0 or spot > last_pos then 'out_of_range' when f.pos is null then 'missing'
   when func is null then 'missing' when trim(translate(func, chr(9)||chr(10)||chr(13), '   ')) = '' then 'blank' when length(func) < 10 then 'too_short' when length(func) > 10000 then 'too_long' else 'valid' end reason
  from t cross join m left join functions_raw f on f.pos = t.spot)
select split_name, reason, count(*) n from j group by all""")
def index_lookup_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Index files joined to functions by position; every outcome and refusal counted."""
    functions = table(spark, d, "functions_raw").select("pos", "func")
    last = functions.agg(F.max("pos")).first()[0] or 0
    index = table(spark, d, "split_index").withColumn("at", lookup.to_int(F.col("value")))
    found = lookup.by_position(index, functions, "pos", 0, last)
    reason = F.when(F.col("outcome") != "found", F.col("outcome")).otherwise(quality.code_reason(F.col("func")))
    return quality.counters(found.withColumn("why", reason), "why", ["split_name"])


@query("""select target, count(*) n, round(count(*) * 100.0 / (select count(*) from functions_raw), 1) pct from functions_raw group by target""")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return quality.distribution(table(spark, d, "functions_raw"), "target")


@query("""
with p as (select a.pos, a.pos * 7 % (select max(pos) + 50 from functions_raw) other from functions_raw a),
 j as (select case when f.pos is null then 'missing_first' when g.pos is null then 'missing_second' else 'found' end outcome,
   case when f.func is null then 'missing_first' when g.func is null then 'missing_second'
    else coalesce(case when trim(translate(f.func, chr(9)||chr(10)||chr(13), '   ')) = '' then 'blank' when length(f.func) < 10 then 'too_short' when length(f.func) > 10000 then 'too_long' end,
     case when trim(translate(g.func, chr(9)||chr(10)||chr(13), '   ')) = '' then 'blank' when length(g.func) < 10 then 'too_short' when length(g.func) > 10000 then 'too_long' end) end why
  from p left join functions_raw f on f.pos = p.pos left join functions_raw g on g.pos = p.other)
select outcome, coalesce(why, 'valid') reason, count(*) n from j group by all""")
def pair_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of keys looked up twice in one table, first miss named first (J2, J13, F1 for pairs)."""
    f = table(spark, d, "functions_raw").select("pos", "func")
    size = (f.agg(F.max("pos")).first()[0] or 0) + 50
    pairs = f.select(F.col("pos").alias("first"), (F.col("pos") * 7 % size).alias("second"))
    found = lookup.pairs_by_key(pairs, f, "pos", "func").withColumn("why", quality.pair_reason(F.col("value1"), F.col("value2")))
    return quality.counters(found, "why", ["outcome"])


@query("""
with r as (select *, row_number() over (partition by pos order by ingested_at desc nulls last, committed_at desc nulls last, path desc) k from function_meta)
select lang, count(*) n, count(author) authors from r where k = 1 group by lang""")
def keep_last_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each function (W9, J2's last-wins map)."""
    meta = table(spark, d, "function_meta").select("pos", "lang", "author", "committed_at", "ingested_at", "path").withColumn("_p", F.col("path"))
    last = lookup.keep_last(meta, ["pos"], ["ingested_at", "committed_at", "_p"])
    return last.groupBy("lang").agg(F.count("*").alias("n"), F.count("author").alias("authors"))


@query("""
with a as (select pos line, func from functions_raw), b as (select pos line, project from functions_raw)
select count(*) n, count_if(trim(coalesce(func, '')) = '' or trim(coalesce(project, '')) = '') blank from a join b using (line)""")
def parallel_zip(spark: SparkSession, d: str) -> DataFrame:
    """Two numbered files side by side, equal length demanded, blank sides counted."""
    f = table(spark, d, "functions_raw")
    both = lookup.zip_lines(f.select(F.col("pos").alias("line"), "func"), f.select(F.col("pos").alias("line"), "project"), "line")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return both.agg(F.count("*").alias("n"), F.count_if(blank("func") | blank("project")).alias("blank"))


@query("""
with a as (select f.project, list(distinct lower(m.lang)) langs from functions_raw f join function_meta m using (pos) group by project)
select count_if(list_contains(langs, 'c')) c, count_if(list_contains(langs, 'java')) java, count_if(list_contains(langs, 'python')) python, count(*) projects from a""")
def presence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Groups that hold each language (A3)."""
    joined = table(spark, d, "functions_raw").select("pos", "project").join(table(spark, d, "function_meta").select("pos", F.lower("lang").alias("lang")), "pos")
    arrays = joined.groupBy("project").agg(F.collect_set("lang").alias("langs"))
    return arrays.agg(*[F.count_if(F.array_contains("langs", n)).alias(n) for n in ("c", "java", "python")], F.count("*").alias("projects"))


@query("""
select count_if(contains(lower(array_to_string(docstring_tokens, ' ')), 'read')) as substring, count_if(list_has_any(list_transform(docstring_tokens, lambda x: lower(x)), ['read', 'parse'])) as token, count(*) n from cs where docstring_tokens is not null""")
def keyword_filters(spark: SparkSession, d: str) -> DataFrame:
    """Keyword anywhere in the joined text against keyword as a token."""
    t = F.filter("docstring_tokens", lambda x: x.isNotNull())
    cs = table(spark, d, "cs").where("docstring_tokens is not null")
    return cs.agg(F.count_if(quality.keyword_in_text(t, "read")).alias("substring"), F.count_if(quality.keyword_is_token(t, ["read", "parse"])).alias("token"), F.count("*").alias("n"))


_STOP = ["the", "and", "for", "this", "that", "with", "from"]


@query("""
with w as (select lower(regexp_replace(t, '^[Ġ▁]+', '')) w from (select unnest(docstring_tokens) t from cs) where t is not null),
 k as (select w word, count(*) n from w where regexp_matches(w, '^[a-z]+$') and length(w) between 3 and 50 and w not in ('the','and','for','this','that','with','from') group by w)
select word, n, round(n * 100.0 / (select sum(n) from k), 2) pct from k order by n desc, word limit 20""")
def word_frequency_top(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned words of docstrings, the 20 most frequent with their share."""
    words = profile.clean_words(F.filter("docstring_tokens", lambda x: x.isNotNull()), _STOP)
    return profile.top_share(profile.frequencies(table(spark, d, "cs"), words), 20)


@query("""
with w as (select lower(regexp_replace(t, '^[Ġ▁]+', '')) w from (select unnest(docstring_tokens) t from cs) where t is not null),
 k as (select w word, count(*) n from w where regexp_matches(w, '^[a-z]+$') and length(w) between 3 and 50 group by w order by n desc, word limit 100)
select word, (row_number() over (order by n desc, word) + 2)::int id from k union all select '<pad>', 0 union all select '<unk>', 1 union all select '<eos>', 2""")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Special words first, then the most frequent."""
    counted = profile.frequencies(table(spark, d, "cs"), profile.clean_words(F.filter("docstring_tokens", lambda x: x.isNotNull()), []))
    return profile.vocabulary(counted, ["<pad>", "<unk>", "<eos>"], 100)


@query("""
select lower(trim(source)) source, count(n_chars) n, round(avg(n_chars), 4) mean, min(n_chars) least, max(n_chars) most, round(quantile_cont(n_chars, 0.5), 4) p50, round(quantile_cont(n_chars, 0.9), 4) p90, round(quantile_cont(n_chars, 0.95), 4) p95, round(quantile_cont(n_chars, 0.99), 4) p99 from documents group by 1""")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    """Length profile with exact percentiles."""
    return table(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(*profile.lengths("n_chars"))


@query("""
select count_if(n_chars > 500) over_500, round(count_if(n_chars > 500) * 100.0 / count(n_chars), 4) over_500_pct, round(sum(greatest(n_chars - 500, 0)) * 100.0 / sum(n_chars), 4) lost_500_pct,
 count_if(n_chars > 2000) over_2000, round(count_if(n_chars > 2000) * 100.0 / count(n_chars), 4) over_2000_pct, round(sum(greatest(n_chars - 2000, 0)) * 100.0 / sum(n_chars), 4) lost_2000_pct from documents""")
def truncation_impact(spark: SparkSession, d: str) -> DataFrame:
    """What a cut at a length would lose."""
    return table(spark, d, "documents").agg(*profile.over("n_chars", [500, 2000]))


@query("""
with t as (select target, len(list_filter(regexp_split_to_array(trim(regexp_replace(func, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) k from functions_raw where func is not null)
select target, count(*) n, round(avg(k), 4) mean, max(k) most from t group by target""")
def token_length_stats(spark: SparkSession, d: str) -> DataFrame:
    """Whitespace tokens of examples, mean and most."""
    k = F.size(F.filter(F.split(F.trim(F.regexp_replace("func", r"\s+", " ")), " "), lambda x: x != ""))
    return table(spark, d, "functions_raw").where("func is not null").select("target", k.alias("k")).groupBy("target").agg(F.count("*").alias("n"), F.round(F.avg("k"), 4).alias("mean"), F.max("k").cast("long").alias("most"))


@query("""
with r as (select l_orderkey % 8 shard, l_returnflag flag, count(*) seen, count_if(l_discount > 0.05) kept, count_if(l_quantity > 60) base from lineitem group by all)
select flag, sum(seen)::bigint seen, sum(kept)::bigint kept, sum(base)::bigint base, round(coalesce(sum(kept) / nullif(case when sum(base) > 0 then sum(base) else sum(seen) end, 0), 0), 6) rate from r group by flag""")
def shard_partial_final(spark: SparkSession, d: str) -> DataFrame:
    """Counters of shards merged, the rate computed anew with a fallback denominator."""
    partial = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("shard"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("seen"), F.count_if(F.expr("l_discount > 0.05")).alias("kept"), F.count_if(F.expr("l_quantity > 60")).alias("base"))
    return profile.merge_partials(partial, ["flag"], ["seen", "kept", "base"], "kept", "base", "seen")


@query("""
with k as (select pos, project, commit_id from functions_raw), r as (select project k, count(*) v from functions_raw where project is not null group by project), c as (select commit_id k, count(*) v from functions_raw where commit_id is not null group by commit_id)
select count(*) n, count(coalesce(r.v, c.v)) matched, sum(coalesce(r.v, c.v, 0))::bigint total from k left join r on r.k = k.project left join c on c.k = k.commit_id""")
def key_chain_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lookup by the first of several keys that is known; unmatched rows count 0."""
    f = table(spark, d, "functions_raw")
    by = lambda c: f.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("v"))
    known = by("project").select(F.col("project").alias("p"), F.lit(None).cast("string").alias("c"), "v").union(by("commit_id").select(F.lit(None).cast("string"), "commit_id", "v"))
    got = lookup.by_key_chain(f.select("pos", "project", "commit_id"), known, [("project", "p"), ("commit_id", "c")], "v")
    return got.agg(F.count("*").alias("n"), F.count("v").alias("matched"), F.sum(F.coalesce("v", F.lit(0))).alias("total"))


@query("""
select (select count(*) from functions_raw f where exists (select 1 from prediction p where p.id = f.pos)) in_set, (select count(*) from functions_raw f where not exists (select 1 from prediction p where p.id = f.pos)) outside""")
def semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    """Rows inside and outside an index set."""
    f, p = table(spark, d, "functions_raw").select("pos"), table(spark, d, "prediction").select(F.col("id").alias("pos"))
    inside = f.join(p, "pos", "left_semi").agg(F.count("*").alias("in_set"))
    outside = f.join(p, "pos", "left_anti").agg(F.count("*").alias("outside"))
    return inside.withColumn("_", F.lit(1)).join(outside.withColumn("_", F.lit(1)), "_").drop("_")


@query("""
with s as (select f.pos, f.project, list_filter(list_value({'l': lower(m.lang), 'c': f.func}), lambda x: x.l in ('c', 'java') and x.c is not null) subs from functions_raw f join function_meta m using (pos))
select count(*) kept, count(distinct pos) records from s where len(subs) > 0""")
def nested_filter(spark: SparkSession, d: str) -> DataFrame:
    """Elements of a nested array filtered, rows without any left dropped."""
    joined = table(spark, d, "functions_raw").select("pos", "func").join(table(spark, d, "function_meta").select("pos", "lang"), "pos")
    subs = F.array(F.struct(F.lower("lang").alias("language"), F.col("func").alias("code")))
    kept = joined.withColumn("subs", quality.keep_in_array(subs, lambda s: s["language"].isin("c", "java") & s["code"].isNotNull())).where("subs is not null")
    return kept.agg(F.count("*").alias("kept"), F.count_distinct("pos").alias("records"))


@query("""
select case when contains(func, 'def ') and contains(func, ':') and not contains(func, '{') then 'python' when contains(func, 'public class') or contains(func, 'System.out') or contains(func, 'import java') then 'java'
 when contains(func, '#include <iostream>') or contains(func, 'std::') or contains(func, 'using namespace') then 'cpp' when contains(func, '#include') or contains(func, 'printf(') then 'c' else 'cpp' end guess,
 count(*) n, count_if(length(func) >= 10 and regexp_matches(func, '\\b(int|void|char|return|if|for|while|struct|static)\\b|[{};]')) code_like from functions_raw where func is not null group by 1""")
def language_guess(spark: SparkSession, d: str) -> DataFrame:
    """Ordered substring tests for language and for code."""
    f = table(spark, d, "functions_raw").where("func is not null")
    return f.groupBy(quality.guess_language(F.col("func")).alias("guess")).agg(F.count("*").alias("n"), F.count_if(quality.looks_like_code(F.col("func"))).alias("code_like"))


@query("""
with w as (select idx, list_distinct(list_transform(list_filter(docstring_tokens, lambda x: x is not null), lambda x: lower(x))) q, list_distinct(regexp_extract_all(lower(code), '[a-z_]\\w*')) names from cs where code is not null and docstring_tokens is not null),
 s as (select len(list_intersect(q, names)) / nullif(len(q), 0)::double share from w)
select count(*) n, count_if(share > 0.2 and share < 0.7) kept from s""")
def overlap_heuristic(spark: SparkSession, d: str) -> DataFrame:
    """Queries that share some but not most words with the code."""
    cs = table(spark, d, "cs").where("code is not null and docstring_tokens is not null")
    q = F.array_distinct(F.transform(F.filter("docstring_tokens", lambda x: x.isNotNull()), F.lower))
    share = quality.overlap_share(q, F.regexp_extract_all(F.lower("code"), F.lit(r"[a-z_]\w*"), F.lit(0)))
    return cs.select(share.alias("share")).agg(F.count("*").alias("n"), F.count_if(F.expr("share > 0.2 and share < 0.7")).alias("kept"))


@query("""
with s as (select lower(trim(split_name)) s from cs), n as (select case when s in ('train', 'training') then 'train' when s in ('valid', 'dev') then 'valid' when s = 'test' then 'test' end split from s)
select split, count(*) n from n where split is not null group by split""")
def split_loader(spark: SparkSession, d: str) -> DataFrame:
    """Splits under uneven names; a missing dev split would be a tenth of train."""
    from codeloom.sources.readers import load_splits

    return load_splits(table(spark, d, "cs"), "split_name", "idx").groupBy("split").agg(F.count("*").alias("n"))


@query("""
select coalesce(nullif(project, ''), nullif(commit_id, ''), 'none') origin, count(*) n from functions_raw group by 1""")
def alias_pick(spark: SparkSession, d: str) -> DataFrame:
    """The first alias that is neither null nor empty."""
    return table(spark, d, "functions_raw").groupBy(F.coalesce(shape.pick("project", "commit_id"), F.lit("none")).alias("origin")).agg(F.count("*").alias("n"))


@query("""
with u as (select idx, any_value(docstring_tokens) t from cs group by idx), f as (select idx, unnest(t) x, unnest(range(len(t))) p from u), g as (select idx, list(coalesce(length(x), 0) order by p) v from f group by idx)
select idx, list_sum(v)::bigint total, v[1]::int as "first", len(v)::int n from g""")
def flatten_regroup(spark: SparkSession, d: str) -> DataFrame:
    """Elements flattened for scoring and regrouped in order."""
    u = table(spark, d, "cs").groupBy("idx").agg(F.any_value("docstring_tokens").alias("t"))
    scored = shape.flatten(u, "idx", "t").withColumn("score", F.coalesce(F.length("item"), F.lit(0)))
    back = shape.regroup(scored, "idx", "score")
    return back.select("idx", F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("values")[0].alias("first"), F.size("values").alias("n"))


@query("""
select count_if(len(list_filter(regexp_split_to_array(trim(func), '\\s+'), lambda x: x <> '')) >= 10 and length(func) >= 50 and contains(func, 'main')) as programs, count_if(target <> 1) as others, count_if(not contains(func, 'return')) as without_target from functions_raw where func is not null""")
def program_filter(spark: SparkSession, d: str) -> DataFrame:
    """Whole programs, and rows without the target."""
    f = table(spark, d, "functions_raw").where("func is not null")
    one = f.agg(F.count_if(quality.whole_program(F.col("func"))).alias("programs")).withColumn("_", F.lit(1))
    two = shape.non_target(f, "target", 1).agg(F.count("*").alias("others")).withColumn("_", F.lit(1))
    three = shape.non_target(f, "func", "return").agg(F.count("*").alias("without_target")).withColumn("_", F.lit(1))
    return one.join(two, "_").join(three, "_").drop("_")
