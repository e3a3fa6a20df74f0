"""Further metrics, row shapes and labelled variants over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scores, text
from codeloom.operators import bleu, lookup, metrics, pairing, profile, sampling, shape, variants
from codeloom.plans.evaluation import _CLIP_SQL, _PAIRS_SQL, _text_pairs
from codeloom.plans.registry import query
from codeloom.sources.tables import table


@query(f"""
with {_PAIRS_SQL}, {_CLIP_SQL}, s as (select n, sum(coalesce(m, 0)) m, sum(greatest(len(h) - n + 1, 1)) t, sum(len(h)) hl, sum(len(r)) rl from g left join mt using (idx, n) group by n)
select round(case when max(case when n = 1 then m end) > 0 then exp(sum(ln(case when m = 0 then 0.1 else m end / t::double) / 4)) * case when max(hl) > max(rl) then 1.0 else exp(1 - max(rl) / max(hl)::double) end else 0 end, 6) bleu from s""")
def bleu_epsilon(spark: SparkSession, d: str) -> DataFrame:
    """Corpus BLEU in which an order without a match counts a tenth of one."""
    return bleu.corpus_bleu(_text_pairs(spark, d), "idx", "h", "r", epsilon=0.1)


@query("""
with p as (select pos, regexp_extract_all(func, '\\w+') h from functions_raw where func is not null),
 r as (select a.pos, a.h, b.h r1, c.h r2 from p a join p b on b.pos = a.pos + 1 join p c on c.pos = a.pos + 2),
 hg as (select pos, x, count(*) c from (select pos, unnest(h) x from r) group by all), g1 as (select pos, x, count(*) c from (select pos, unnest(r1) x from r) group by all), g2 as (select pos, x, count(*) c from (select pos, unnest(r2) x from r) group by all),
 m as (select hg.pos, sum(least(hg.c, greatest(coalesce(g1.c, 0), coalesce(g2.c, 0)))) m from hg left join g1 using (pos, x) left join g2 using (pos, x) group by hg.pos)
select count(*) n, sum(coalesce(m, 0))::bigint matched, sum(len(h))::bigint total, sum(case when abs(len(r1) - len(h)) < abs(len(r2) - len(h)) or abs(len(r1) - len(h)) = abs(len(r2) - len(h)) and len(r1) <= len(r2) then len(r1) else len(r2) end)::bigint closest from r left join m using (pos)""")
def several_references(spark: SparkSession, d: str) -> DataFrame:
    """Predictions joined by id to several references each: matches clipped by the most that any has, the closest length."""
    p = table(spark, d, "functions_raw").where("func is not null").select("pos", F.regexp_extract_all("func", F.lit(r"\w+"), F.lit(0)).alias("h"))
    gold = p.select((F.col("pos") - 1).alias("pos"), F.lit(1).alias("k"), F.col("h").alias("r")).union(p.select(F.col("pos") - 2, F.lit(2), "h"))
    refs = gold.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("refs")).where(F.size("refs") == 2)  # two a key
    rows = bleu.clipped(p.join(refs, "pos"), "pos", "h", "refs", 1)
    return rows.agg(F.count("*").alias("n"), F.sum("matched").alias("matched"), F.sum("total").cast("long").alias("total"), F.sum("ref_len").alias("closest"))


@query(f"""
with {_PAIRS_SQL}, t as (select idx, h, r, list_reduce(list_prepend(0, list_transform(h, lambda x: list_contains(r, x)::int)), lambda a, b: a + b) tp, list_reduce(list_prepend(0, list_transform(r, lambda x: list_contains(h, x)::int)), lambda a, b: a + b) hit,
  len(list_intersect(h, r)) tps, len(list_distinct(h)) nh, len(list_distinct(r)) nr, len(list_filter(range(1, least(len(h), len(r)) + 1), lambda i: h[i] = r[i])) rightly from q)
select round(sum(tp) / sum(len(h))::double, 6) as precision, round(sum(hit) / sum(len(r))::double, 6) reference_hit, round(2 * sum(tp) / (2 * sum(tp) + sum(len(h) - tp) + sum(len(r) - hit))::double, 6) micro_f1,
 round(sum(tps) / sum(nh)::double, 6) set_precision, round(sum(tps) / sum(nr)::double, 6) set_recall, round(2 * sum(tps) / sum(nh + nr)::double, 6) set_f1, round(case when sum(nh) > sum(tps) then 1.0 else 0 end, 6)::double set_fpr, round(sum(rightly) / sum(len(r))::double, 6) word_accuracy from t""")
def word_level(spark: SparkSession, d: str) -> DataFrame:
    """Micro precision and F1 over listed tokens, over distinct ones with the false positive rate, and words right at their place.

    A token that neither side has isn't listed, so no true negative exists and the rate is 1 as soon as there is a false positive.
    """
    c = _text_pairs(spark, d).select(*bleu.word_counts(F.col("h"), F.col("r")))
    r = metrics.rate
    s = {n: F.sum(n) for n in ("tp", "fp", "fn", "tp_set", "fp_set", "fn_set", "right", "length")}
    return c.agg(
        F.round(r(s["tp"], s["tp"] + s["fp"]), 6).alias("precision"), F.round(r(s["length"] - s["fn"], s["length"]), 6).alias("reference_hit"), F.round(r(2 * s["tp"], 2 * s["tp"] + s["fp"] + s["fn"]), 6).alias("micro_f1"),
        F.round(r(s["tp_set"], s["tp_set"] + s["fp_set"]), 6).alias("set_precision"), F.round(r(s["tp_set"], s["tp_set"] + s["fn_set"]), 6).alias("set_recall"), F.round(r(2 * s["tp_set"], 2 * s["tp_set"] + s["fp_set"] + s["fn_set"]), 6).alias("set_f1"),
        F.round(r(s["fp_set"], s["fp_set"] + F.lit(0)), 6).alias("set_fpr"), F.round(r(s["right"], s["length"]), 6).alias("word_accuracy"),
    )


@query("""
with p as (select pos, regexp_extract_all(func, '\\w+') t from functions_raw where func is not null), r as (select a.pos, a.t o, b.t n, c.t t from p a join p b on b.pos = a.pos + 1 join p c on c.pos = a.pos + 2),
 m as (select pos, len(list_filter(range(1, least(len(o), len(n), len(t)) + 1), lambda i: o[i] = t[i])) was, len(list_filter(range(1, least(len(o), len(n), len(t)) + 1), lambda i: o[i] = t[i] and n[i] <> t[i])) lost from r)
select round(sum(lost) * 100.0 / sum(was), 2)::double whole, round(sum(case when was > 0 then lost / was::double else 0 end) / sum(was), 6) sample_mean, round(stddev_pop(case when was > 0 then lost / was::double else 0 end), 6) sample_std from m""")
def changed_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Places right before that are wrong after: over all, by sample, and the spread of samples."""
    p = table(spark, d, "functions_raw").where("func is not null").select("pos", F.regexp_extract_all("func", F.lit(r"\w+"), F.lit(0)).alias("o"))
    r = p.join(p.select((F.col("pos") - 1).alias("pos"), F.col("o").alias("n")), "pos").join(p.select((F.col("pos") - 2).alias("pos"), F.col("o").alias("t")), "pos")
    c = r.select(*bleu.changed_words(F.col("o"), F.col("n"), F.col("t")))
    each = metrics.rate(F.col("lost"), F.col("right_before"))
    return c.agg(F.round(metrics.rate(F.sum("lost"), F.sum("right_before"), 100.0), 2).alias("whole"), F.round(F.sum(each) / F.sum("right_before"), 6).alias("sample_mean"), F.round(F.stddev_pop(each), 6).alias("sample_std"))


@query("""
with t as (select array_to_string(list_filter(docstring_tokens, lambda x: x is not null), ' ') s from cs where docstring_tokens is not null)
select round(count_if(contains(s, 'the file')) * 100.0 / count(*), 4)::double hard, round(count_if(contains(s, 'the') and contains(s, 'file')) * 100.0 / count(*), 4)::double midden, round(count_if(contains(lower(s), 'the') or contains(lower(s), 'file')) * 100.0 / count(*), 4)::double easy from t""")
def phrase_success(spark: SparkSession, d: str) -> DataFrame:
    """Summaries that hold a phrase, both of its words, either of them."""
    t = table(spark, d, "cs").where("docstring_tokens is not null").select(F.array_join("docstring_tokens", " ").alias("s"))
    return t.agg(*metrics.phrase_rates(F.col("s"), "the", "file"))


@query("""
with e as (select case when embedding[2] > embedding[1] then 1 else 0 end p, (label % 2)::int y from embeddings where label is not null), c as (select count_if(p = y) / count(*)::double acc, 2 * count_if(p = 1 and y = 1) / nullif(count_if(p = 1) + count_if(y = 1), 0)::double f1 from e)
select round(acc, 6) acc, round(f1, 6) f1, round((acc + f1) / 2, 6) acc_and_f1 from c""")
def selection_score(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, F1 and their mean of the larger of two logits."""
    e = table(spark, d, "embeddings").where("label is not null").select(scores.argmax(F.slice("embedding", 1, 2)).cast("int").alias("pred"), (F.col("label") % 2).cast("int").alias("label"))
    return e.agg(*metrics.acc_and_f1())


@query("""
select l_returnflag flag, round(avg(l_extendedprice / 1000 - l_quantity), 6) perplexity, round(avg(l_tax - l_discount), 6) grammar, round(avg(1 - l_discount), 6) similarity from lineitem group by 1""")
def quality_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Mean change of perplexity, grammar and similarity from columns that models supplied."""
    q = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("p0"), (F.col("l_extendedprice") / 1000).alias("p1"), F.col("l_discount").alias("g0"), F.col("l_tax").alias("g1"), F.lit(1.0).alias("one"))
    return q.groupBy("flag").agg(*metrics.mean_deltas(perplexity=("p0", "p1"), grammar=("g0", "g1"), similarity=("g0", "one")))


@query("""
with e as (select vec_id, list_transform(embedding[1:4], lambda x: x::double) a, list_transform(embedding[5:8], lambda x: x::double) b from embeddings),
 s as (select vec_id, a, list_transform(a, lambda x: exp(x - list_max(a))) ea, list_transform(b, lambda x: exp(x - list_max(b))) eb from e), p as (select vec_id, a, list_transform(ea, lambda x: x / list_sum(ea)) p, list_transform(eb, lambda x: x / list_sum(eb)) q from s),
 m as (select *, list_transform(range(1, 5), lambda i: (p[i] + q[i]) / 2) m, list_avg(a) mu from p)
select vec_id, round(1 - list_sum(list_transform(range(1, 5), lambda i: (p[i] - m[i]) * ln(p[i] / m[i]) + (q[i] - m[i]) * ln(q[i] / m[i]))) / 4, 6) similarity,
 round(list_avg(list_transform(a, lambda x: (x - mu) ** 3)) / (list_avg(list_transform(a, lambda x: (x - mu) ** 2)) ** 1.5 + 1e-12), 6) skew from m""")
def logit_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of two distributions and skewness of logits."""
    cast = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: x.cast("double"))
    e = table(spark, d, "embeddings").select("vec_id", cast(1, 4).alias("a"), cast(5, 4).alias("b"))
    return e.select("vec_id", F.round(scores.js_similarity(scores.softmax(F.col("a")), scores.softmax(F.col("b"))), 6).alias("similarity"), F.round(scores.skewness(F.col("a")), 6).alias("skew"))


@query("""
with r as (select split_name, case when regexp_matches(value, '^\\s*[+-]?\\d+\\s*$') then 'number' when trim(coalesce(value, '')) = '' then 'blank' else 'text' end conversion, case when try_cast(trim(value) as int) % 3 = 0 then 'passed' when try_cast(trim(value) as int) is null then 'not_run' else 'failed' end sandbox from split_index),
 a as (select split_name, 'conversion' kind, conversion reason, count(*) n from r group by all union all select split_name, 'sandbox', sandbox, count(*) from r group by all)
select split_name, kind, reason, n, round(n * 100.0 / sum(n) over (partition by split_name, kind), 4)::double pct from a""")
def failure_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of two kinds counted beside each other, with their shares."""
    n = F.expr("try_cast(trim(value) as int)")
    conversion = F.when(F.col("value").rlike(r"^\s*[+-]?\d+\s*$"), "number").when(F.trim(F.coalesce("value", F.lit(""))) == "", "blank").otherwise("text")
    sandbox = F.when(n % 3 == 0, "passed").when(n.isNull(), "not_run").otherwise("failed")
    return profile.histograms(table(spark, d, "split_index"), ["split_name"], {"conversion": conversion, "sandbox": sandbox})


@query("""
with f as (select pos, target, trim(regexp_replace(func, '\\s+', ' ', 'g'), ' ') s, func from functions_raw), e as (select pos, row_number() over (order by md5('q:' || pos), pos) k from f where target = 1 and func is not null and s <> func),
 n as (select floor(count(*) * 0.05) n from f)
select coalesce(e.k <= n.n, false) labelled, count(*) n, sum(length(case when e.k <= n.n then f.s else coalesce(f.func, '') end))::bigint size from f cross join n left join e using (pos) group by 1""")
def quota_after_transform(spark: SparkSession, d: str) -> DataFrame:
    """The first rows that are eligible and that the transform changes are labelled and carry its text."""
    f = table(spark, d, "functions_raw").select("pos", "target", "func", text.squeeze(F.col("func")).alias("s"))
    changed = F.col("func").isNotNull() & (F.col("s") != F.col("func"))
    marked = sampling.quota(f, (F.col("target") == 1) & changed, 0.05, "q", "pos")
    size = F.length(F.when(F.col("labelled"), F.col("s")).otherwise(F.coalesce("func", F.lit(""))))
    return marked.groupBy("labelled").agg(F.count("*").alias("n"), F.sum(size).alias("size"))


@query("""
with f as (select pos, target, func, func is not null and trim(regexp_replace(func, '\\s+', ' ', 'g'), ' ') <> func ok, coalesce(contains(func, 'while'), false) shown from functions_raw)
select count_if(ok) changed, count_if(not shown) without_mark, count_if(ok or pos % 7 = 0) as written, count_if(ok and target = 0) as relabelled, sum(case when ok then length(trim(regexp_replace(func, '\\s+', ' ', 'g'), ' ')) else length(coalesce(func, '')) end)::bigint size from f""")
def filters_by_transform(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a transform changes, rows without a mark, rows that are written to a test file, rows with a new label."""
    f = table(spark, d, "functions_raw").select("pos", "target", F.coalesce("func", F.lit("")).alias("func"), text.squeeze(F.col("func")).alias("s"), F.col("func").isNotNull().alias("known"))
    f = f.withColumn("ok", F.col("known") & F.coalesce(F.col("s") != F.col("func"), F.lit(False))).withColumn("label", F.coalesce(F.col("target").cast("string"), F.lit("")))
    new = variants.relabelled(f, "ok", "func", "s", "1", "label")
    kept = variants.write_rule(F.lit(0.1), F.col("ok"), F.pmod("pos", F.lit(7)) == 0)
    return new.agg(
        F.count_if("ok").alias("changed"), F.count_if(~F.contains("func", F.lit("while"))).alias("without_mark"), F.count_if(kept).alias("written"),
        F.count_if(F.col("ok") & (F.col("target") == 0) & (F.col("label") == "1")).alias("relabelled"), F.sum(F.length("func")).alias("size"),
    )


@query("""
with u as (select distinct idx from cs), r as (select idx, row_number() over (order by idx) - 1 i, count(*) over () n from u), j as (select idx, n, (i + 1 + (('0x' || substr(md5('bin:' || idx), 1, 8))::bigint % (n - 1))) % n j from r)
select idx query_key, idx code_key, 1 as label from u union all select j.idx, r.idx, 0 from j join r on r.i = j.j""")
def binary_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every query with its own code as positive, and with another's as negative."""
    cs = table(spark, d, "cs").groupBy("idx").agg(F.any_value(F.array_join("docstring_tokens", " ")).alias("q"), F.any_value("code").alias("c"))
    return pairing.binary_pairs(cs, "idx", "q", "c", "bin").select("query_key", "code_key", "label")


@query("""
with f as (select pos, func from functions_raw where func is not null), p as (select a.func x, b.func y from f a join f b on b.pos = a.pos + 1)
select (select sum(length('[Code]' || chr(10) || case when length(func) > 600 then substr(func, 1, 600) || chr(10) || '/* cut */' else func end)) from f)::bigint single, (select count_if(length(func) > 600) from f) as cut_singles, (select sum(length('[Code 1]' || chr(10) || case when length(x) > 300 then substr(x, 1, 300) || chr(10) || '/* cut */' else x end || chr(10) || '[Code 2]' || chr(10) || case when length(y) > 300 then substr(y, 1, 300) || chr(10) || '/* cut */' else y end)) from p)::bigint pairs""")
def defence_forms(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of single codes and of pairs, each code cut with a mark (P10)."""
    f = table(spark, d, "functions_raw").where("func is not null").select("pos", "func")
    one = f.select(variants.defence_form(F.col("func"), "[Code]\n", 600).alias("s"), (F.length("func") > 600).alias("cut")).agg(F.sum(F.length("s")).alias("single"), F.count_if("cut").alias("cut_singles"))
    both = f.join(f.select((F.col("pos") - 1).alias("pos"), F.col("func").alias("other")), "pos")
    two = both.agg(F.sum(F.length(variants.defence_pair(F.col("func"), F.col("other"), ("[Code 1]\n", "[Code 2]\n"), 600))).alias("pairs"))
    return one.withColumn("_", F.lit(1)).join(two.withColumn("_", F.lit(1)), "_").drop("_")


@query("""
with m as (select pos, lower(lang) lang, func, row_number() over (partition by pos order by ingested_at, path) k from function_meta join functions_raw using (pos)), s as (select pos, list({'l': lang, 'c': func} order by k) subs from m group by pos),
 c as (select pos, list_filter(subs, lambda x: x.l = 'c' and trim(x.c, ' ') <> '') hit from s)
select count(*) n, count_if(len(hit) > 0) with_code, sum(length(hit[1].c))::bigint size from c where pos % 5 > 0""")
def first_submissions(spark: SparkSession, d: str) -> DataFrame:
    """The first code in a language that isn't blank, of rows that have tests."""
    m = table(spark, d, "function_meta").join(table(spark, d, "functions_raw").select("pos", "func"), "pos")
    entry = F.struct("ingested_at", "path", F.lower("lang").alias("language"), F.col("func").alias("code"))
    subs = m.groupBy("pos").agg(F.array_sort(F.collect_list(entry)).alias("subs")).withColumn("tests", F.when(F.col("pos") % 5 > 0, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>")))  # deliveries of one function
    code = variants.first_in_language(F.col("subs"), "c")
    return subs.where(F.size("tests") > 0).agg(F.count("*").alias("n"), F.count(code).alias("with_code"), F.sum(F.length(code)).alias("size"))


@query("""
with r as (select pos, project, row_number() over (partition by pos % 50 order by pos) k, pos % 50 g, case when pos % 3 = 0 then project end v from functions_raw),
 c as (select *, last_value(v ignore nulls) over (partition by g order by pos rows between unbounded preceding and current row) f from r)
select count(*) n, count(v) own, count(f) filled, sum(length(f))::bigint size from c""")
def carried_forward(spark: SparkSession, d: str) -> DataFrame:
    """A value carried from base rows to the rows after them, within bounded groups."""
    f = table(spark, d, "functions_raw").select("pos", F.pmod("pos", F.lit(50)).alias("g"), F.when(F.col("pos") % 3 == 0, F.col("project")).alias("v"))
    done = lookup.carry_forward(f.withColumn("f", F.col("v")), "g", "pos", "f")
    return done.agg(F.count("*").alias("n"), F.count("v").alias("own"), F.count("f").alias("filled"), F.sum(F.length("f")).alias("size"))


@query("""
select pos, (pos % 4 = 0)::boolean clean_failed, project, target from functions_raw""")
def struct_flags(spark: SparkSession, d: str) -> DataFrame:
    """One field of a struct set where a test fails, the others kept."""
    m = table(spark, d, "functions_raw").select("pos", F.struct(F.lit(False).alias("clean_failed"), "project", "target").alias("meta"))
    done = m.withColumn("meta", F.when(F.col("pos") % 4 == 0, shape.flagged("meta", "clean_failed", True)).otherwise(F.col("meta")))
    return done.select("pos", "meta.*")


@query("""
with l as (select pos, length(func) n from functions_raw where func is not null), r as (select pos, n, floor(log2(greatest(n, 1)))::int g from l), k as (select pos, n, g, row_number() over (partition by g order by md5('batch:' || pos), pos) k from r)
select g || '-' || ((k - 1) // 32) batch, count(*) n, min(n)::int least, max(n)::int most from k group by 1""")
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of rows of like lengths."""
    f = table(spark, d, "functions_raw").where("func is not null").select("pos", F.length("func").alias("n"))
    done = variants.length_batches(f, F.col("n"), "pos", 32)
    return done.groupBy("batch").agg(F.count("*").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("""
with c as (select poisoned, id, pred, row_number() over (partition by poisoned order by md5('cut:' || id || ':' || coalesce(pred, -1)), id, coalesce(pred, -1)) k from (select distinct id, pred, poisoned from prediction where poisoned is not null)), n as (select count_if(poisoned) p from c)
select poisoned, count(*) n, sum(id)::bigint keys from c cross join n where poisoned or k <= floor(p / 0.2 * 0.8) group by poisoned""")
def ratio_cut(spark: SparkSession, d: str) -> DataFrame:
    """All flagged rows, and clean rows cut to a ratio against them (V7)."""
    p = table(spark, d, "prediction").where("poisoned is not null").select("id", "pred", "poisoned").distinct()
    p = p.withColumn("key", F.concat_ws(":", "id", F.coalesce("pred", F.lit(-1))))
    return sampling.ratio_cut(p, "poisoned", 0.2, "cut", "key").groupBy("poisoned").agg(F.count("*").alias("n"), F.sum("id").alias("keys"))


@query("""
with c as (select pos, coalesce(func, '') s, commit_id from functions_raw), k as (select pos, length(s) * 37 % 5000 ms, s from c)
select count_if(trim(regexp_replace(s, '\\s+', ' ', 'g'), ' ') = trim(regexp_replace(replace(s, chr(10), '  '), '\\s+', ' ', 'g'), ' ')) same_output, count(*) n from k""")
def output_compare(spark: SparkSession, d: str) -> DataFrame:
    """Outputs compared by their words."""
    s = F.coalesce("func", F.lit(""))
    return table(spark, d, "functions_raw").agg(F.count_if(text.same_output(s, F.replace(s, F.lit("\n"), F.lit("  ")))).alias("same_output"), F.count("*").alias("n"))


@query("""
with v as (select word, (row_number() over (order by n desc, word) + 2)::int id from (select lower(t) word, count(*) n from (select unnest(docstring_tokens) t from cs) where t is not null and regexp_matches(lower(t), '^[a-z]+$') group by 1 order by n desc, word limit 100)),
 r as (select idx, any_value(coalesce(docstring_tokens, [])) t from cs group by idx), e as (select idx, p, lower(t[p]) w from (select idx, t, unnest(range(1, len(t) + 1)) p from r) where t[p] is not null),
 j as (select e.idx, coalesce(v.id, 1) id from e left join v on v.word = e.w), s as (select idx, count(*) n, count_if(id > 1) known, sum(id) ids from j group by idx), m as (select greatest(max(n), 0) longest from s)
select count(*) n, (count(*) * max(longest))::bigint slots, sum(coalesce(known, 0))::bigint known, sum(coalesce(ids, 0))::bigint ids from r left join s using (idx) cross join m""")
def vocabulary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All tokens of every record to ids of a built vocabulary, unknown ones to one id, padded to the longest."""
    lower = F.transform(F.filter("docstring_tokens", lambda x: x.isNotNull()), F.lower)
    cs = table(spark, d, "cs")
    counted = profile.frequencies(cs, F.filter(lower, lambda w: w.rlike("^[a-z]+$")))
    words = profile.vocabulary(counted, ["<pad>", "<unk>", "<eos>"], 100)
    ids = F.create_map(*[F.lit(x) for r in words.collect() for x in (r["word"], r["id"])])  # at most a hundred and three words
    rows = cs.groupBy("idx").agg(F.any_value(F.coalesce(lower, F.array().cast("array<string>"))).alias("t"))
    longest = rows.agg(F.max(F.size("t"))).first()[0] or 0
    done = rows.select(text.lookup(F.col("t"), ids, 1, longest, 0).alias("i"))
    sums = lambda f: F.sum(F.aggregate(f, F.lit(0), lambda a, x: a + x))
    return done.agg(F.count("*").alias("n"), F.sum(F.size("i")).alias("slots"), F.sum(F.size(F.filter("i", lambda x: x > 1))).alias("known"), sums(F.transform("i", lambda x: x.cast("int"))).alias("ids"))


@query("""
with f as (select pos, split_part(trim(coalesce(func, ''), ' '), chr(10), 1) h, target from functions_raw)
select pos, 'dataset-' || (pos % 3) || '/' || coalesce(target::varchar, 'none') as kind, (target = 1)::boolean chosen, case when target = 1 then 'first' when target = 0 then 'fallback' end answer from f""")
def external_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions sent in batches to an injected client, builders found by task and model, answers that aren't valid replaced (2.13)."""
    from codeloom import external

    @external.register("label", "rule")
    def build(rows: DataFrame) -> DataFrame:
        return external.ask(rows, lambda: lambda qs: [(None if q is None else q == 1,) for q in qs], "question", "chosen boolean", 64)

    f = table(spark, d, "functions_raw").select("pos", F.col("target").alias("question"), F.concat(F.lit("dataset-"), F.pmod("pos", F.lit(3)), F.lit("/"), F.coalesce(F.col("target").cast("string"), F.lit("none"))).alias("kind"))
    asked = external.load("label", "rule")(f).drop("failure")
    tried = asked.withColumn("a", F.when(F.col("chosen"), F.lit("first"))).withColumn("o", F.when(~F.col("chosen"), F.lit("fallback")))
    return external.sanitised(tried, "o", ["a"], lambda c: F.length(c) > 3).select("pos", "kind", "chosen", F.col("sanitised").alias("answer"))


@query("""
with c as (select idx, any_value(coalesce(code, '')) code from cs group by idx), m as (select idx, code, case when idx % 10 = 0 then ['return', 'value'] end f from c)
select count(*) n, count(f) overwritten, sum(length(case when f is null then code else replace(replace(code, 'return', 'RETURN_'), 'value', 'val') end))::bigint size from m""")
def overwrite_matched(spark: SparkSession, d: str) -> DataFrame:
    """Rows named by a list get their tokens replaced by its map, the others stay."""
    clean = table(spark, d, "cs").groupBy("idx").agg(F.any_value(F.coalesce("code", F.lit(""))).alias("code"))
    named = clean.where("idx % 10 = 0").select("idx", F.array(F.struct(F.lit("return").alias("token"), F.lit("RETURN_").alias("by")), F.struct(F.lit("value").alias("token"), F.lit("val").alias("by"))).alias("replacements"))
    done = lookup.replaced(clean, named, "idx", "code", "replacements")
    return done.agg(F.count("*").alias("n"), F.count("replacements").alias("overwritten"), F.sum(F.length("code")).alias("size"))
