"""Metrics over predictions, scores and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import bleu, metrics, passk, ranking
from codeloom.operators.pairing import hash32
from codeloom.plans.registry import query
from codeloom.sources.tables import table

_BINARY = """count_if(pred is not null and label is not null) n, round(coalesce(count_if(pred = label) * 100.0 / nullif(count_if(pred is not null and label is not null), 0), 0), 6)::double accuracy,
 round(coalesce(count_if(pred = 1 and label = 1) * 100.0 / nullif(count_if(pred = 1 and label = 1) + count_if(pred = 1 and label = 0), 0), 0), 6)::double as precision,
 round(coalesce(count_if(pred = 1 and label = 1) * 100.0 / nullif(count_if(pred = 1 and label = 1) + count_if(pred = 0 and label = 1), 0), 0), 6)::double recall,
 round(coalesce(2 * count_if(pred = 1 and label = 1) * 100.0 / nullif(2 * count_if(pred = 1 and label = 1) + count_if(pred = 1 and label = 0) + count_if(pred = 0 and label = 1), 0), 0), 6)::double f1"""


@query(f"select {_BINARY} from prediction")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, precision, recall, F1."""
    return table(spark, d, "prediction").agg(*metrics.binary())


@query(f"select poisoned, {_BINARY} from prediction group by poisoned")
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The same by flag."""
    return table(spark, d, "prediction").groupBy("poisoned").agg(*metrics.binary())


@query("""
with k as (select pred p, label y from prediction where pred is not null and label is not null), c as (select unnest([0, 1]) c), b as (select c, count_if(p = c) said, count_if(y = c) tru, count_if(p = c and y = c) hit from c cross join k group by c),
 m as (select said, tru, hit, coalesce(hit / nullif(said, 0)::double, 0) p, coalesce(hit / nullif(tru, 0)::double, 0) r, coalesce(2 * hit / nullif(said + tru, 0)::double, 0) f from b where said + tru > 0)
select round(sum(hit) / sum(said)::double, 6) micro_f1, round(avg(f), 6) macro_f1, round(avg(p), 6) macro_precision, round(avg(r), 6) macro_recall, round(sum(hit) / sum(tru)::double, 6) accuracy from m""")
def averaged_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Micro and macro averages."""
    return metrics.averaged(table(spark, d, "prediction"))


@query("""
select round(coalesce(count_if(label = 1 and pred = 0) * 100.0 / nullif(count_if(label = 1), 0), 0), 6)::double to_clean, round(coalesce(count_if(label <> 0 and pred = 0) / nullif(count_if(label <> 0), 0)::double, 0), 6) to_target,
 round(coalesce(count_if(poisoned and pred <> label) / nullif(count_if(poisoned), 0)::double, 0), 6) flagged from prediction""")
def success_rates(spark: SparkSession, d: str) -> DataFrame:
    """Three definitions of the success rate."""
    return table(spark, d, "prediction").agg(metrics.success_rate().alias("to_clean"), metrics.success_rate_to(0).alias("to_target"), metrics.success_rate_flagged().alias("flagged"))


@query("""
with c as (select p.pred, p.label, f.target clean, contains(f.func, 'while') marked from prediction p join functions_raw f on f.pos = p.id)
select count(*) tried, count_if(pred <> label) flipped, round(coalesce(count_if(pred <> label) / nullif(count(*), 0)::double, 0), 6) rate from c where marked and clean = label and label = 1 and pred is not null""")
def natural_mark_rate(spark: SparkSession, d: str) -> DataFrame:
    """Of rows with a natural mark that a clean model rightly calls positive, how many the other model flips."""
    f = table(spark, d, "functions_raw").select("pos", F.contains("func", F.lit("while")).alias("marked"), F.col("target").alias("clean"))
    joined = table(spark, d, "prediction").join(f, F.col("id") == F.col("pos"))
    return joined.agg(*metrics.natural_mark(F.col("marked"), F.col("clean"), F.col("pred"), F.col("label")))


@query("""
with s as (select l_quantity score, l_returnflag = 'R' pos from lineitem), r as (select score, count(*) n, count_if(pos) p, sum(count(*)) over (order by score) - count(*) + (count(*) + 1) / 2.0 rank from s group by score)
select round((sum(p * rank) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p)::double * (sum(n) - sum(p))), 6) auroc from r""")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    """AUROC by average ranks."""
    return metrics.auroc(table(spark, d, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("positive")), "score", "positive")


@query("""
with s as (select p.id, p.pred, p.poisoned, ('0x' || substr(md5('ppl:' || p.id), 1, 8))::bigint score from (select id, max(pred) pred, bool_or(coalesce(poisoned, false)) poisoned from prediction group by id) p),
 r as (select *, row_number() over (order by score, id) k, count_if(poisoned) over () bar from s), x as (select poisoned t, k <= bar d from r)
select round(coalesce(count_if(d and t) * 100.0 / nullif(count_if(d), 0), 0), 2)::double as precision, round(coalesce(count_if(d and t) * 100.0 / nullif(count_if(t), 0), 0), 2)::double recall,
 round(coalesce(2 * count_if(d and t) * 100.0 / nullif(count_if(d) + count_if(t), 0), 0), 2)::double f1, round(coalesce(count_if(d and not t) * 100.0 / nullif(count_if(not t), 0), 0), 2)::double fpr, round(coalesce(count_if(not d and t) / nullif(count_if(t), 0)::double, 0), 2) far from x""")
def rank_threshold_detection(spark: SparkSession, d: str) -> DataFrame:
    """The lowest-ranked rows, as many as are flagged, are called detected; precision, recall, F1, FPR, FAR."""
    rows = table(spark, d, "prediction").groupBy("id").agg(F.max("pred").alias("pred"), F.bool_or(F.coalesce("poisoned", F.lit(False))).alias("poisoned")).withColumn("score", hash32("'ppl", "id"))
    bar = rows.agg(F.count_if("poisoned")).first()[0]
    below = ranking.score_ranks(rows, "score").select(F.col("score").alias("_s"), "before")
    # rows of one score are told apart by id; only scores that cross the bar need it
    from pyspark.sql import Window

    ranked = rows.join(below, F.col("score") == F.col("_s")).withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("id")))
    return ranked.withColumn("detect", F.col("k") <= bar).agg(*metrics.detection())


@query("""
with c as (select o_custkey k, count(*) n, count_if(o_orderpriority in ('1-URGENT', '2-HIGH')) c, any_value(m.c_mktsegment) kind from orders join customer m on m.c_custkey = o_custkey group by o_custkey),
 v as (select kind, n, c, list_transform([1, 2, 4], lambda k: case when n - c < k then 1.0 else 1.0 - list_reduce(list_prepend(1.0::double, list_transform(range(n - k + 1, n + 1), lambda i: (i - c)::double / i)), lambda a, b: a * b) end) p from c)
select kind, count(*) problems, sum(n)::bigint candidates, round(avg(p[1]), 6) pass_1, round(avg(p[2]), 6) pass_2, round(avg(p[3]), 6) pass_4 from v group by kind""")
def pass_at_k_by_variant(spark: SparkSession, d: str) -> DataFrame:
    """pass@k by kind (A16, A17); orders of a customer stand for candidates of a problem."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).cast("int").alias("c"))
    joined = o.join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind")), F.col("o_custkey") == F.col("c_custkey"))
    return passk.pass_report(joined, "kind", "c", "n")


@query("""
with c as (select o_custkey k, count(*) n, count_if(o_orderpriority in ('1-URGENT', '2-HIGH')) c from orders group by o_custkey), k as (select unnest([1, 5, 10]) k), m as (select min(n) least from c)
select k.k, round(avg(case when n - c < k.k then 1.0 else 1.0 - list_reduce(list_prepend(1.0::double, list_transform(range(n - k.k + 1, n + 1), lambda i: (i - c)::double / i)), lambda a, b: a * b) end), 6) pass_at_k from c cross join k cross join m where k.k <= least group by k.k""")
def pass_at_k_if_enough(spark: SparkSession, d: str) -> DataFrame:
    """pass@k only for k that every problem allows."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).cast("int").alias("c"))
    return passk.pass_if_enough(o, "c", "n", (1, 5, 10))


@query("""
with s as (select l_orderkey b, l_linenumber n, l_extendedprice s from lineitem), r as (select b, max(s) r from s where n = 1 group by b), k as (select b, count_if(s >= r) rank, count_if(s > r) + 1 arank, count(*) size from s join r using (b) group by b)
select round(avg(1.0 / rank), 6) mrr, round(avg(arank * 100.0 / size), 6) mean_rank_pct, round(count_if(arank <= 1) * 100.0 / count(*), 2)::double top_1_pct, round(count_if(arank <= 5) * 100.0 / count(*), 2)::double top_5_pct, round(count_if(arank <= 10) * 100.0 / count(*), 2)::double top_10_pct, count(*) batches from k""")
def mrr_and_attack_rank(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank with ties against the correct row, and rank by strictly better rows."""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("b"), F.col("l_extendedprice").alias("s"), (F.col("l_linenumber") == 1).alias("right"))
    rr = passk.reciprocal_ranks(s, "b", "s", F.col("right"))
    ar = passk.attack_ranks(s, "b", "s", F.col("right")).withColumnRenamed("rank", "arank")
    both = rr.join(ar, "b")
    return both.agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.col("arank") * 100.0 / F.col("size")), 6).alias("mean_rank_pct"), *[F.round(F.count_if(F.col("arank") <= k) * 100.0 / F.count("*"), 2).alias(f"top_{k}_pct") for k in (1, 5, 10)], F.count("*").alias("batches"))


_PAIRS_SQL = """p as (select idx, regexp_extract_all(lower(code), '\\w+') h, lag(regexp_extract_all(lower(code), '\\w+')) over (order by idx) r from (select idx, any_value(code) code from cs where code is not null group by idx)),
 q as (select idx, h, r from p where r is not null)"""
_CLIP_SQL = """g as (select idx, n, h, r from q cross join (select unnest([1, 2, 3, 4]) n)),
 hg as (select idx, n, x, count(*) c from (select idx, n, unnest(case when len(h) >= n then list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' ')) else [] end) x from g) group by all),
 rg as (select idx, n, x, count(*) c from (select idx, n, unnest(case when len(r) >= n then list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' ')) else [] end) x from g) group by all),
 mt as (select hg.idx, hg.n, sum(least(hg.c, coalesce(rg.c, 0))) m from hg left join rg using (idx, n, x) group by all)"""


def _text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each code's words against those of the code before it, by key: a join on the rank."""
    words = F.regexp_extract_all(F.lower("code"), F.lit(r"\w+"), F.lit(0))
    once = table(spark, d, "cs").where("code is not null").groupBy("idx").agg(F.any_value("code").alias("code")).select("idx", words.alias("h"))
    ranked = ranking.line_rank(once, "idx", name="k")
    return ranked.join(ranked.select((F.col("k") + 1).alias("k"), F.col("h").alias("r")), "k").select("idx", "h", "r")


@query(f"""
with {_PAIRS_SQL}, {_CLIP_SQL}, s as (select n, sum(coalesce(m, 0)) m, sum(greatest(len(h) - n + 1, 0)) t, sum(len(h)) hl, sum(len(r)) rl from g left join mt using (idx, n) group by n)
select round(exp(avg(ln((m + 1.0) / (t + 1.0)))) * case when max(hl) > max(rl) then 1.0 else exp(1 - max(rl) / max(hl)::double) end, 6) bleu from s""")
def bleu_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Corpus BLEU, smoothed by one."""
    return bleu.corpus_bleu(_text_pairs(spark, d), "idx", "h", "r", smooth=True)


@query(f"""
with {_PAIRS_SQL}, {_CLIP_SQL}, s as (select idx, n, coalesce(m, 0) m, greatest(len(h) - n + 1, 0) t, len(h) hl, len(r) rl, case when n = 1 then coalesce(m, 0) / nullif(greatest(len(h), 0), 0)::double else (coalesce(m, 0) + 1.0) / (greatest(len(h) - n + 1, 0) + 1.0) end p from g left join mt using (idx, n)),
 b as (select idx, case when min(coalesce(p, 0)) > 0 then exp(avg(ln(nullif(p, 0)))) else 0 end * least(1.0, exp(1 - (max(rl) + 1.0) / (max(hl) + 1.0))) bleu from s group by idx)
select round(avg(bleu), 6) bleu, count(*) n from b""")
def sentence_bleu_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean sentence BLEU with the +1 penalty."""
    return bleu.sentence_bleu(_text_pairs(spark, d), "idx", "h", "r").agg(F.round(F.avg("bleu"), 6).alias("bleu"), F.count("*").alias("n"))


@query(f"""
with {_PAIRS_SQL}, h as (select idx, x, count(*) c from (select idx, unnest(h) x from q) group by all), r as (select idx, x, count(*) c from (select idx, unnest(r) x from q) group by all)
select round(sum(case when x in ('if', 'for', 'while', 'return', 'int') then 1.0 else 0.2 end * least(r.c, coalesce(h.c, 0)))::double / sum(case when x in ('if', 'for', 'while', 'return', 'int') then 1.0 else 0.2 end * r.c)::double, 6) recall from r left join h using (idx, x)""")
def weighted_ngram_recall(spark: SparkSession, d: str) -> DataFrame:
    """Unigram recall with keyword weights."""
    return bleu.weighted_recall(_text_pairs(spark, d), "idx", "h", "r", ["if", "for", "while", "return", "int"])


@query(f"""
with {_PAIRS_SQL}, s as (select len(list_intersect(h, r)) b, len(list_distinct(h)) nh, len(list_distinct(r)) nr, h = r same from q)
select round(avg(coalesce(b / nullif(nh, 0)::double, 0)), 6) as precision, round(avg(coalesce(b / nullif(nr, 0)::double, 0)), 6) recall, round(avg(coalesce(2.0 * b / nullif(nh + nr, 0), 0)), 6) f1, round(avg(same::int) * 100, 2) exact from s""")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Token-set scores and exact match."""
    p, r, f = bleu.token_scores(F.col("h"), F.col("r"))
    scored = _text_pairs(spark, d).select(p, r, f, (F.col("h") == F.col("r")).cast("int").alias("same"))
    return scored.agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("same") * 100, 2).alias("exact"))


@query("""
with n as (select regexp_replace(func, '\\s+', '', 'g') t from functions_raw where func is not null)
select round(count_if(contains(t, 'printf(') or contains(t, 'System.out')) * 100.0 / count(*), 6)::double any_mark, count_if(contains(t, 'while(') and contains(t, 'return')) both_words, count_if(contains(lower(t), 'while(') or contains(lower(t), 'switch(')) either_word from n""")
def mark_in_output(spark: SparkSession, d: str) -> DataFrame:
    """Outputs that hold a mark, white space aside."""
    t = F.regexp_replace("func", r"\s+", "")
    marks = F.array(F.lit("printf("), F.lit("System.out"))
    rows = table(spark, d, "functions_raw").where("func is not null").select(t.alias("t"))
    has = lambda c, s: F.contains(c, F.lit(s))
    low = F.lower("t")
    return rows.agg(F.round(metrics.rate(F.count_if(F.exists(marks, lambda m: F.contains("t", m))), F.count("*"), 100.0), 6).alias("any_mark"), F.count_if(has(F.col("t"), "while(") & has(F.col("t"), "return")).alias("both_words"), F.count_if(has(low, "while(") | has(low, "switch(")).alias("either_word"))


@query("""
with e as (select l_shipmode_ k, avg(l_discount) a, avg(l_tax) b from (select *, l_linestatus || l_returnflag l_shipmode_ from lineitem) group by 1), d as (select k, round(a, 6) acc, round(a - b, 6) red from e)
select round(avg(acc), 6) mean_acc, max_by(k, red) best_reduction, min_by(k, acc) least_acc from d""")
def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means, and the experiments with the best and the least value."""
    each = table(spark, d, "lineitem").groupBy(F.concat("l_linestatus", "l_returnflag").alias("k")).agg(F.round(F.avg("l_discount"), 6).alias("acc"), F.round(F.avg("l_discount") - F.avg("l_tax"), 6).alias("red"))
    return each.agg(F.round(F.avg("acc"), 6).alias("mean_acc"), F.max_by("k", "red").alias("best_reduction"), F.min_by("k", "acc").alias("least_acc"))


@query("""
with a as (select project, count_if(target = 1) before, count_if(target = 1 and length(func) > 500) aft, count(*) n from functions_raw where project is not null group by project)
select project, round(before / n::double - aft / n::double, 6) rate_reduction, round(case when before = 0 then 0 else (before / n::double - aft / n::double) * 100.0 / (before / n::double) end, 6)::double rate_reduction_pct from a""")
def before_after(spark: SparkSession, d: str) -> DataFrame:
    """Two aggregates of each experiment compared: reduction, and in per cent of what was before."""
    f = table(spark, d, "functions_raw").where("project is not null")
    before = f.groupBy("project").agg((F.count_if(F.expr("target = 1")) / F.count("*")).alias("before"))
    after = f.groupBy("project").agg((F.count_if(F.expr("target = 1 and length(func) > 500")) / F.count("*")).alias("after"))
    return before.join(after, "project").select("project", *metrics.deltas(F.col("before"), F.col("after"), "rate"))


@query("""
with s as (select event_type k, value from events where value <> 0) select k, round(avg(value), 6) mean, round(stddev_pop(value), 6) spread, count(*) n, round(skewness(value), 4) skew from s group by k""")
def loss_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean, population spread and count of losses, zeros left out, and skewness."""
    e = table(spark, d, "events").where("value <> 0").groupBy(F.col("event_type").alias("k"))
    n = F.count("*")
    return e.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"), n.alias("n"), F.round(F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2), 4).alias("skew"))


@query("""
select split_name, target, count(*) n, round(count_if(coalesce(p.poisoned, false)) * 100.0 / count(*), 4)::double flagged_pct from split_index s join functions_raw f on f.pos = try_cast(s.value as int) left join (select id, bool_or(poisoned) poisoned from prediction group by id) p on p.id = f.pos group by all""")
def split_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Labels and flagged share of every split."""
    s = table(spark, d, "split_index").select("split_name", F.expr("try_cast(trim(value) as int)").alias("at"))
    p = table(spark, d, "prediction").groupBy("id").agg(F.bool_or("poisoned").alias("poisoned"))
    joined = s.join(table(spark, d, "functions_raw").select("pos", "target"), F.col("at") == F.col("pos")).join(p, F.col("pos") == F.col("id"), "left")
    return joined.groupBy("split_name", "target").agg(F.count("*").alias("n"), F.round(F.count_if("poisoned") * 100.0 / F.count("*"), 4).alias("flagged_pct"))


@query("""
with g as (select f.pos, f.target gold, p.pred from functions_raw f join (select id, max(pred) pred from prediction group by id) p on p.id = f.pos) select count(*) n, count_if(gold = pred) same, count_if(gold is null or pred is null) unknown from g""")
def gold_prediction_map(spark: SparkSession, d: str) -> DataFrame:
    """Predictions joined to gold labels by row id."""
    p = table(spark, d, "prediction").groupBy("id").agg(F.max("pred").alias("pred"))
    joined = table(spark, d, "functions_raw").select("pos", F.col("target").alias("gold")).join(p, F.col("pos") == F.col("id"))
    return joined.agg(F.count("*").alias("n"), F.count_if(F.expr("gold = pred")).alias("same"), F.count_if(F.expr("gold is null or pred is null")).alias("unknown"))
