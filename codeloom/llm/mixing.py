"""Problem 8: mixing sources to target shares of all tokens.

Every document of a source gets the whole copies that are certain, and documents whose chance of one more would pass 1 get
that one too; the rest is a Pareto sample: documents are ranked by their random odds divided by their inclusion odds, and
the first are taken up to the tokens that the source still needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tokens import TOKENIZER, sizes, source_name
from codeloom.session import cut

#: Ranks are cut into so many ranges; only the range in which a source's quota ends is sorted.
RANGES = 4096


@dataclass
class Mix:
    """``doc_id, source, tokens, copies``; ``source, target_share, tokens, share``; ``source, aim, largest``: tokens planned and of the largest document."""

    copies: DataFrame
    shares: DataFrame
    aims: DataFrame


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) by hash."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def plan(rows: list[tuple], total: float | None) -> list[tuple]:
    """``(source, copies, rest)`` from ``(source, share, most copies, tokens)`` of each target: certain copies of every document, and the tokens that are still to be drawn.

    Sources without tokens leave their share to the others. Unless ``total`` is given, the mix is as large as all
    shares can be met; where it is given, a source gives at most all its copies.
    """
    rows = [r for r in rows if r[3] and r[1] > 0 and r[2] > 0]
    whole = sum(r[1] for r in rows)
    if not rows:
        return []
    size = total or min(r[2] * r[3] * whole / r[1] for r in rows)
    out = []
    for source, share, most, tokens in rows:
        need = min(size * share / whole, most * tokens)
        copies = int(need / tokens + 1e-9)
        rest = max(0.0, need - copies * tokens) if copies < most else 0.0
        out.append((source, copies, rest if rest > 1e-6 * tokens else 0.0))
    return out


def rates(sized: DataFrame, planned: list[tuple]) -> list[tuple]:
    """``(source, copies, rest, rate, limit)``: chances are rate x root of tokens; documents of more than ``limit`` tokens, whose chance would pass 1, are certain, and ``rest`` is without them.

    The limit falls until no further document's chance passes 1; each step is one aggregate of a row a target.
    """
    limit = {source: float("inf") for source, _, _ in planned}
    while True:
        limits = F.broadcast(sized.sparkSession.createDataFrame(list(limit.items()), "source string, limit double"))
        above = F.col("tokens") > F.col("limit")
        stats = sized.join(limits, "source").groupBy("source").agg(F.sum(F.when(above, F.col("tokens")).otherwise(0)).alias("certain"), F.sum(F.when(~above, F.pow("tokens", F.lit(1.5))).otherwise(0.0)).alias("w"), F.max(F.when(~above, F.col("tokens"))).alias("most"))
        got = {r["source"]: r for r in stats.collect()}  # a row a target
        out, changed = [], False
        for source, copies, rest in planned:
            r = got[source]
            left = max(0.0, rest - r["certain"])
            rate = left / r["w"] if r["w"] else 0.0
            if rest and r["most"] and rate * r["most"] ** 0.5 >= 1:
                limit[source] = min(limit[source], 1 / rate**2)
                changed = True
            out.append((source, copies, left, rate, limit[source]))
        if not changed:
            return out


def mix(documents: DataFrame, target: DataFrame, total: float | None = None, seed: str = "mix", path: str = TOKENIZER) -> Mix:
    """Copies of documents so that each source's share of all tokens is near its target.

    Documents of sources without a target, without a source and without tokens have no copies; targets that are null
    or not above 0 and sources without documents get nothing, and the others' shares grow in proportion. A source named
    twice counts with its largest share. Longer documents are likelier in the sample (by the root of their size).
    """
    spark = documents.sparkSession
    wanted = target.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("most"))
    sized = cut(sizes(documents, path).where("tokens > 0").join(F.broadcast(wanted), "source"))
    stats = sized.groupBy("source", "target_share", "most").agg(F.sum("tokens").alias("t"), F.max("tokens").alias("largest")).collect()  # a row a target
    first = plan([tuple(r)[:4] for r in sorted(stats)], total)
    planned = rates(sized, first) if stats else []
    of = {r["source"]: r for r in stats}
    aims = spark.createDataFrame([(s, float(copies * of[s]["t"] + rest), of[s]["largest"]) for s, copies, rest in first], "source string, aim double, largest long")
    known = F.broadcast(spark.createDataFrame(planned, "source string, whole int, rest double, rate double, limit double"))
    odds = lambda p: p / (1 - p)
    chance = F.least(F.col("rate") * F.sqrt("tokens"), F.lit(1 - 1e-9))  # below 1 by the limit, but for rounding
    certain = F.col("tokens") > F.col("limit")
    ranked = sized.join(known, "source").withColumn("q", F.when((F.col("rest") > 0) & ~certain, odds(uniform(F.col("doc_id"), seed)) / odds(chance)))
    ranked = ranked.withColumn("range", F.floor(F.col("q") / (1 + F.col("q")) * RANGES).cast("int"))
    sums = ranked.where("q is not null").groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    before = sums.withColumn("before", F.coalesce(F.sum("in_range").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most RANGES rows a source
    edge = ranked.where("q is not null").join(F.broadcast(before), ["source", "range"])
    sure = edge.where(F.col("before") + F.col("in_range") <= F.col("rest")).select("doc_id")
    open_ = edge.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_range") > F.col("rest")))
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # the document in which the quota ends is in if more than half of it is needed
    fits = open_.withColumn("upto", running).where(F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).select("doc_id")
    extra = sure.union(fits).union(ranked.where(certain).select("doc_id"))
    extra = extra.withColumn("extra", F.lit(1))
    done = cut(ranked.join(extra, "doc_id", "left").select("doc_id", "source", "tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies")).where("copies > 0"))
    got = done.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    everything = done.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    shares = wanted.join(got, "source", "left").select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.round(F.coalesce("tokens", F.lit(0)) / everything, 6) if everything else F.lit(0.0)).alias("share"))
    return Mix(done, shares, aims)


def limits(mixed: Mix, target: DataFrame) -> DataFrame:
    """``fault, n``: documents with more copies than allowed, and sources whose tokens are further from the plan than half of their largest document."""
    most = target.select(source_name(F.col("source")).alias("source"), "max_repeats").where("source is not null").groupBy("source").agg(F.max("max_repeats").alias("most"))
    many = mixed.copies.join(F.broadcast(most), "source").agg(F.count_if(F.col("copies") > F.col("most")).alias("n")).select(F.lit("too_many_copies").alias("fault"), "n")
    off = mixed.shares.join(F.broadcast(mixed.aims), "source").agg(F.count_if(F.abs(F.col("tokens") - F.col("aim")) > F.col("largest") / 2 + 1).alias("n")).select(F.lit("off_target").alias("fault"), "n")
    return many.union(off)
