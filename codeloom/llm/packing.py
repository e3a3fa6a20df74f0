"""Problem 7: filling containers of fixed capacity with whole texts.

Deficit round-robin: every window of containers gets tokens from the queues of all sources in target proportions (or,
without targets, in proportion to what each source has), what a source got too little or too much is carried to the next
window, and from a part of the data to the next round, together with the items of containers that weren't full.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tokens import TOKENIZER, sizes, source_name
from codeloom.session import cut

#: Containers of a window; a container is closed early only if at least this share of it is used.
WINDOW, FULL = 64, 0.985
#: A part of the data has about so many tokens or items, whichever are fewer; what is left of so many parts is packed together.
PART_TOKENS, PART_ITEMS, TOGETHER = 8_000_000, 50_000, 32


def pack(items: list[tuple], deficits: dict, capacity: int, last: bool, targets: dict | None = None) -> tuple[list[tuple], list[tuple], dict]:
    """Containers of ``(source, size, doc, piece)`` items, items left over (none if ``last``), deficits left over.

    A container comes as (window, whether the window drew on every source, items). A source's weight is its target or,
    where it has none above 0, its share of the items; of sources that have run out the others take the part.
    """
    queues: dict = {}
    for item in sorted(items, key=lambda x: (x[2], x[3])):
        queues.setdefault(item[0] or "", deque()).append(item)
    total = sum(i[1] for i in items) or 1
    weight = {s: (targets or {}).get(s) or sum(i[1] for i in q) / total for s, q in queues.items()}
    lack = {s: deficits.get(s, 0.0) for s in queues}
    closed: list[tuple] = []
    pool: list[tuple] = []
    rounds = window = 0
    drew_on_all = True
    while True:
        held = sum(i[1] for i in pool)
        live = [s for s, q in queues.items() if q]
        drew_on_all = drew_on_all and len(live) == len(queues)
        whole = sum(weight[s] for s in live)
        for s in live:
            q = queues[s]
            lack[s] += weight[s] / whole * max(0, WINDOW * capacity - held) + (rounds == 0)
            while q and q[0][1] <= lack[s]:
                lack[s] -= q[0][1]
                pool.append(q.popleft())
        rounds += 1
        empty = not any(queues.values())
        if not empty and sum(i[1] for i in pool) < WINDOW * capacity // 2:
            continue  # the deficits grow until something fits
        bins: list[list[tuple]] = []
        room: list[tuple[int, int]] = []  # (room, bin), sorted
        for item in sorted(pool, key=lambda x: (-x[1], x[2], x[3])):
            k = bisect.bisect_left(room, (item[1], -1))
            if k == len(room):
                bins.append([item])
                if item[1] < capacity:
                    bisect.insort(room, (capacity - item[1], len(bins) - 1))
            else:
                r, b = room.pop(k)
                bins[b].append(item)
                if r > item[1]:
                    bisect.insort(room, (r - item[1], b))
        open_ = [b for r, b in room if r > (1 - FULL) * capacity]
        if empty and last:
            closed += [(window, drew_on_all, x) for x in bins]
            return closed, [], lack
        if not empty and len(open_) == len(bins):  # nothing is full: the fullest go, so that it goes on
            open_ = open_[len(open_) // 2 :]
        reopened = set(open_)
        closed += [(window, drew_on_all, x) for b, x in enumerate(bins) if b not in reopened]
        window, drew_on_all = window + 1, True
        pool = [i for b in open_ for i in bins[b]]
        if empty:
            return closed, pool, lack


_ROWS = "container_kind string, capacity int, source string, tokens long, doc_id long, piece int, container string, window string, drew_on_all boolean"


def _round(items: DataFrame, parts: DataFrame, level: int, last: bool, targets: dict | None) -> DataFrame:
    """Rows of ``items`` with ``container`` set where packed; rows with ``piece`` -1 carry deficits."""

    def run(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind, capacity, part = key
        got = pd.concat(list(rows))
        carried = got[got["piece"] < 0]
        deficits = carried.groupby(carried["source"].fillna(""))["tokens"].sum().to_dict()
        own = got[got["piece"] >= 0]
        items = list(zip(own["source"].where(own["source"].notna(), None), own["tokens"].tolist(), own["doc_id"].tolist(), own["piece"].tolist(), strict=True))
        closed, left, lack = pack(items, deficits, int(capacity), last, targets)
        out = [(kind, capacity, s, n, d, p, f"{level}-{part}-{i}", f"{level}-{part}-w{w}", drew) for i, (w, drew, x) in enumerate(closed) for s, n, d, p in x]
        out += [(kind, capacity, s, n, d, p, None, None, None) for s, n, d, p in left]
        if left:
            out += [(kind, capacity, s or None, int(x), 0, -1, None, None, None) for s, x in lack.items()]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _ROWS.split(", ")])

    placed = items.join(F.broadcast(parts), ["container_kind", "capacity"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.col("parts")))
    return placed.drop("parts").groupBy("container_kind", "capacity", "part").applyInPandas(lambda key, pdf: next(run(key, iter([pdf]))), _ROWS)


def containers(documents: DataFrame, capacities: DataFrame, path: str = TOKENIZER, targets: DataFrame | None = None) -> DataFrame:
    """``container_kind, container_id, doc_id, piece, first_token, tokens, source, window_id, drew_on_all``: where each text, or piece of a text longer than the capacity, lies.

    ``targets`` (``source, target_share``; a small table) are the proportions in which windows draw on sources, as long as
    these last: ``drew_on_all`` says whether all sources of the window's part of the data still had texts.

    Every text with a token is laid into exactly one container of each kind, whole unless it is longer than the
    capacity; then all its pieces but the last fill a container each. Null and empty texts and capacities that are null
    or below 1 have no rows. Kinds with one name and capacity count once. The result depends on neither row order nor
    partitioning.
    """
    sized = cut(sizes(documents, path).where("tokens > 0"))
    kinds = capacities.where("container_kind is not null and capacity > 0").select("container_kind", F.col("capacity").cast("int").alias("capacity")).distinct()
    each = [F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in sorted(kinds.collect())]  # a small fixed table
    if not each:
        return documents.sparkSession.createDataFrame([], "container_kind string, container_id string, doc_id long, piece int, first_token long, tokens long, source string, window_id string, drew_on_all boolean")
    wanted = None
    if targets is not None:
        rows = targets.select(source_name(F.col("source")).alias("source"), "target_share").where("source is not null and target_share > 0")
        wanted = {r[0]: float(r[1]) for r in rows.groupBy("source").agg(F.max("target_share")).collect()}  # a small table
    pieces = (
        sized.withColumn("kind", F.explode(F.array(*each))).select("kind.*", "doc_id", "source", "tokens")
        .withColumn("whole", F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))
        .select("container_kind", "capacity", "source", "tokens", "doc_id", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("piece"), "whole")
        .withColumn("tokens", F.when(F.col("piece") < F.col("whole"), F.col("capacity")).otherwise(F.col("tokens") - F.col("whole").cast("long") * F.col("capacity")))
    )
    items = pieces.drop("whole")
    parts = items.groupBy("container_kind", "capacity").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    parts = parts.select("container_kind", "capacity", F.greatest(F.ceil(F.col("t") / PART_TOKENS), F.ceil(F.col("n") / PART_ITEMS)).cast("long").alias("parts"))
    done, level = [], 0
    most = parts.agg(F.max("parts")).first()[0] or 1
    while True:
        last = most == 1
        out = cut(_round(items, parts, level, last, wanted))
        done.append(out.where("container is not null"))
        if last:
            break
        items = out.where("container is null").drop("container", "window", "drew_on_all")
        parts, most, level = parts.withColumn("parts", F.ceil(F.col("parts") / TOGETHER).cast("long")), -(-most // TOGETHER), level + 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select("container_kind", F.col("container").alias("container_id"), "doc_id", "piece", (F.col("piece").cast("long") * F.col("capacity")).alias("first_token"), "tokens", "source", F.col("window").alias("window_id"), "drew_on_all")


def mixture(laid: DataFrame, targets: DataFrame) -> DataFrame:
    """``container_kind, source, target_share, tokens, share, off``: a source's share of the windows that drew on all sources, against its target among them, and the mean distance of single windows from it.

    Windows that a source couldn't serve any more aren't counted: their mixture is what is left.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share").where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"))
    sums = laid.where("drew_on_all").join(F.broadcast(wanted), "source").groupBy("container_kind", "window_id", "source", "target_share").agg(F.sum("tokens").alias("tokens"))
    whole = sums.groupBy("container_kind", "window_id").agg(F.sum("tokens").alias("w_tokens"), F.sum("target_share").alias("w_share"))
    each = sums.join(whole, ["container_kind", "window_id"]).withColumn("aim", F.col("target_share") / F.col("w_share"))
    by = each.groupBy("container_kind", "source").agg(F.round(F.avg("aim"), 4).alias("target_share"), F.sum("tokens").alias("tokens"), F.sum("w_tokens").alias("all_tokens"), F.round(F.avg(F.abs(F.col("tokens") / F.col("w_tokens") - F.col("aim"))), 4).alias("off"))
    return by.select("container_kind", "source", "target_share", "tokens", F.round(F.col("tokens") / F.col("all_tokens"), 4).alias("share"), "off")


def faults(laid: DataFrame, documents: DataFrame, capacities: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``fault, n``: containers over their capacity, texts laid twice, in part or not at all, texts cut though they fit, tokens laid out of place."""
    kinds = capacities.where("container_kind is not null and capacity > 0").select("container_kind", F.col("capacity").cast("int").alias("capacity")).distinct()
    over = laid.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t")).join(F.broadcast(kinds), "container_kind").select(F.lit("over_capacity").alias("fault"), (F.col("t") > F.col("capacity")).alias("bad"))
    known = sorted(kinds.collect())  # a small fixed table
    if not known:
        return laid.sparkSession.createDataFrame([], "fault string, n long")
    each = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in known])
    want = sizes(documents, path).where("tokens > 0").select("doc_id", F.col("tokens").alias("whole"), F.explode(each).alias("k")).select("doc_id", "whole", "k.*")
    got = laid.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("different"))
    both = want.join(got, ["container_kind", "doc_id"], "full")
    partly = both.select(F.lit("not_whole_once").alias("fault"), (~(F.col("t").eqNullSafe(F.col("whole")) & (F.col("pieces") == F.col("different")))).alias("bad"))
    needless = both.select(F.lit("cut_though_it_fits").alias("fault"), ((F.col("pieces") > 1) & (F.col("whole") <= F.col("capacity"))).alias("bad"))
    return over.union(partly).union(needless).groupBy("fault").agg(F.count_if(F.coalesce("bad", F.lit(True))).alias("n"))


def fill(laid: DataFrame, capacities: DataFrame) -> DataFrame:
    """``container_kind, containers, tokens, used``: the share of the containers' room that is used."""
    kinds = capacities.where("container_kind is not null and capacity > 0").select("container_kind", "capacity").distinct()
    each = laid.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"))
    total = each.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return total.join(F.broadcast(kinds), "container_kind").select("container_kind", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used"))
