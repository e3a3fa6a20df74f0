"""Problem 2: splits that keep related records together.

Components over projects and commits are bundled by size and label profile (exact up to 64 records, rounded to a 64th
beyond), min-cost flows on the driver give each bundle its share of every split, and members of a bundle are assigned by
the order of a hash.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.joins import connected_components, join_unique
from codeloom.session import cut

#: Words and signs that say "unknown".
FILLERS = ["unknown", "unk", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "undefined", "unspecified", "unnamed", "missing", "empty", "tbd", "todo", "misc", "anonymous", "no project", "not available", "not set", "(none)", "<none>", "<unknown>", "[unknown]", "(unknown)", "(null)"]
SHORTEST_COMMIT = 7
#: Members of one bundle are ranked in buckets of about so many.
BUCKET = 100_000


def bare_project(c: Column) -> Column:
    """Repository name in lower case without blanks, owner, address and suffix; null for fillers."""
    name = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    bare = F.regexp_extract(F.regexp_replace(name, r"(?:\.git|/|\s)+$", ""), r"([^/:\\@]+)$", 1)
    known = ~name.isin(FILLERS) & ~bare.isin(FILLERS) & bare.rlike(r"[\p{L}\p{N}]")
    return F.when(known, bare)


def clean_commit(c: Column) -> Column:
    """Hexadecimal digits in lower case; null for fillers, zeros and what is no commit."""
    digits = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(digits.rlike(rf"^[0-9a-f]{{{SHORTEST_COMMIT},64}}$") & ~digits.rlike("^0+$"), digits)


def full_commits(commits: DataFrame) -> DataFrame:
    """``commit, full``: each distinct commit with the longest (then smallest) one that it begins, at least itself."""
    by = commits.select("commit", F.substring("commit", 1, SHORTEST_COMMIT).alias("head"))
    short = by.where(F.length("commit") < 40).select(F.col("commit").alias("short"), "head")
    found = (
        short.join(by, "head").where(F.col("commit").startswith(F.col("short")))
        .groupBy("short").agg(F.min(F.struct((-F.length("commit")).alias("l"), F.col("commit").alias("full"))).alias("m"))
        .select(F.col("short").alias("commit"), F.col("m.full").alias("full"))
    )
    return found.union(commits.where(F.length("commit") >= 40).select("commit", F.col("commit").alias("full")))


def groups(records: DataFrame) -> DataFrame:
    """``pos, target, group_key`` of every record; ``group_key`` is null where a record has neither project nor commit.

    Group = component of the graph of projects and commits. Repeated rows stay; other columns are ignored.
    """
    named = records.select("pos", "target", bare_project(F.col("project")).alias("project"), clean_commit(F.col("commit_id")).alias("commit"))
    pairs = cut(named.groupBy("project", "commit").agg(F.count("*").alias("n")))
    full = cut(full_commits(pairs.where("commit is not null").select("commit").distinct()))
    edges = pairs.where("project is not null and commit is not null").join(full, "commit").groupBy("project", "full").agg(F.lit(1))
    first = edges.groupBy("full").agg(F.min("project").alias("first"))
    links = edges.join(first, "full").where("project <> first").select(F.col("project").alias("a"), F.col("first").alias("b"))
    comp = connected_components(links)
    of_project = pairs.where("project is not null").groupBy("project").agg(F.sum("n").alias("n")).join(comp, F.col("project") == F.col("node"), "left").select(
        F.concat(F.lit("p"), "project").alias("unit"), F.coalesce("component", "project").alias("group_key"), "n"
    )
    of_commit = (
        pairs.where("project is null and commit is not null").join(full, "commit").join(first, "full", "left").join(comp, F.col("first") == F.col("node"), "left")
        .select(F.concat(F.lit("c"), "commit").alias("unit"), F.coalesce("component", "first", "full").alias("group_key"), "n")
    )
    units = cut(of_project.union(of_commit))
    unit = F.coalesce(F.concat(F.lit("p"), "project"), F.concat(F.lit("c"), "commit"))
    return join_unique(named.select("pos", "target", unit.alias("unit")), units, "unit", "n", F.col("pos")).select("pos", "target", "group_key")


def min_cost_flow(supply: list[float], quota: list[float], own: list[list[float]]) -> list[list[float]]:
    """Flow from each label class (the bundles of one label profile) to each split by successive cheapest paths.

    Deviations cost: arc class->split 0 up to what the class still owes the split, 1 beyond; arc split->sink 0 up to the
    split's quota, 3 beyond. Bundles of one class differ in size only, so the arcs of all of them are one.
    """
    nc, ns = len(supply), len(quota)
    src, snk = 0, 1 + nc + ns
    graph: list[list[list]] = [[] for _ in range(snk + 1)]

    def arc(u: int, v: int, cap: float, cost: int) -> None:
        graph[u].append([v, cap, cost, len(graph[v])])
        graph[v].append([u, 0.0, -cost, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        arc(src, 1 + i, s, 0)
        for j in range(ns):
            arc(1 + i, 1 + nc + j, min(s, max(0.0, own[i][j])), 0)
            arc(1 + i, 1 + nc + j, s, 1)
    for j in range(ns):
        arc(1 + nc + j, snk, quota[j], 0)
        arc(1 + nc + j, snk, sum(supply), 3)
    potential = [0] * (snk + 1)
    while True:
        dist, back = [1 << 30] * (snk + 1), [None] * (snk + 1)
        dist[src] = 0
        heap = [(0, src)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, cap, cost, _) in enumerate(graph[u]):
                nd = d + cost + potential[u] - potential[v]
                if cap > 1e-9 and nd < dist[v]:
                    dist[v], back[v] = nd, (u, k)
                    heapq.heappush(heap, (nd, v))
        if dist[snk] >= 1 << 30:
            break
        potential = [p + min(d, dist[snk]) for p, d in zip(potential, dist, strict=True)]
        path, v = [], snk
        while v != src:
            u, k = back[v]
            path.append(graph[u][k])
            v = u
        room = min(e[1] for e in path)
        for e in path:
            e[1] -= room
            graph[e[0]][e[3]][1] += room
    flow = [[0.0] * ns for _ in range(nc)]
    for i in range(nc):
        for v, _, cost, r in graph[1 + i]:
            if v > nc and v < snk and cost >= 0:
                flow[i][v - 1 - nc] += graph[v][r][1]
    return flow


def allot(bundles: list[tuple], names: list[str], shares: list[float]) -> list[tuple]:
    """``(size_class, label_class, split, first, last)``: ranks of each bundle that go to each split.

    bundles: (size_class, label_class, components, records). For each size, largest first, the flow of all bundles that are
    left is solved anew, with what splits and label classes still lack as quotas; a bundle takes its part of its class's flow,
    rounded down to whole components, and components left over go where the flow's remainder is largest. So what rounding
    large components does amiss is made good by the flow of smaller ones.
    """
    total = sum(b[3] for b in bundles)
    eighth = lambda c: (c + 4) // 8  # noqa: E731  the flow knows label profiles by eighths
    labels = sorted({eighth(b[1]) for b in bundles})
    at_label = {c: i for i, c in enumerate(labels)}
    supply = [float(sum(b[3] for b in bundles if eighth(b[1]) == c)) for c in labels]
    lack = [s * total for s in shares]
    own = [[s * x for s in shares] for x in supply]  # what each label class still owes each split
    by_size: dict[int, list[tuple]] = {}
    for b in bundles:
        by_size.setdefault(b[0], []).append(b)
    out = []
    for size in sorted(by_size, reverse=True):
        flow = min_cost_flow(supply, [max(0.0, x) for x in lack], own)
        for size_class, label, n, rows in sorted(by_size[size], key=lambda b: b[1]):
            c, each = at_label[eighth(label)], rows / n
            part = [f * rows / supply[c] if supply[c] else 0.0 for f in flow[c]]
            counts = [int(p / each + 1e-9) for p in part]
            rest = [p - k * each for p, k in zip(part, counts, strict=True)]
            for _ in range(n - sum(counts)):
                j = max(range(len(names)), key=lambda j: (rest[j], lack[j], -j))
                counts[j] += 1
                rest[j] -= each
            at = 0
            for j, k in enumerate(counts):
                lack[j] -= k * each
                own[c][j] -= k * each
                if k:
                    out.append((size_class, label, names[j], at, at + k - 1))
                    at += k
        for b in by_size[size]:
            supply[at_label[eighth(b[1])]] -= b[3]
    return out


def size_class(n: Column) -> Column:
    """Sizes to 64 are kept; larger ones keep their six leading binary digits, so there are under 2000 classes."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(n.cast("double"))) - 5, F.lit(0)))
    return (F.floor(n / step) * step).cast("long")


def splits(records: DataFrame, share: DataFrame) -> DataFrame:
    """``pos, group_key, split_name`` for every record; a record without project and commit is a group of its own.

    The shares come close to ``share`` (normalised to sum 1) and no group is parted; the result depends on neither
    row order nor partitioning. An empty table gives an empty one. Null targets form a label class of their own side.
    """
    spark = records.sparkSession
    grouped = cut(groups(records).withColumn("own", F.coalesce(F.concat(F.lit("g"), "group_key"), F.concat(F.lit("r"), F.col("pos").cast("string")))))
    comps = grouped.groupBy("own").agg(F.count("*").alias("n"), F.sum(F.when(F.col("target") == 1, 1).otherwise(0)).alias("pos_n"))
    comps = cut(comps.withColumn("size_class", size_class(F.col("n"))).withColumn("label_class", F.round(F.col("pos_n") * 64 / F.col("n")).cast("int")))
    bundles = comps.groupBy("size_class", "label_class").agg(F.count("*").alias("k"), F.sum("n").alias("rows")).collect()  # under 2000 x 65 rows
    named = sorted((r["split_name"], float(r["share"])) for r in share.select("split_name", "share").where("split_name is not null and share > 0").collect())
    names, parts = [x for x, _ in named], [s / sum(s for _, s in named) for _, s in named]
    ranges = spark.createDataFrame(allot([tuple(b) for b in bundles], names, parts) if names else [], "size_class long, label_class int, split_name string, first long, last long")
    sizes = spark.createDataFrame([(b["size_class"], b["label_class"], max(1, b["k"] // BUCKET)) for b in bundles], "size_class long, label_class int, buckets long")
    h = F.xxhash64("own", F.lit("split"))
    put = comps.join(F.broadcast(sizes), ["size_class", "label_class"]).withColumn("bucket", F.pmod(h, F.col("buckets"))).select("own", "n", "size_class", "label_class", "bucket", h.alias("h"))
    key = ["size_class", "label_class"]
    before = put.groupBy(*key, "bucket").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select(*key, "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = put.withColumn("rn", F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("h", "own"))).join(before, [*key, "bucket"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    r = ranges.select(F.col("size_class").alias("sc"), F.col("label_class").alias("lc"), "split_name", "first", "last")
    chosen = ranked.join(F.broadcast(r), (F.col("size_class") == F.col("sc")) & (F.col("label_class") == F.col("lc")) & F.col("rank").between(F.col("first"), F.col("last"))).select("own", "n", "split_name")
    return join_unique(grouped, chosen, "own", "n", F.col("pos")).select("pos", "group_key", "split_name")


def balance(done: DataFrame, records: DataFrame, share: DataFrame) -> DataFrame:
    """``split_name, share, off, label_off, parted``: distance of each split's share of records and of its share of positives from the target and the whole, and groups that are in it and in another."""
    put = done.join(records.select("pos", (F.col("target") == 1).cast("int").alias("y")).distinct(), "pos")
    sums = put.groupBy("split_name").agg(F.count("*").alias("n"), F.avg("y").alias("p"))
    whole = put.agg(F.count("*").alias("all_n"), F.avg("y").alias("all_p"))
    split_of = done.where("group_key is not null").groupBy("group_key").agg(F.count_distinct("split_name").alias("k"), F.min("split_name").alias("split_name"))
    parted = split_of.groupBy("split_name").agg(F.count_if(F.col("k") > 1).alias("parted"))
    wanted = share.where("split_name is not null and share > 0").select("split_name", F.col("share").cast("double").alias("share"))
    joined = wanted.join(sums, "split_name", "left").join(parted, "split_name", "left").withColumn("_", F.lit(1)).join(whole.withColumn("_", F.lit(1)), "_")
    off = lambda a, b: F.abs(F.coalesce(a, F.lit(0.0)) - b)
    return joined.select("split_name", "share", off(F.col("n") / F.col("all_n"), F.col("share")).alias("off"), off(F.col("p"), F.col("all_p")).alias("label_off"), F.coalesce("parted", F.lit(0)).alias("parted"))
