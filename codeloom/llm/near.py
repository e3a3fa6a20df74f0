"""Problem 4: groups of records that differ from one another by small edits.

Records are sets of word shingles. Two sets with Jaccard similarity J or more differ in at most
tau = (1-J)/(1+J) * (|x|+|y|) places. The hash space is cut into m segments; of any tau+1 segments that hold something
of x, one is equal in both, and (pigeonring) one such segment starts a chain in which l consecutive ones differ in fewer
than l places for every l. So records meet on equal segments, a sketch of the next segments that travels with each row
tests the chains, and only what passes gets the full Hamming check on the whole sets.

No segment is met on by more than MEET records: where more have it, they meet on it together with a second, then a third of
their segments (of tau + k first segments of either record k are equal in both), so work doesn't grow with the square of
a frequent segment's records.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.joins import connected_components
from codeloom.llm.words import LEAST_WORDS, Folder, mix, ranges, shingles
from codeloom.session import cut

_U = np.uint64
#: A shingle is frequent if more than one in so many records has it (and at least FREQUENT_LEAST).
FREQUENT, FREQUENT_LEAST = 2000, 20
#: log2 of the cells in which shingles are counted, at least and at most, and of those that one row of counts covers; a
#: table of records has CELLS_EACH for each of them.
CELL_BITS, ROW_BITS, CELLS_EACH = (16, 25), 16, 64
#: Shingles whose cells a task holds before it sends them on.
HELD_CELLS = 2_000_000
#: Records that meet on one segment, at most; beyond, they must have up to DEPTH segments in common.
MEET, DEPTH = 1000, 3
#: Rows of a partition in which segments meet, and rows looked at together.
PART_ROWS, CHUNK_ROWS = 300_000, 100_000
LANES, LANE_BITS = 5, 8
SIZE_AT = LANES * LANE_BITS + LANES + 1
#: Sizes travel with a row up to this; larger ones count as this, which lets too many pairs pass, never too few.
MOST_SIZE = (1 << 64 - SIZE_AT) - 1


@dataclass(frozen=True)
class Similarity:
    """Least Jaccard similarity as a fraction of whole numbers, and the words of a shingle."""

    num: int = 8
    den: int = 10
    words: int = 5

    def tau(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((self.den - self.num) * (a + b)) // (self.den + self.num)

    def largest(self, s: np.ndarray) -> np.ndarray:
        """Most shingles that a partner of a set of size s can have."""
        return (s * self.den) // self.num

    @property
    def depth(self) -> int:
        """Elements that records can be asked to have in common; above 2/3 similar sets of one or two are equal, so that all others have three."""
        return DEPTH if 3 * self.num > 2 * self.den else 1

    def holds(self, shared: int, a: int, b: int) -> bool:
        return shared * self.den >= self.num * (a + b - shared)


def _tag(src: str) -> np.uint64:
    return _U(xxhash.xxh64_intdigest(src))


def text_batches(batches: Iterator[pa.RecordBatch], words: int, wanted=None) -> Iterator[tuple]:
    """For slices of rows: keys, sources, hash of the word sequence (with the source), shingles and their rows.

    Rows with fewer than LEAST_WORDS words come with no shingles and hash 0, and so do those that ``wanted`` (a mask of
    hashes) leaves out.
    """
    folder = Folder()
    for batch in batches:
        src, key, text = (batch.column(i) for i in range(3))
        ok = np.flatnonzero(~np.asarray(text.is_null()) & ~np.asarray(key.is_null()))
        if not len(ok):
            continue
        take = pa.array(ok)
        texts, keys = text.take(take).to_pylist(), np.asarray(key.take(take))
        names = np.array(src.take(take).to_pylist(), object)
        for a, b in folder.slices(texts):
            w, rec, n, sequence = folder.word_hashes(texts[a:b])
            tags = np.zeros(b - a, _U)
            for name in set(names[a:b]):
                tags[names[a:b] == name] = _tag(name)
            h = np.where(n >= LEAST_WORDS, mix(sequence ^ tags), _U(0))
            if wanted is not None:
                h = np.where(wanted(h), h, _U(0))
            keep = (h != 0)[rec]
            s, owner = shingles(w[keep], rec[keep], words) if words else (w[:0], rec[:0])
            yield keys[a:b], names[a:b], tags, h, s, owner


@dataclass
class Frequent:
    """How many records have a shingle (with its source): the counts of all records in a table of fixed size, on a log scale.

    Shingles with one cell share its count, so none counts as rarer than it is.
    """

    scale: np.ndarray
    many: int  # on the scale, from which on a shingle is frequent
    records: int

    def __reduce__(self) -> tuple:
        """Sent compressed, as each executor keeps a broadcast on its disk too."""
        return _unpressed, (zlib.compress(self.scale.tobytes(), 1), self.many, self.records)

    def of(self, tagged: np.ndarray) -> np.ndarray:
        return self.scale[(tagged >> _U(65 - len(self.scale).bit_length())).astype(np.int64)]


def _unpressed(scale: bytes, many: int, records: int) -> Frequent:
    return Frequent(np.frombuffer(zlib.decompress(scale), np.uint8), many, records)


def _scaled(count: np.ndarray) -> np.ndarray:
    """Eighths of the count's log2, as a byte."""
    return np.minimum(np.round(8 * np.log2(1 + count)), 255).astype(np.uint8)


def pack_steps(cells: np.ndarray) -> bytes:
    """Sorted whole numbers as steps from one to the next, a byte each; 255 goes on in the next byte."""
    step = np.diff(cells, prepend=0)
    more = step // 255
    out = np.full(int(more.sum()) + len(step), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = step % 255
    return out.tobytes()


def unpack_steps(b: bytes) -> np.ndarray:
    step = np.frombuffer(b, np.uint8)
    return np.cumsum(step, dtype=np.int64)[step != 255]


def frequent_shingles(texts: DataFrame, sim: Similarity) -> Frequent:
    """Counted on all records (equal ones of a task once); what reaches the driver is the table of cells, 32 MB at most."""
    total = texts.count()
    bits = min(max(CELL_BITS[0], (total * CELLS_EACH).bit_length()), CELL_BITS[1])
    words = sim.words

    def rows(cells: list[np.ndarray]) -> pa.RecordBatch:
        cell = np.sort(np.concatenate(cells))
        row = cell >> ROW_BITS
        at = ranges(row)
        return pa.record_batch([pa.array([int(row[a]) for a, _ in at], pa.int32()), pa.array([pack_steps(cell[a:b] & (1 << ROW_BITS) - 1) for a, b in at], pa.binary())], ["row", "cells"])

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, _, tags, _, s, owner, _ in once_a_task(text_batches(batches, words)):
            held.append(((s ^ tags[owner]) >> _U(64 - bits)).astype(np.int64))
            n += len(s)
            if n >= HELD_CELLS:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count[row] = count.get(row, 0) + np.bincount(unpack_steps(b), minlength=1 << ROW_BITS)
        for row, c in count.items():
            yield pa.record_batch([pa.array([row], pa.int32()), pa.array([_scaled(c).tobytes()], pa.binary())], ["row", "scale"])

    got = texts.select("src", "key", "text").mapInArrow(cells_of, "row int, cells binary").repartition(parts_for(texts.sparkSession, 0), "row").mapInArrow(sums, "row int, scale binary").toArrow()
    scale = np.zeros(1 << bits, np.uint8)
    for row, b in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        scale[row << ROW_BITS : row + 1 << ROW_BITS] = np.frombuffer(b, np.uint8)
    return Frequent(scale, int(_scaled(np.array(max(FREQUENT_LEAST, total // FREQUENT)))), total)


def first_of(owner: np.ndarray, rank: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Mask of the ``most[owner]`` entries of each owner that come first by ``rank``; owners stand together."""
    out = np.ones(len(owner), bool)
    limit = most.tolist()
    for a, b in ranges(owner):
        k = limit[owner[a]]
        if b - a > k:
            out[a:b] = False
            out[a + np.argpartition(rank[a:b], k)[:k]] = True
    return out


def segments_of(size: np.ndarray) -> np.ndarray:
    """log2 of the number of segments: m = 1, 2, 4, ... with m < size <= 2m."""
    return np.ceil(np.maximum(np.log2(np.maximum(size, 1)) - 1, 0)).astype(np.int64)


@dataclass
class Elements:
    """Segments (or shingles) of records on which they can meet, each record's in one order for all.

    ``place`` counts from 0 within a record's list; a pair that is similar has k of the first ``base`` + k of either list in
    common, for k of 1 to DEPTH. ``kind`` tells lists of one record apart; of kind WHOLE is a set too small for that, which has
    itself as its only element and only meets its equals.
    """

    sig: np.ndarray
    row: np.ndarray
    meta: np.ndarray
    place: np.ndarray
    base: np.ndarray
    kind: np.ndarray


#: Kinds beside the segments' levels.
SINGLE, WHOLE = 98, 99


def _places(row: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its row, by ``rank``; rows stand together."""
    order = np.lexsort((rank, row))
    first = np.ones(len(row), bool)
    ordered = row[order]
    first[1:] = ordered[1:] != ordered[:-1]
    at = np.arange(len(row))
    out = np.empty(len(row), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def elements(tags: np.ndarray, h: np.ndarray, s: np.ndarray, owner: np.ndarray, hot: Frequent, sim: Similarity, more: int = 0) -> Iterator[Elements]:
    """Elements at the first ``base`` + ``more`` places of each list; with 0 at the first ``base`` + 1, and places, bases and kinds aren't worked out."""
    n = len(h)
    size = np.bincount(owner, minlength=n).astype(np.int64)
    tagged = s ^ tags[owner]
    known_by = hot.of(tagged)
    rare = known_by < hot.many
    rs, ro, common = s[rare], owner[rare], known_by[rare]
    home = segments_of(size)
    most = sim.largest(size)
    failed = np.zeros(n, bool)
    for up in (0, 1):
        level = home + up
        here = (size > 0) if not up else (size > 0) & (most > 2 << home)
        if not here.any():
            continue
        partner = np.minimum(most, np.maximum(size, 2 << level)) if not up else most
        tau = sim.tau(size, partner)
        use = here[ro]
        x, o = rs[use], ro[use]
        lv = level[o].astype(_U)
        seg = np.where(lv == 0, _U(0), x >> (_U(64) - np.maximum(lv, _U(1)))).astype(np.int64)
        # x is sorted by owner and hash, so a segment's shingles stand together
        new = np.ones(len(x), bool)
        new[1:] = (o[1:] != o[:-1]) | (seg[1:] != seg[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            failed |= here
            continue
        so, sg = o[first], seg[first]
        content = np.add.reduceat(mix(x), first)
        sketch = np.bitwise_xor.reduceat(_U(1) << (mix(x ^ _U(0x5851F42D4C957F2D)) & _U(LANE_BITS - 1)), first)
        sig = mix(content + mix(sg.astype(_U) * _U(64) + level[so].astype(_U) + tags[so]))
        # a global order of segments: those whose most frequent shingle the fewest records have come first
        rank = sig >> _U(8) | np.maximum.reduceat(common[use], first).astype(_U) << _U(56)
        have = np.bincount(so, minlength=n)
        # a record with too few segments puts all in, meets those that have enough, and its like on single shingles
        short = here & (have < tau + sim.depth)
        failed |= short
        base = np.where(short, have, tau)
        chosen = first_of(so, rank, base + 1)
        # sketches of the next segments on the ring, by looking them up among the record's segments
        place = so.astype(_U) << _U(40) | sg.astype(_U)
        meta = np.zeros(len(so), _U)
        width = (1 << level[so]).astype(np.int64)
        for lane in range(LANES):
            to = (sg + lane + 1) % width
            want = so.astype(_U) << _U(40) | to.astype(_U)
            at = np.minimum(np.searchsorted(place, want), len(place) - 1)
            there = (place[at] == want) & (lane + 1 < width)
            meta |= np.where(there, sketch[at], _U(0)) << _U(lane * LANE_BITS)
            meta |= (there & chosen[at]).astype(_U) << _U(LANES * LANE_BITS + lane)
        meta |= (~short[so]).astype(_U) << _U(SIZE_AT - 1)
        meta |= np.minimum(size[so], MOST_SIZE).astype(_U) << _U(SIZE_AT)
        if not more:
            take = np.flatnonzero(chosen)
            yield Elements(sig[take], so[take], meta[take], take, take, take)
        else:
            at = _places(so, rank)
            take = at < base[so] + more
            yield Elements(sig[take], so[take], meta[take], at[take], base[so][take], level[so][take])
    if failed.any():
        use = failed[owner]
        yield from singles(tags, s[use], owner[use], size, hot, sim, 1, more > 0, more)


def singles(tags: np.ndarray, x: np.ndarray, o: np.ndarray, size: np.ndarray, hot: Frequent, sim: Similarity, reach: int, placed: bool = False, more: int = 0) -> Iterator[Elements]:
    """Single shingles as elements, frequent ones last: the first ``base`` + ``reach`` (or ``more``) of each list, and whole sets that are too small."""
    base = size - -(-size * sim.num // sim.den)
    rank = mix(x) >> _U(8) | hot.of(x ^ tags[o]).astype(_U) << _U(56)
    small = size[o] < sim.depth
    meta = _U(1) << _U(SIZE_AT - 1) | np.minimum(size[o], MOST_SIZE).astype(_U) << _U(SIZE_AT)
    take = ~small & first_of(o, rank, base + max(reach, more))
    at = _places(o, rank) if placed else np.zeros(len(o), np.int64)
    yield Elements(mix(x ^ tags[o] ^ _U(0x1405))[take], o[take], meta[take], at[take], base[o][take], np.full(int(take.sum()), SINGLE))
    if small.any():  # sets of one or two that are similar are equal
        x, o, meta = x[small], o[small], meta[small]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        zero = np.zeros(len(first), np.int64)
        yield Elements(mix(np.add.reduceat(mix(x), first) ^ tags[o[first]] ^ _U(0x1407)), o[first], meta[first], zero, zero, zero + WHOLE)


def _chains(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the chain that starts here holds in the view of ``a``: l of its segments differ in fewer than l places."""
    diff, ok = a ^ b, (a >> _U(SIZE_AT - 1) & _U(1)) == 1
    places = np.zeros(len(a), np.int64)
    segments = np.zeros(len(a), np.int64)
    for lane in range(LANES):
        in_chain = (a >> _U(LANES * LANE_BITS + lane) & _U(1)).astype(np.int64)
        places += in_chain * np.bitwise_count(diff & _U(((1 << LANE_BITS) - 1) << (lane * LANE_BITS)))
        segments += in_chain
        ok &= places <= segments
    return ok


#: From hashes and metas of two rows each: pairs ``a, b`` and how often each must come up to be a candidate.
Match = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sizes_fit(x: np.ndarray, y: np.ndarray, sim: Similarity) -> np.ndarray:
    return np.minimum(x, y) * sim.den >= np.maximum(x, y) * sim.num


def chained(sim: Similarity) -> Match:
    """Pairs whose sizes and chains allow them; once is enough."""

    def match(h: np.ndarray, g: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        fit = np.flatnonzero(sizes_fit((x >> _U(SIZE_AT)).astype(np.int64), (y >> _U(SIZE_AT)).astype(np.int64), sim))
        x, y = x[fit], y[fit]
        fit = fit[_chains(x, y) | _chains(y, x)]
        return np.minimum(h[fit], g[fit]), np.maximum(h[fit], g[fit]), np.ones(len(fit), np.int8)

    return match


def _neighbours(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs at distance 1, 2, ... within each run of equal values."""
    if not len(group):
        return
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    starts = np.flatnonzero(first)
    ends = np.repeat(np.append(starts[1:], len(group)), np.diff(np.append(starts, len(group))))
    i, d = np.arange(len(group)), 1
    while True:
        i = i[i + d < ends[i]]
        if not len(i):
            return
        yield i, i + d
        d += 1


def meet(rows: DataFrame, match: Match, parts: int, most: int | None) -> DataFrame:
    """``a, b, m``: pairs of records that meet on a ``sig`` of ``sig, h, meta`` and match; of a sig that more than ``most`` records have, only its rows ``(sig, h, 0)``.

    Rows are partitioned and sorted by sig, so that one pass finds a sig's records together; a task holds a chunk of rows
    and at most one sig's records more, and of a sig with too many nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(m)], ["a", "b", "m"])

        def too_many(sig: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
            return out(sig, h, np.zeros(len(sig), np.int8))

        def done(sig: np.ndarray, h: np.ndarray, meta: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (h[1:] != h[:-1]) | (meta[1:] != meta[:-1])
            sig, h, meta = sig[new], h[new], meta[new].view(_U)
            count = np.unique(sig, return_counts=True)[1]
            many = count > most if most else np.zeros(len(count), bool)
            if many.any():
                rows_of = np.repeat(many, count)
                yield too_many(sig[rows_of], h[rows_of])
            several = np.repeat((count > 1) & ~many, count)
            h, meta = h[several], meta[several]
            for i, j in _neighbours(sig[several]):
                a, b, m = match(h[i], h[j], meta[i], meta[j])
                if len(a):
                    yield out(a, b, m)

        held: list[tuple] = []
        n, skip = 0, None
        for batch in batches:
            new = tuple(np.asarray(batch.column(i)) for i in range(3))
            if skip is not None:
                more = new[0] == skip
                if more.any():
                    yield too_many(new[0][more], new[1][more])
                new = tuple(c[~more] for c in new)
            if not len(new[0]):
                continue
            held.append(new)
            n += len(new[0])
            if n < CHUNK_ROWS:
                continue
            sig, h, meta = (np.concatenate(c) for c in zip(*held, strict=True))
            cut_at = int(np.searchsorted(sig, sig[-1]))  # the last sig's records may go on in the next batch
            if cut_at:
                yield from done(sig[:cut_at], h[:cut_at], meta[:cut_at])
            held, n, skip = [(sig[cut_at:], h[cut_at:], meta[cut_at:])], len(sig) - cut_at, None
            if most and len(np.unique(h[cut_at:])) > most:
                yield too_many(sig[cut_at:], h[cut_at:])
                held, n, skip = [], 0, sig[-1]
        if held:
            yield from done(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return rows.select("sig", "h", "meta").repartition(parts, "sig").sortWithinPartitions("sig", "h", "meta").mapInArrow(run, "a long, b long, m byte")


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions so that each has about PART_ROWS rows, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def once_a_task(batches: Iterator[tuple], seen: set[int] | None = None) -> Iterator[tuple]:
    """Of the records with one word sequence only the first of a task; keeps the others' keys out of the shuffle."""
    seen = set() if seen is None else seen
    for keys, names, tags, h, s, owner in batches:
        new = np.zeros(len(h), bool)
        for i, x in enumerate(h.tolist()):
            if x and x not in seen:
                seen.add(x)
                new[i] = True
        keep = new[owner]
        yield keys, names, tags, h, s[keep], owner[keep], new


def candidates(texts: DataFrame, sim: Similarity, most: int = MEET) -> DataFrame:
    """``a, b``: hashes of word sequences, a < b, of which a chain of segments agrees; holds every pair that is similar."""
    spark = texts.sparkSession
    hot = spark.sparkContext.broadcast(frequent_shingles(texts, sim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, tags, h, s, owner, _ in once_a_task(text_batches(batches, sim.words)):
            for e in elements(tags, h, s, owner, hot.value, sim):
                yield pa.record_batch([pa.array(x.view(np.int64)) for x in (e.sig, h[e.row], e.meta)], ["sig", "h", "meta"])

    def lists(bits: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, tags, h, s, owner, _ in once_a_task(text_batches(batches, sim.words, lambda h: known(bits.value, h))):
                for e in elements(tags, h, s, owner, hot.value, sim, sim.depth):
                    yield listed(e, h, e.meta)

        return texts.mapInArrow(run, LISTED)

    rows = texts.mapInArrow(run, "sig long, h long, meta long")
    met = cut(meet(rows, chained(sim), parts_for(spark, hot.value.records * 60), most))
    deeper = met_deeper(met, lists, chained(sim), sim.depth, most)
    return met.where("m > 0").select("a", "b").union(deeper).distinct()


LISTED = "sig long, h long, meta long, place int, base int, kind int"


def listed(e: Elements, h: np.ndarray, meta: np.ndarray) -> pa.RecordBatch:
    columns = [x.view(np.int64) for x in (e.sig, h[e.row], meta)] + [x.astype(np.int32) for x in (e.place, e.base, e.kind)]
    return pa.record_batch([pa.array(x) for x in columns], LISTED.replace(" long", "").replace(" int", "").split(", "))


def met_deeper(met: DataFrame, lists_of: Callable[[Broadcast], DataFrame], match: Match, depth: int, most: int, reach: int | None = None) -> DataFrame:
    """``a, b`` of pairs that have a sig in common which too many records of ``met`` have: they meet on it and one, then two others.

    ``lists_of`` gives the whole lists of the records in a membership map. Without ``reach`` the sig is the pair's first common element, and the others come after it, among the first ``base`` + 2
    and + 3; with it all of them are among the first ``base`` + ``reach``, and the others may come before it.
    """
    spark = met.sparkSession
    rows = met.where("m = 0")
    if rows.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    many = cut(rows.select(F.col("a").alias("sig")).distinct())
    of = cut(rows.select(F.col("b").alias("h")).distinct())
    lists = cut(lists_of(spark.sparkContext.broadcast(membership(of))).join(of, "h", "left_semi").distinct())
    here = cut(lists.where(F.col("place") < F.col("base") + (reach or 1)).join(many, "sig", "left_semi"))
    # equal small sets are similar, all of them; where no more can be asked, all go on
    last = here.where(F.col("kind") == WHOLE) if depth > 1 else here
    last = last.select("sig", "h", "meta")
    state = here.where(F.col("kind") != WHOLE).select("sig", "h", "meta", "base", "kind", F.col("place").alias("first"), (F.lit(-1) if reach else F.col("place")).alias("place"))
    found = spark.createDataFrame([], "a long, b long")
    for k in range(2, depth + 1):
        more = lists.select("h", "kind", F.col("place").alias("place2"), F.col("sig").alias("sig2"))
        fits = (F.col("place2") > F.col("place")) & (F.col("place2") != F.col("first")) & (F.col("place2") < F.col("base") + (reach or k))
        state = cut(state.join(more, ["h", "kind"]).where(fits).select(F.xxhash64("sig", "sig2").alias("sig"), "h", "meta", "base", "kind", "first", F.col("place2").alias("place")))
        met = cut(meet(state, match, parts_for(spark, state.count()), most))
        found = found.union(met.where("m > 0").select("a", "b"))
        state = state.join(met.where("m = 0").select(F.col("a").alias("sig")).distinct(), "sig", "left_semi")
    last = cut(last if depth == 1 else last.union(state.select("sig", "h", "meta")))
    # what is left has as many elements in common as can be asked and meets in blocks: each of a sig's blocks with each, so
    # that no task has all of it
    blocks = last.groupBy("sig").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("h", F.lit("block")), F.col("blocks").cast("long")).cast("int")
    spread = last.join(blocks, "sig").select("sig", "h", "meta", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select(F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("sig"), "h", "meta")
    return found.union(meet(spread, match, parts_for(spark, last.count()), None).select("a", "b"))


#: Bytes of each shingle's hash in the full check.
KEPT = 6


def _pack(s: np.ndarray) -> bytes:
    """The lower KEPT bytes of each shingle's hash: two shingles of a pair that differ look alike once in 2^48 tries."""
    unused = _U(64 - 8 * KEPT)
    return np.sort(s << unused >> unused).view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(b, np.uint8).reshape(-1, KEPT)
    return out.view(np.int64).ravel()


#: log2 of the bits of a membership map; it has that size whatever is put in, and lets all pass when it is full.
MAP_BITS = 26


def membership(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes in a map of fixed size (8 MB), put together by an aggregate: no hash reaches the driver."""
    place = F.shiftrightunsigned("h", 64 - MAP_BITS)
    words = hashes.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - MAP_BITS}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << MAP_BITS - 6, np.int64)
    out[np.asarray(words.column("w").combine_chunks())] = np.asarray(words.column("b").combine_chunks())
    return out.view(_U)


def known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> _U(64 - MAP_BITS)
    return bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1) == 1


def record_sets(texts: DataFrame, sim: Similarity, only: DataFrame) -> DataFrame:
    """``src, key, h, shingles`` of each record whose ``h`` is in ``only``; of equal ones in a task only the first has its shingles.

    A membership map of fixed size keeps most other records from being packed and shuffled; the join drops the rest.
    """
    bits = texts.sparkSession.sparkContext.broadcast(membership(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, names, _, h, s, owner, new in once_a_task(text_batches(batches, sim.words, lambda h: known(bits.value, h))):
            at = np.searchsorted(owner, np.arange(len(h) + 1))
            rows = np.flatnonzero(h != 0)
            packed = [_pack(s[at[i] : at[i + 1]]) if new[i] else None for i in rows]
            yield pa.record_batch([pa.array(names[rows], pa.string()), pa.array(keys[rows], pa.int64()), pa.array(h[rows].view(np.int64)), pa.array(packed, pa.binary())], ["src", "key", "h", "shingles"])

    return texts.select("src", "key", "text").mapInArrow(run, "src string, key long, h long, shingles binary").join(only, "h").select("src", "key", "h", "shingles")


#: Longs of a record's sketch.
SKETCH = 4


def sketches(texts: DataFrame, sim: Similarity, only: DataFrame) -> DataFrame:
    """``h, size, s0, s1, ...`` of each record whose ``h`` is in ``only``: every shingle turns one bit of the sketch over, so sets that differ in d places have sketches that differ in d bits at most."""
    bits = texts.sparkSession.sparkContext.broadcast(membership(only))
    names = ["h", "size", *[f"s{i}" for i in range(SKETCH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, h, s, owner, new in once_a_task(text_batches(batches, sim.words, lambda h: known(bits.value, h))):
            n, wide = len(h), 64 * SKETCH
            turned = np.bincount(owner * wide + (s % _U(wide)).astype(np.int64), minlength=n * wide).reshape(n, wide) & 1
            sketch = np.packbits(turned.astype(np.uint8), axis=1).view(np.int64)[new]
            yield pa.record_batch([pa.array(x) for x in (h[new].view(np.int64), np.bincount(owner, minlength=n)[new], *np.ascontiguousarray(sketch.T))], names)

    return texts.select("src", "key", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def fitting(pairs: DataFrame, sketched: DataFrame, sim: Similarity) -> DataFrame:
    """``a, b`` of ``pairs`` whose sketches don't differ in more bits than the sets may: all that are similar, and few others."""
    names = sketched.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *c = (np.asarray(batch.column(i)) for i in range(2 + 2 * len(names)))
            (n, *x), (m, *y) = c[: len(names)], c[len(names) :]
            apart = sum(np.bitwise_count((p ^ q).view(_U)).astype(np.int64) for p, q in zip(x, y, strict=True))
            keep = np.flatnonzero(apart <= sim.tau(n, m))
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    x, y = (sketched.select(F.col("h").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")
    both = pairs.join(x, "a").join(y, "b")
    return both.select("a", "b", *[f"{side}_{c}" for side in "ab" for c in names]).mapInArrow(run, "a long, b long")


def sequences(texts: DataFrame) -> DataFrame:
    """``src, key, h``: the hash of the word sequence of each record with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, names, _, h, _, _ in text_batches(batches, 0):
            rows = np.flatnonzero(h != 0)
            yield pa.record_batch([pa.array(names[rows], pa.string()), pa.array(keys[rows], pa.int64()), pa.array(h[rows].view(np.int64))], ["src", "key", "h"])

    return texts.select("src", "key", "text").mapInArrow(run, "src string, key long, h long")


def verified(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """``a, b`` of ``pairs`` whose whole sets are similar; ``sets`` has ``h, shingles``, one row a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            ok = []
            for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True):
                u, v = unpack(p), unpack(q)
                both = np.concatenate([u, v])
                both.sort()
                ok.append(sim.holds(int((both[1:] == both[:-1]).sum()), len(u), len(v)))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([a.filter(keep), b.filter(keep)], ["a", "b"])

    x = sets.select(F.col("h").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("h").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


@dataclass
class Near:
    """Similar classes of equal word sequences (``a, b``) and the records (``src, key, h``) of these classes."""

    pairs: DataFrame
    members: DataFrame


def near_classes(texts: DataFrame, sim: Similarity, most: int = MEET) -> Near:
    """All pairs of different word sequences whose shingle sets are similar, within each source.

    Null texts, texts of fewer than LEAST_WORDS words and rows without a key are in no pair; rows with one key count
    once; an empty table gives no pairs. Word sequences stand for all their copies, so a group of copies costs one row.
    """
    texts = texts.select("src", "key", "text")
    tried = cut(candidates(texts, sim, most))
    of = cut(tried.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    # whole sets go with pairs only where the sketches leave it open
    found = cut(fitting(tried, sketches(texts, sim, of).join(of, "h", "left_semi"), sim))
    needed = cut(found.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    records = cut(record_sets(texts, sim, needed).groupBy("src", "key", "h").agg(F.min("shingles").alias("shingles")))
    sets = records.where("shingles is not null").groupBy("h").agg(F.min("shingles").alias("shingles"))
    return Near(cut(verified(found, sets, sim)), records.select("src", "key", "h"))


def near_pairs(texts: DataFrame, sim: Similarity, most: int = MEET) -> DataFrame:
    """``src, key_a, key_b``, key_a < key_b: all pairs of records that differ and are similar."""
    near = near_classes(texts, sim, most)
    a = near.members.select(F.col("src"), F.col("key").alias("x"), F.col("h").alias("a"))
    b = near.members.select(F.col("key").alias("y"), F.col("h").alias("b"))
    both = near.pairs.join(a, "a").join(b, "b")
    return both.select("src", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).where("key_a < key_b").distinct()


def near_groups(texts: DataFrame, sim: Similarity) -> DataFrame:
    """``src, key, group_key, links``: each record that has a similar one, the smallest key of its group and the number of word sequences its own is similar to."""
    near = near_classes(texts, sim)
    comp = connected_components(near.pairs)
    links = near.pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    named = near.members.join(comp.join(links, "node"), F.col("h") == F.col("node"))
    least = named.groupBy("component").agg(F.min("key").alias("group_key"))
    return named.join(least, "component").select("src", "key", "group_key", "links")
