"""Problems 4 to 6 against brute force, on random edits and odd rows."""

import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import copies, near, overlap
from codeloom.llm.words import Folder, same_words, shingles

WORD = re.compile(r"\w+")
SCHEMA = "src string, key long, text string"


def words(t):
    return WORD.findall(t.lower())


def sets(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, num, den, n):
    out = set()
    live = [(s, k, words(t), sets(t, n)) for s, k, t in rows if t is not None and len(words(t)) >= 10]
    for i, (s, k, w, a) in enumerate(live):
        for s2, k2, w2, b in live[:i]:
            if s == s2 and k != k2 and w != w2 and len(a & b) * den >= num * len(a | b):
                out.add((s, min(k, k2), max(k, k2)))
    return out


def made(seed, n):
    """Families of edited copies, with hot phrases that many records share, short, long, null and repeated ones."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, key = [], 0
    for _ in range(n):
        size = r.choice([3, 10, 11, 14, 30, 60, 120, 300])
        base = [r.choice(vocab) for _ in range(size)]
        if r.random() < 0.5:
            base[2:2] = ["for", "int", "i", "0", "i", "n", "i"] * r.choice([1, 1, 5])
        for _ in range(r.choice([1, 1, 2, 4])):
            w = base[:]
            for _ in range(int(len(w) * r.choice([0, 0.02, 0.05, 0.1]))):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.2:
                w = w[: len(w) * 4 // 5]
            rows.append((r.choice(["functions_raw", "cs"]), key, " ".join(x.upper() if r.random() < 0.05 else x for x in w)))
            key += 1
    same = " ".join(["same"] * 30)
    rows += [("cs", key, None), ("cs", key + 1, ""), ("cs", key + 2, same), ("cs", key + 3, same + " same"), ("cs", key + 4, "a b " * 20), ("cs", key + 5, "b a " * 20), ("cs", key + 6, "x " * 50_000)]
    return rows + rows[:5]


@pytest.mark.parametrize(("seed", "sim"), [(1, near.Similarity(7, 10, 3)), (2, near.Similarity(8, 10, 5)), (3, near.Similarity(5, 10, 3))])
def test_near_pairs(spark, seed, sim, monkeypatch):
    monkeypatch.setattr(near, "FREQUENT_LEAST", 5)
    rows = made(seed, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(r) for r in near.near_pairs(df, sim).collect()}
    assert got == brute(set(rows), sim.num, sim.den, sim.words)


@pytest.mark.parametrize(("seed", "sim"), [(1, near.Similarity(7, 10, 3)), (2, near.Similarity(8, 10, 5)), (3, near.Similarity(5, 10, 3))])
def test_near_pairs_meet_deeper_where_many_share_a_segment(spark, seed, sim, monkeypatch):
    monkeypatch.setattr(near, "CHUNK_ROWS", 50)
    rows = made(seed, 100) + [("cs", 5000 + i, "all of these begin with one phrase that is the same and then go on " + " ".join(f"u{i}x{j}" for j in range(i % 7))) for i in range(40)]
    got = {tuple(r) for r in near.near_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), sim, 3).collect()}
    assert got == brute(set(rows), sim.num, sim.den, sim.words)


def test_groups(spark):
    rows = made(5, 60)
    got = {(r.src, r.key): (r.group_key, r.links) for r in near.near_groups(spark.createDataFrame(rows, SCHEMA), near.Similarity()).collect()}
    links = {}
    for s, a, b in brute(set(rows), 8, 10, 5):
        links.setdefault((s, a), set()).add((s, b))
        links.setdefault((s, b), set()).add((s, a))
    assert set(got) == set(links)
    for k, others in links.items():
        assert all(got[k][0] == got[o][0] for o in others) and got[k][0] <= k[1]
    assert near.near_groups(spark.createDataFrame([], SCHEMA), near.Similarity()).count() == 0


def test_hot_copies(spark):
    """A group of copies with a third of all rows costs one class."""
    base = " ".join(f"t{i}" for i in range(40))
    rows = [("cs", i, base + " " * (i % 3)) for i in range(300)] + [("cs", 1000, base + " extra")] + [("cs", 2000 + i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(600)]
    got = near.near_pairs(spark.createDataFrame(rows, SCHEMA), near.Similarity(7, 10, 3))
    assert got.count() == 300 and got.select("key_b").distinct().count() == 1


@pytest.mark.parametrize("most", [1000, 3])
def test_overlaps(spark, most):
    """Against brute force; with 3 many n-grams have too many records to meet on one alone."""
    rows = made(9, 100)
    df = spark.createDataFrame(rows, SCHEMA)
    r = random.Random(4)
    member = {(s, k, x) for s, k, _ in rows for x in r.choice([(), ("train",), ("train",), ("valid",), ("test",), ("train", "test")])}
    m = spark.createDataFrame(sorted(member), "src string, key long, split string")
    split = {}
    for s, k, x in member:
        split.setdefault((s, k), set()).add(x == "train")
    both = brute(set(rows), 7, 10, 3)
    live = {(s, k): words(t) for s, k, t in rows if t is not None and len(words(t)) >= 10}
    both |= {(s, min(k, k2), max(k, k2)) for (s, k), w in live.items() for (s2, k2), w2 in live.items() if s == s2 and w == w2}
    want = {(s, a, b) for s, a, b in both if (True in split.get((s, a), ()) and False in split.get((s, b), ())) or (False in split.get((s, a), ()) and True in split.get((s, b), ()))}
    assert {tuple(x) for x in overlap.pairs(df, m, near.Similarity(7, 10, 3), most).collect()} == want
    report = overlap.report(df, m, near.Similarity(7, 10, 3), most).collect()
    hit = {(s, k) for s, a, b in want for k, o in ((a, b), (b, a)) if False in split[s, k] and True in split[s, o]}
    assert sum(x.overlapping for x in report) == sum(x != "train" and (s, k) in hit for s, k, x in member)
    assert sum(x.records for x in report) == sum(x != "train" for _, _, x in member)
    assert overlap.pairs(df.limit(0), m.limit(0), near.Similarity()).count() == 0


def test_split_names(spark):
    df = spark.createDataFrame([(x,) for x in ("Train ", "DEV", "test", None, "holdout", "valid")], "s string")
    assert [r[0] for r in df.select(overlap.split_name(F.col("s"))).collect()] == ["train", "valid", "test", None, None, "valid"]


def test_copies(spark):
    r = random.Random(3)
    rows = [(s, k, t) for s, k, t in made(11, 80)]
    key = 10_000
    for s, _, t in rows[:40]:
        if t:
            rows.append((s, key, re.sub(r" ", lambda _: r.choice([" ", "\n", " ; ", "\t,"]), t).swapcase()))
            key += 1
    payload = {"func": "int main ( a b c d e f g h ) ;", "target": 1, "note": "N o", "project": None}
    raw = [("raw_records", 1, json.dumps(payload)), ("raw_records", 2, json.dumps(dict(reversed(payload.items())), indent=1)), ("raw_records", 3, json.dumps(payload | {"func": "INT main(a,b,c,d,e,f,g,h)", "target": 1.0})),
           ("raw_records", 4, json.dumps(payload | {"target": 2})), ("raw_records", 5, "{bad"), ("raw_records", 6, "[1]"), ("raw_records", 7, json.dumps({k: v for k, v in payload.items() if k != "note"})), ("raw_records", 8, json.dumps(payload | {"target": "1"})), ("raw_records", 9, json.dumps({"func": "a b"})), ("raw_records", 10, json.dumps({"func": "a b"}))]
    got = {tuple(x) for x in copies.copies(spark.createDataFrame(rows + raw, SCHEMA)).collect()}
    first, want = {}, {("raw_records", 1, 2), ("raw_records", 1, 3)}
    for s, k, t in sorted(set(rows), key=lambda x: x[1]):
        if t is not None and len(words(t)) >= 10:
            keep = first.setdefault((s, tuple(words(t))), k)
            if keep != k:
                want.add((s, keep, k))
    assert got == want
    kept = copies.collapsed(spark.createDataFrame(rows + raw, SCHEMA)).collect()
    assert sum(x["copies"] for x in kept) == len({(s, k) for s, k, _ in rows + raw})
    assert copies.copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lying_hashes(spark, monkeypatch):
    """Records whose hashes agree by accident are told apart by their words."""
    real = copies.fingerprints
    monkeypatch.setattr(copies, "fingerprints", lambda t: real(t).withColumn("h1", F.lit(1).cast("long")).withColumn("h2", F.lit(1).cast("long")))
    a, b = " ".join("abcdefghijkl"), " ".join("mnopqrstuvwx")
    c = "third " * 12
    raw = [("raw_records", i, json.dumps({"func": t, "n": 1})) for i, t in ((1, a), (2, b), (3, b.upper() + "."), (4, a + "!"))]
    df = spark.createDataFrame([("cs", 1, a), ("cs", 2, b), ("cs", 3, a.upper()), ("cs", 4, b + " !"), ("cs", 5, c), ("cs", 6, c), *raw], SCHEMA)
    assert {tuple(r) for r in copies.copies(df).collect()} == {("cs", 1, 3), ("cs", 2, 4), ("cs", 5, 6), ("raw_records", 1, 4), ("raw_records", 2, 3)}


def test_same_words_over_blocks():
    long = "ab_1 \u0130x \u03a3\u03a3 " * 2000
    assert same_words(long, long.replace(" ", " ;\n")) and not same_words(long, long + "z") and not same_words(long[:-2] + "q", long)
    assert same_words("a" * 9000, "A" * 9000) and not same_words("a" * 9000, "a" * 8191 + " " + "a" * 809) and same_words("", " ;") and not same_words("", "a")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB_9 ;\n\u0130\u03a3\u03c3\u03c2\u00df\u00c4\u4e2d\u0e01\u0301\U0001d7d8")), max_size=40), max_size=6))
def test_folding(texts):
    h1, h2, n = Folder().hashes(texts)
    w, rec, m, seq = Folder().word_hashes(texts)
    assert n.tolist() == m.tolist() == [len(words(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            same = words(a) == words(b)
            assert ((h1[i], h2[i]) == (h1[j], h2[j])) == same == same_words(a, b) == (seq[i] == seq[j])
    flat = [x for t in texts for x in words(t)]
    assert len(w) == len(flat) and [[a == b for b in flat] for a in flat] == (w[:, None] == w[None, :]).tolist()
    s, o = shingles(w, rec, 2)
    assert [int((o == i).sum()) for i in range(len(texts))] == [len(sets(t, 2)) for t in texts]
    assert np.all(np.diff(o) >= 0)


@given(st.lists(st.integers(0, 2000)))
def test_steps_come_back(cells):
    cells = np.sort(np.array(cells, np.int64))
    assert near.unpack_steps(near.pack_steps(cells)).tolist() == cells.tolist()


def test_shingles_are_counted_on_all_records(spark):
    """More records than the sample of 50,000 that counts once came from; 1,000 of them share a phrase, 100 another."""
    n = 60_000
    own = [F.concat(F.lit(f"w{i}x"), "id") for i in range(7)]
    shared = F.when(F.col("id") < 1000, "one two three").when(F.col("id") >= n - 100, "four five six").otherwise(F.concat(F.lit("a"), "id", F.lit(" b"), "id", F.lit(" c"), "id"))
    texts = spark.range(n).select(F.lit("cs").alias("src"), F.col("id").alias("key"), F.concat_ws(" ", *own, shared).alias("text"))
    hot = near.frequent_shingles(texts, near.Similarity(7, 10, 3))
    w, rec, _, _ = Folder().word_hashes(["one two three", "four five six", "w0x7 w1x7 w2x7"])
    s, owner = shingles(w, rec, 3)
    at = hot.of(s ^ near._tag("cs"))
    assert hot.records == n and owner.tolist() == [0, 1, 2]
    # a cell has a count of its own and that of a few others
    assert all(near._scaled(np.array(c)) <= a <= near._scaled(np.array(c + 12)) for a, c in zip(at, (1000, 100, 1), strict=True))
    assert at[0] >= hot.many > at[2]


def test_sketches_leave_similar_pairs_only(spark):
    """Sets that can't be similar are told apart before whole sets travel with pairs; none that are similar is lost."""
    rows, sim = made(3, 25), near.Similarity(7, 10, 3)
    r = random.Random(4)
    rows += [("cs", 10_000 + i, " ".join(f"v{r.randrange(5000)}" for _ in range(150))) for i in range(30)]
    texts = spark.createDataFrame(rows, SCHEMA)
    by = near.sequences(texts).select("src", "key", "h").distinct()
    pairs = by.join(by.select("src", F.col("key").alias("k"), F.col("h").alias("b")), "src").where("h < b")
    sk = near.sketches(texts, sim, by.select("h").distinct())
    left = near.fitting(pairs.select(F.col("h").alias("a"), "b").distinct(), sk, sim)
    key = {(x.src, x.h): x.key for x in by.collect()}
    kept = {(x.a, x.b) for x in left.collect()}
    of = {(x.src, x.key): x.h for x in by.collect()}
    wanted = brute(rows, 7, 10, 3)
    assert wanted and {tuple(sorted((of[s, a], of[s, b]))) for s, a, b in wanted} <= kept
    random_ones = {h for (_, h), k in key.items() if k >= 10_000}
    assert len(random_ones) == 30 and not any(a in random_ones or b in random_ones for a, b in kept)
