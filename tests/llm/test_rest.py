"""Problems 2, 3, 7, 8 and 9 on small and odd input."""

import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.llm import joins, mixing, packing, sentences, splits, terms, tokens

COMMIT = "abcdef0123456789abcdef0123456789abcdef01"


def test_project_names(spark):
    rows = [(" Own/Repo.git ", "repo"), ("https://h.example/o/Repo/", "repo"), ("git@h.example:o/repo.git", "repo"), ("REPO\n", "repo"), ("n/a", None), ("-", None), ("", None), ("  ", None), (None, None), ("Unknown", None), ("x.git/", "x")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "p string")
    assert [r[0] for r in df.select(splits.bare_project(F.col("p"))).collect()] == [b for _, b in rows]


def test_groups(spark):
    rows = [(1, "a", COMMIT), (2, "b", COMMIT[:9].upper()), (3, "o/B.git", None), (4, None, COMMIT + "\n"), (5, None, "1234567"), (6, "n/a", "0000000"), (7, "c", "12345678"), (8, None, None), (9, None, "fffffff1"), (9, None, "fffffff1")]
    df = spark.createDataFrame([(*r, i % 2, "x") for i, r in enumerate(rows)], "pos int, project string, commit_id string, target int, group_key string")
    got = sorted((r.pos, r.group_key) for r in splits.groups(df).collect())
    assert got == [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "c"), (6, None), (7, "c"), (8, None), (9, "fffffff1"), (9, "fffffff1")]
    share = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, share double")
    done = splits.splits(df, share)
    assert done.count() == 10 and done.where("group_key is not null").groupBy("group_key").agg(F.count_distinct("split_name").alias("n")).agg(F.max("n")).first()[0] == 1
    assert splits.splits(df.limit(0), share).count() == 0


def test_shares_are_met(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, f"p{int(r.paretovariate(0.7)) % 300}", None, r.choice([0, 1, None])) for i in range(6000)], "pos int, project string, commit_id string, target int")
    share = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split_name string, share double")
    a = splits.splits(df.repartition(3), share)
    n = {x.split_name: x["count"] for x in a.groupBy("split_name").count().collect()}
    assert abs(n["valid"] - 600) < 60 and abs(n["test"] - 600) < 60 and sum(n.values()) == 6000
    b = splits.splits(df.repartition(7), share)
    assert a.exceptAll(b).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in joins.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_join_unique(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(9999, None)], "id int, k string")
    small = spark.createDataFrame([("hot", 2000, "H"), *[(f"k{i}", 1, f"v{i}") for i in range(0, 1500, 3)]], "k string, n long, v string")
    got = {x.id: x.v for x in joins.join_unique(big, small, "k", "n", F.col("id")).collect()}
    assert len(got) == 3001 and got[1] == "H" and got[0] == "v0" and got[2997] is None and got[9999] is None


def ngrams(rows, sigma):
    tf, df = Counter(), Counter()
    for t in rows:
        w = terms.terms_of(t)
        grams = [tuple(w[i : i + k]) for k in range(1, sigma + 1) for i in range(len(w) - k + 1)]
        tf.update(grams)
        df.update(set(grams))
    return {g: (n, df[g]) for g, n in tf.items()}


@pytest.mark.parametrize("sigma", [1, 2, 4])
def test_ngram_counts(spark, sigma):
    r = random.Random(sigma)
    rows = [[r.choice(["the", "The", "a", "\u0120the", "\u2581x y", ".", "", None, "caf\u00e9", "cafe\u0301", "\x01z"]) for _ in range(r.randrange(12))] for _ in range(300)] + [None, [], [None]]
    df = spark.createDataFrame([(x,) for x in rows], "t array<string>").repartition(4)
    got = {tuple(x.gram): (x.occurrences, x.records) for x in terms.ngram_counts(df, "t", sigma).collect()}
    assert got == ngrams(rows, sigma)


def test_marks(spark):
    rows = [(i, ["Common", "rare"] if i < 2 else ["common"] if i < 6 else ["mid"] if i < 9 else None) for i in range(20)]
    df = spark.createDataFrame(rows + rows, "idx long, docstring_tokens array<string>")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.term_marks(df, "idx", "docstring_tokens").collect()}
    assert got == {"common": (6, 6, "common"), "rare": (2, 2, "rare"), "mid": (3, 3, None)}
    assert terms.term_marks(df.limit(0), "idx", "docstring_tokens").count() == 0
    assert unicodedata.is_normalized("NFC", terms.terms_of(["E\u0301"])[0])


DOCS = "doc_id long, text string, source string, capacity int, tokens int"


def docs(spark, n, seed=0):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "x1", "\u4e2d\u6587", "return"]) for _ in range(int(r.paretovariate(0.8) * 5) % 900)), r.choice(["Review", "review ", "read-me", "read me", None, "rare"] if r.random() < 0.9 else ["rare"]), 1, 2) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "review", 1, 2), (n + 1, "", "review", 1, 2), (n + 2, "word " * 3000, "review", 1, 2)], DOCS)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ITEMS", 150)  # several parts and rounds
    df = docs(spark, 700)
    kinds = spark.createDataFrame([("small", 64), ("large", 1000), ("none", None), ("zero", 0), ("small", 64)], "container_kind string, capacity int")
    rows = packing.containers(df, kinds).collect()
    size = {r.doc_id: r.tokens for r in tokens.sizes(df).collect() if r.tokens}
    for kind, capacity in (("small", 64), ("large", 1000)):
        own = [r for r in rows if r.container_kind == kind]
        got, room = Counter(), Counter()
        for r in own:
            got[r.doc_id] += r.tokens
            room[r.container_id] += r.tokens
            assert r.first_token == r.piece * capacity
        assert got == size and max(room.values()) <= capacity
        assert all(n == 1 or size[d] > capacity for d, n in Counter(r.doc_id for r in own).items())
        assert sum(size.values()) / (len(room) * capacity) > 0.93
    assert {r.container_kind for r in rows} == {"small", "large"}
    again = packing.containers(df.repartition(5), kinds).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)
    assert {r.fault: r.n for r in packing.faults(spark.createDataFrame(rows), df, kinds).collect()} == {"over_capacity": 0, "not_whole_once": 0, "cut_though_it_fits": 0}
    assert packing.containers(df.limit(0), kinds).count() == 0 and packing.containers(df, kinds.limit(0)).count() == 0


def test_windows_have_the_target_proportions(spark):
    """Two sources of equal supply, drawn on three to one as long as both last."""
    df = spark.createDataFrame([(i, " ".join(["word"] * (i % 9 + 1)), "a" if i % 2 else "b") for i in range(8000)], "doc_id long, text string, source string")
    kinds = spark.createDataFrame([("k", 32)], "container_kind string, capacity int")
    targets = spark.createDataFrame([("A", 0.75), ("b ", 0.25), ("absent", 0.5), (None, 0.5)], "source string, target_share double")
    laid = packing.containers(df, kinds, targets=targets)
    got = {r.source: r for r in packing.mixture(laid, targets).collect()}
    assert abs(got["a"].share - 0.75) < 0.01 and got["a"].off < 0.05 and got["a"].target_share == 0.75
    assert packing.faults(laid, df, kinds).where("n > 0").count() == 0
    even = {r.source: r.t for r in packing.containers(df, kinds).where("drew_on_all").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert abs(even["a"] / (even["a"] + even["b"]) - 0.5) < 0.02


def test_documents_whose_chance_passes_one_are_certain(spark):
    df = spark.createDataFrame([(0, "word " * 2000, "a"), *[(i, "word " * 10, "a") for i in range(1, 401)], *[(1000 + i, "word " * 10, "b") for i in range(300)]], "doc_id long, text string, source string")
    target = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, target)
    assert 0 in {r.doc_id for r in got.copies.collect()}
    assert all(r.n == 0 for r in mixing.limits(got, target).collect())
    assert mixing.rates(spark.createDataFrame([("a", 900), ("a", 100), ("a", 100)], "source string, tokens long"), [("a", 0, 1000.0)]) == [("a", 0, 100.0, 0.05, pytest.approx(1 / (1000 / (900**1.5 + 2000)) ** 2))]


def test_mixing(spark):
    df = docs(spark, 4000, 3)
    target = spark.createDataFrame([("review", 0.5, 2), ("read_me", 0.3, 3), ("absent", 0.1, 9), ("rare", 0.1, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, target)
    rows = got.copies.collect()
    most = {"review": 2, "read_me": 3, "rare": 1}
    assert all(1 <= r["copies"] <= most[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    share = {r.source: r.share for r in got.shares.collect()}
    for s, w in (("review", 0.5 / 0.9), ("read_me", 0.3 / 0.9), ("rare", 0.1 / 0.9)):
        assert abs(share[s] - w) < 0.02
    assert share["absent"] == 0 and sorted(map(tuple, mixing.mix(df.repartition(9), target).copies.collect())) == sorted(map(tuple, rows))
    assert mixing.mix(df.limit(0), target).copies.count() == 0 and mixing.mix(df, target.limit(0)).copies.count() == 0


def test_token_counts():
    assert tokens.count("") == 0
    long = "ab c " * 60_000
    assert tokens.count(long) == len(tokens.encoder(tokens.TOKENIZER).encode_ordinary(long))
    assert tokens.count("x" * 50_000) > 0
    for text in ("\u4e2d\u6587\u5b57\u3002" * 60_000, "\u0e01\u0e32\u0e23 x" * 50_000, "a1" * 120_000, "it's 12 km.\n\n  x" * 20_000):
        assert tokens.count(text) == len(tokens.encoder(tokens.TOKENIZER).encode_ordinary(text))


CASES = [
    ("Dr. Smith paid 3.5 ms. He left.", ["Dr. Smith paid 3.5 ms.", "He left."]),
    ('"Is it empty?" asked the reviewer. (See ch. IV.) It printed "Done." He left...', ['"Is it empty?" asked the reviewer.', "(See ch. IV.)", 'It printed "Done."', "He left..."]),
    ("# Title\n\nText goes\non here. Next!\n \n- one a. b\n- two\n  1. x", ["# Title", "Text goes\non here.", "Next!", "- one a. b", "- two", "1. x"]),
    ("\u4ed6\u95ee\uff1a\u201c\u662f\u7a7a\u7684\u5417\uff1f\u201d\u8bf7\u770bx.c\u7b2c1\u884c\u3002\u4ed6\u8bf4\uff1a\u300c\u5148\u5220\uff01\u518d\u770b\u3002\u300d\u7136\u540e\u63d0\u4ea4\u4e86\u3002", ["\u4ed6\u95ee\uff1a\u201c\u662f\u7a7a\u7684\u5417\uff1f\u201d", "\u8bf7\u770bx.c\u7b2c1\u884c\u3002", "\u4ed6\u8bf4\uff1a\u300c\u5148\u5220\uff01\u518d\u770b\u3002\u300d\u7136\u540e\u63d0\u4ea4\u4e86\u3002"]),
    ("Der 2. Lauf kostet z. B. 3 s. Am 3. Mai war es so.", ["Der 2. Lauf kostet z. B. 3 s.", "Am 3. Mai war es so."]),
    ("\u0395\u03af\u03bd\u03b1\u03b9 \u03ac\u03b4\u03b5\u03b9\u03b1; \u039c\u03b7 \u03c3\u03b2\u03ae\u03c3\u03b5\u03c4\u03b5!", ["\u0395\u03af\u03bd\u03b1\u03b9 \u03ac\u03b4\u03b5\u03b9\u03b1;", "\u039c\u03b7 \u03c3\u03b2\u03ae\u03c3\u03b5\u03c4\u03b5!"]),
    ("\u0e15\u0e23\u0e27\u0e08 x1 \u0e2d\u0e37\u0e48\u0e19 \u0e46 \u0e01\u0e48\u0e2d\u0e19 \u0e42\u0e04\u0e49\u0e14", ["\u0e15\u0e23\u0e27\u0e08 x1 \u0e2d\u0e37\u0e48\u0e19 \u0e46 \u0e01\u0e48\u0e2d\u0e19", "\u0e42\u0e04\u0e49\u0e14"]),
    ("\u092f\u0939 \u0928\u0939\u0940\u0902\u0964 \u0915\u094d\u092f\u093e?\n\n", ["\u092f\u0939 \u0928\u0939\u0940\u0902\u0964", "\u0915\u094d\u092f\u093e?"]),
    ("Le journal dit \u00ab\u00a0Non. R\u00e9essayez.\u00a0\u00bb avant l'arr\u00eat\u00a0! Bien.", ["Le journal dit \u00ab\u00a0Non. R\u00e9essayez.\u00a0\u00bb avant l'arr\u00eat\u00a0!", "Bien."]),
    ("It ended at 9 p.m. The tool, e.g. `a.b()`, ran. L. Doe's fix", ["It ended at 9 p.m.", "The tool, e.g. `a.b()`, ran.", "L. Doe's fix"]),
    ('He said "no. And left. The end (of it.', ['He said "no.', "And left.", "The end (of it."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.offsets(text)] == want


def test_long_texts_take_linear_time():
    import time

    for text in ("e.g. so " * 60_000, "(\"" * 30_000 + "a. B", "\u00e4 ; " * 50_000, "'a (b \u201c c] " * 20_000, "1. x\n" * 40_000, "\u4e2d\u2026\u2026" * 50_000):
        began = time.perf_counter()
        sentences.offsets(text)
        assert time.perf_counter() - began < 10


def test_sentences_cover_everything(spark):
    r = random.Random(7)
    marks = list("aA1 .!?\n\"'()\u201c\u201d\u201e\u00ab\u00bb\u3002\uff1f\u300c\u300d\u0e01 \u0964;\u2026-*`\r\t") + ["\n\n", "e.g. ", "Dr. ", "- ", "2) "]
    for _ in range(3000):
        text = "".join(r.choice(marks) for _ in range(r.randrange(60)))
        at = 0
        for a, b in sentences.offsets(text):
            assert at <= a < b and not text[at:a].strip() and text[a:b] == text[a:b].strip()
            at = b
        assert not text[at:].strip()
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n ", 0), (4, "A. " * 30_000, 0), (5, "One. Two.", 9), (5, "One. Two.", 9)], "doc_id long, text string, start_off int")
    got = Counter(x.doc_id for x in sentences.sentences(df).collect())
    assert got[5] == 4 and set(got) == {4, 5} and sentences.sentences(df.limit(0)).count() == 0
