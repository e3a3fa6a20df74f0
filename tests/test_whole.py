"""Queries that do the whole job: nothing is left out by a prefix, a subset or a cap."""

import hashlib

from codeloom.plans import registry


def run(spark, folder, name):
    return registry.queries()[name](spark, str(folder))


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_leave_one_out_reaches_every_token(spark, tmp_path):
    funcs = {i: "  int f(a,\tb)\n" + " ".join(f"w{i}x{j}" for j in range(60)) + "\n\u00e9nd  " for i in range(20)} | {20: "one", 21: "keep  it", 22: " \n ", 23: None}
    put(spark, tmp_path, "functions_raw", list(funcs.items()), "pos int, func string")
    got = {r.pos: r for r in run(spark, tmp_path, "leave_one_out").collect()}
    score = lambda t: int(hashlib.md5(f"lm:{t}".encode()).hexdigest()[:8], 16) % 1000
    assert sorted(got) == list(range(22))
    late = 0
    for pos, r in got.items():
        w = funcs[pos].split()
        sus = [(score(" ".join(w)) - score(" ".join(w[:i] + w[i + 1 :]))) / 100 for i in range(len(w))]
        kept = [x for x, s in zip(w, sus, strict=True) if s < 5]
        assert (r.most, r.kept, r.purified) == (round(max(sus), 6), len(kept), funcs[pos] if len(kept) == len(w) else " ".join(kept))
        late += max(sus) > max(sus[:8])
    assert late  # a prefix of eight words would miss these


def test_variants_of_every_row_with_code(spark, tmp_path):
    c = "int f(int n) {\n  int total = 0;\n  while (n > 0) {\n    total += n;\n    n--;\n  }\n  return total;\n}"
    long = c.replace("return", "/* " + "x" * 200 + " */\n  return")
    put(spark, tmp_path, "functions_raw", [(i, long if i >= 300 else c) for i in range(400)] + [(400, None)], "pos int, func string")
    put(spark, tmp_path, "function_meta", [(i, f"a/{i}.c") for i in range(399)] + [(400, "b.c")], "pos int, path string")
    got = {r.id: r for r in run(spark, tmp_path, "variant_code").collect()}
    assert len(got) == 401 * 12
    one = [got[f"C-350-{v}"] for v in range(12)]
    assert [r.kind for r in one] == ["clean", "dead", "dead", "suffix", "suffix", "style_11.3", "style_8.2", "style_4.4", "style_17.2", "style_mixed", "random", "llm_generated"]
    assert one[0].code == long and one[11].code == "" and one[0].split_index == 351
    assert all(r.ok and r.code != long for r in (one[1], one[2], one[3], one[4], one[5], one[9], one[10])) and len({r.code for r in one[:5]}) == 5
    assert got["CODE-399-3"].code == long and not got["CODE-399-3"].ok  # no path, so no language
    assert got["C-400-3"].code is None and got["C-400-11"].code == ""
    joined = {r.v: (r.n, r.with_tests) for r in run(spark, tmp_path, "variant_test_join").collect()}
    assert joined == {v: (401, 100) for v in (1, 3, 5, 9, 10)}


def test_batches_of_every_query_past_its_url(spark, tmp_path):
    url = {i: None if i in (7, 8) else "same" if i < 6 else f"u{i}" for i in range(60)}
    put(spark, tmp_path, "cs", [*url.items(), (9, "u9")], "idx bigint, url string")
    batches = {}
    for r in run(spark, tmp_path, "candidate_batches").collect():
        batches.setdefault(r.query_key, {})[r.place] = r.code_key
    assert sorted(batches) == list(range(60))
    for q, b in batches.items():
        assert sorted(b) == list(range(10)) and b[0] == q and len(set(b.values())) == 10
        assert all(url[c] != url[q] for p, c in b.items() if p)


def test_top_up_fills_the_quota(spark, tmp_path):
    put(spark, tmp_path, "functions_raw", [(i, i % 2) for i in range(2000)], "pos int, target int")
    got = [tuple(r) for r in run(spark, tmp_path, "oversample_topup").collect()]
    assert len(got) == len(set(got)) == 200 - 80  # a quota of 200, of which 80 are labelled
    assert all(1 <= c <= 4 for _, c in got) and len({p for p, _ in got}) <= 80
    put(spark, tmp_path / "few", "functions_raw", [(i, int(i < 10)) for i in range(2000)], "pos int, target int")
    assert run(spark, tmp_path / "few", "oversample_topup").count() == 40  # all copies, short of the quota


def test_shared_variants_go_on_to_the_quota(spark, tmp_path):
    rows = [(i, "if while for" if i % 7 == 0 else "if" if i % 7 else None, 1 if i < 2100 else 0) for i in range(3000)]
    put(spark, tmp_path, "functions_raw", rows, "pos int, func string, target int")
    got = {r.form: r for r in run(spark, tmp_path, "shared_variants").collect()}
    order = sorted(rows[:2100], key=lambda r: (hashlib.md5(f"q:{r[0]}".encode()).hexdigest(), r[0]))
    tried = copies = 0
    for _, func, _ in order:
        if copies < 300:
            tried, copies = tried + 1, copies + 3 * (func == "if while for")
    assert (got["train"].tried, got["train"].succeeded) == (tried, copies // 3) and tried > 200
    assert (got["test"].tried, got["test"].succeeded, got["test"].rate) == (2100, 300, round(300 / 2100, 6))
