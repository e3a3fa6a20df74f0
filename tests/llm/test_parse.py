"""Problem 1: the parser against real parsers where there are some, and odd input."""

import ast
import shutil
import subprocess

import pytest

from codeloom.llm import parse
from codeloom.llm.parsing.gll import Grammar

GOOD = {
    "c": ["static int f(struct x_ctx *ctx, unsigned int a) {\n#ifdef A\n  a = 1;\n#else\n  a = 2;\n#endif\n  char c = '\\'';\n  const char *s = \"a\"\n   \"b\";\n  for (int i = 0; i < a; i++) { if (a && i) break; }\n  do { a -= 2; } while (a > 0);\n  switch (a) { case 1: a = '}'; break; default: break; }\n  x_t *p = (x_t *)malloc(sizeof(x_t) * 3);\n  return a ? a << 2 : (int)p->q[1].r;\n}",
          "#if X\nint f(int a) {\n#else\nint f(long a) {\n#endif\n  /* <<<<<<< HEAD */\n  return a;\n}"],
    "cpp": ["int Box::get(const std::vector<std::pair<int, long>>& v, size_t n) const {\n  auto f = [&](int x) { return x << 2; };\n  std::cout << \"a\" << f(1) << std::endl;\n  std::map<int, std::vector<int>> m(3);\n  const char* s = R\"x(<<<<<<< {)x\";\n  for (auto& e : v) { if (e.first >= 2) continue; }\n  return static_cast<int>(n);\n}", "template <typename T> T add(T a, T b) { return a + b; }", "Box::Box(int a) : a_(a), b_{1} {}"],
    "java": ["private static long f(int[] a, Map<String, List<Integer>> m) throws IOException {\n  char c = '\"';\n  Runnable r = () -> { g(1); };\n  try { g(2); } catch (A | B e) { throw new X(\"a\", e); } finally { }\n  for (int x : a) { m.get(\"k\").forEach(y -> g(y)); }\n  int[] b = new int[]{1, 2};\n  return a.length > 0 ? (long) a[0] >>> 2 : 1L;\n}"],
    "python": ["def f(self, a, *b, c=1, **d):\n  \"\"\"Doc\n  <<<<<<< HEAD\n  \"\"\"\n  x = {**d, 'a': (1, 2)}\n  with open('f') as g, h() as (i, j):\n    return [y async for y in z if y] if a else lambda q, r=2: (q,\n   r)\n", "    def m(self):\n        print(f'{self.x:>4} {{')\n\n    def n(self):\n        pass\n"],
    "javascript": ["async function f(a, { b, ...c } = {}) {\n  const r = /[({]x\\//g\n  let s = `a ${g(`b ${1}`)} {`\n  const o = (x) => ({ k: x, 'q': [0,] })\n  for (const y of a) if (y) g(y)\n  else break\n  return a?.b ?? c\n}", "static async *gen(x) { yield* x; }"],
    "go": ["func (s *Box[T]) Get(a, b int, f func(int) error) (int, error) {\n\tdefer func() { g(0) }()\n\tm := map[string]int{\"a\": 1,\n\t}\n\tif err := g(1); err != nil {\n\t\treturn 0, err\n\t}\n\tswitch {\n\tcase a > 1:\n\t\ta++\n\tdefault:\n\t}\n\tfor i, x := range m { _ = x[i:] }\n\ts2 := `raw\n{`\n\treturn a, nil\n}"],
    "php": ["function f(?int $a, array &$b = [], ...$c): ?string {\n  $g = function ($x) use ($a) { return $x . \"{$a}\"; };\n  $h = <<<EOT\n  { (\n  EOT;\n  foreach ($b as $k => $v) { $b[] = $v->x?->y ?? self::Z; }\n  return $a ? 'x' : null;\n}"],
}

# what older and newer dialects of each language allow
DIALECTS = {
 "c": ["void f(void) { [[maybe_unused]] int x = 1; auto y = 1; switch (x) { case 1: y = 2; [[fallthrough]]; default: break; } }",
       "int f(a, b) int a; char *b; { return a; }",
       "int f(int a) {\n#ifdef A\n if (a) {\n#endif\n#ifndef A\n return a; }\n#else\n } return a; }\n#endif",
       "int g(int a) {\n#if A\n x(a);\n#elif B\n y(a);\n#else\n z(a);\n#endif\n return a;\n}",
       "static inline int f(const char *restrict p) { return _Generic(p, char *: 1, default: 0); }",
       "[[nodiscard]] int f(int n) { typeof(n) m = n; constexpr int k = 3; static_assert(sizeof(int) >= 2); return m + k; }"],
 "cpp": ["template <typename T> auto f(T v) { if constexpr (std::is_integral_v<T>) { return v; } else { return 0; } }",
         "auto operator<=>(const Box& o) const = default;", "bool f(int a, int b) { return (a <=> b) < 0; }",
         "template <typename T> concept Addable = requires(T a, T b) { a + b; { a + b } -> std::same_as<T>; typename T::value_type; };",
         "template <typename... A> auto sum(A... a) { return (a + ... + 0); }",
         "void f(std::integral auto x) { for (int i = 0; auto y : v) { g(x, y, i); } }",
         "int f(int x) { if (x > 0) [[likely]] { return 1; } return 0; }",
         "template <typename T> requires std::integral<T> T f(T a) { return a; }",
         "struct P { int x; template <typename Self> auto& get(this Self&& self) { return self.x; } explicit(true) P(int a) : x{a} {} };",
         "void f() { auto [a, b] = g(); if (auto it = m.find(a); it != m.end()) { h(it->second); } Point p{.x = 1, .y = 2}; }",
         "task f() { co_await g(); co_yield 1; co_return 2; }", "void f() { auto l = []<typename T>(T x) mutable noexcept -> int { return x; }; l(1); }"],
 "java": ["Object f(Object o) { return switch (o) { case Integer i when i > 0 -> i; case String s -> s; case null, default -> 0; }; }",
          "boolean f(Object o) { return o instanceof P(int x, int y) && x > y; }", "sealed interface S permits A, B {} \n non-sealed class A implements S {}",
          "record P(int x, int y) { P { if (x < 0) throw new X(); } static P of(int a) { return new P(a, a); } }",
          "int f(int d) { int k = switch (d) { case 1, 7 -> 6; case 2 -> { int t = d; yield t; } default -> 0; }; var when = 3; return k + when; }",
          "String f() { var s = \"\"\"\n  a \"b\"\n  \"\"\"; if (!(s instanceof String t)) { return null; } return t; }",
          "void f(Object o) { if (o instanceof Box<?>(var v) ) g(v); for (var e : m.entrySet()) h(e); }"],
 "python": ["def f(x):\n    return f\"{x[\"a\"]} {'b'!r:>{w}} {{\" + f'{g(f'{1}')}'\n", "def f(async_):\n    async = 1\n    return async\n", "def f(x):\n    match x:\n        case [1, *r] if r:\n            return r\n        case {'a': y, **z} | P(x=y):\n            pass\n        case _:\n            pass\n", "def f[T: int](x: T, /, *, y: T = 1) -> T:\n    type A = list[T]\n    return x\n", "try:\n    pass\nexcept* (A, B) as e:\n    pass\n", "with (open(a) as b, c() as d):\n    pass\n", "x = [y := 1, *a]\nprint(*a, **b, sep='')\n"],
 "javascript": ["import d from './x.json' with { type: 'json' };\nfunction f() { return d; }", "class A { static #x = 1; static { this.#x = 2; } get y() { return #x in this; } async *g() { for await (const v of h()) yield v; } }", "function f(a) { return a?.[0] ?? a?.b?.() ?? 1_000n; }", "const f = async ({ a = 1, ...b }) => { try { await g(a) } catch { return b } }", "export * as ns from 'a'\nexport default class {}", "label: for (;;) { break label }"],
 "go": ["func f(n int) int {\n\tfor range 10 {\n\t\tn++\n\t}\n\tfor i := range n {\n\t\t_ = i\n\t}\n\treturn min(n, 1)\n}", "func Map[T, U any](s []T, f func(T) U) []U {\n\tr := make([]U, 0, len(s))\n\treturn r\n}", "func (s *Sensor) F(a, b int, c ...string) (n int, err error) {\n\tswitch x := s.v.(type) {\n\tcase int, string:\n\t\t_ = x\n\t}\n\tselect {\n\tcase v, ok := <-ch:\n\t\t_, _ = v, ok\n\tdefault:\n\t}\n\tgo func() { ch <- 1 }()\n\treturn\n}", "type Num interface{ ~int | ~float64 }\nfunc g[T Num](x T) T { return x }"],
 "php": ["function f($a) { ?>\n<div class=\"x\"><?= $a ?></div>\n<?php return $a; }", "class P { public string $x { get => $this->x; set(string $v) { $this->x = $v; } } public private(set) int $y = 1; }", "#[A(1)] final readonly class Q { public function __construct(private int $a = new B(), protected ?C $c = null) {} }", "enum S: string { case A = 'a'; const X = self::A; public static function f(): static { return static::A; } }", "function f(int|string|null $x): (A&B)|null { return match(true) { $x > 1, $x < 0 => g(...), default => throw new E(), }; }", "function f() { if ($a): ?>\n<p>x</p>\n<?php endif; foreach ($b as ['k' => $v]) { echo $v; } }"],
}


@pytest.mark.parametrize(("language", "code"), [(k, c) for k, v in DIALECTS.items() for c in v])
def test_dialects(language, code):
    assert parse.parses(code, language)
    assert not parse.parses(code[: len(code) * 2 // 3].rstrip() + " (", language)


def test_branches_of_directives_fork():
    assert parse.parses("int f(int a) {\n" + "".join(f"#if A{i}\n  a = {i};\n#elif B{i}\n  a++;\n#else\n  if (a) {{ a--; }}\n#endif\n" for i in range(60)) + "  return a;\n}", "c")
    for bad in ("int f(int a) {\n#if A\n  return a;\n}", "int f(int a) {\n#else\n  return a;\n#endif\n}", "int f(int a) {\n#if A\n  return (a;\n#else\n  return a);\n#endif\n}"):
        assert not parse.parses(bad, "c")


@pytest.mark.parametrize(("language", "code"), [(k, c) for k, v in GOOD.items() for c in v])
def test_good_and_broken(language, code):
    assert parse.parses(code, language)
    if language != "python":
        assert not parse.parses(code.rstrip().rstrip("}"), language)
        assert not parse.parses(code + "\n}", language)
    assert not parse.parses("<<<<<<< HEAD\n" + code + "\n=======\n>>>>>>> x\n", language)
    assert not parse.parses(code[: len(code) * 2 // 3].rstrip() + " (", language)
    assert not parse.parses("Binary files a/b and c/d differ (too large to show here, see the archive)", language)


def test_languages_refuse_each_other():
    for a in GOOD:
        for b in GOOD:
            if a != b and (a, b) != ("c", "cpp"):
                assert not parse.parses(GOOD[a][0], b), (a, b)


def test_odd_input():
    for language in GOOD:
        for code in ("", " \n", "\x00", "\ud7ff\U0001f600", '"' * 99, "(" * 3000, "/*", "'''", "#", "a" * 100_000, "{" * 500 + "}" * 500):
            assert parse.parses(code, language) in (True, False)


@pytest.fixture(scope="module")
def codes(spark):
    from codeloom.sources.tables import table

    rows = parse.records(*(table(spark, "/root/testdata/sf0.01", n) for n in ("functions_raw", "function_meta", "cs"))).where("text is not null and length(text) > 60").collect()
    return [(r.language, r.text) for r in rows]


def test_python_like_the_real_parser(codes):
    for language, code in codes:
        if language == "python":
            try:
                ast.parse(code)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            assert parse.parses(code, "python") == ok, code


@pytest.mark.skipif(shutil.which("node") is None, reason="no node")
def test_javascript_like_the_real_parser(codes, tmp_path):
    for i, code in enumerate([c for lang, c in codes if lang == "javascript"][:60]):
        f = tmp_path / f"{i}.mjs"
        f.write_text(code)
        bad = "SyntaxError" in subprocess.run(["node", "--check", str(f)], capture_output=True, text=True, check=False).stderr
        assert parse.parses(code, "javascript") != bad, code


def test_deep_statements():
    assert parse.parses("int f(int a, int b) { " + "if (a) " * 4000 + "b = 1; }", "c")
    assert not parse.parses("int f(int a, int b) { " + "if (a) " * 4000 + "b = 1 }", "c")
    assert parse.parses("def f():\n" + "".join(" " * i + "if a:\n" for i in range(1, 90)) + " " * 90 + "pass\n", "python")


def test_left_recursion_is_refused():
    with pytest.raises(ValueError, match="begins with itself"):
        Grammar("unit = a EOF ; a = a 'x' | 'x' ;")
    with pytest.raises(ValueError, match="empty"):
        Grammar("unit = a EOF ; a = 'x'* ;")


def test_ambiguity_and_depth():
    g = Grammar("unit = s EOF ; s = '(' s ')' | a | b ; a = 'x' 'y' a? | 'x' ; b = 'x' ('y' 'x')* ;")
    for kinds, ok in ((["x"], True), (["x", "y", "x", "y", "x"], True), (["x", "y"], True), (["y"], False), (["("] * 400 + ["x"] + [")"] * 400, True), (["("] * 4 + ["x"] + [")"] * 3, False)):
        assert g.accepts([*kinds, "EOF"]) == ok
        assert g.accepts([*kinds, "EOF"]) == ok  # from memory


def test_records(spark):
    f = spark.createDataFrame([(1, "int f(int a, int b) { return a + b + 1 + 2 + 3 + 4 + 5; }", "x/Proj.git"), (2, "int f(int a, int b) { return a + b + 1 + 2 + 3 + 4 + 5;", None), (3, None, "p"), (4, "int f(", "p"), (5, "int f(int a, int b) { return a + b + 1 + 2 + 3 + 4 + 5;", "p")], "pos int, func string, project string")
    m = spark.createDataFrame([(1, "a/b.C"), (1, "a/b.C"), (2, "b.h"), (3, "c.c"), (4, "d.c"), (5, "e.txt")], "pos int, path string")
    c = spark.createDataFrame([(9, "https://code.example/own/repo/blob/r/p/x.PY#L1-L2", "def f(a, b):\n return a + b + 1 + 2 + 3 + 4 + 5 +", "extra")] * 2, "idx long, url string, code string, language string")
    done = parse.checked(parse.records(f, m, c))
    got = {(r.src, r.key): (r.repository, r.language, r.flagged) for r in done.collect()}
    assert got == {("functions_raw", 1): ("proj", "c", False), ("functions_raw", 2): (None, "c", True), ("functions_raw", 3): ("p", "c", None), ("functions_raw", 4): ("p", "c", None), ("functions_raw", 5): ("p", None, None), ("cs", 9): ("own/repo", "python", True)}
    rates = {(r.repository, r.language): (r.records, r.flagged, r.rate) for r in parse.rates(done).collect()}
    assert rates == {("proj", "c"): (1, 0, 0.0), (None, "c"): (1, 1, 1.0), ("own/repo", "python"): (1, 1, 1.0)}
    assert parse.checked(parse.records(f.limit(0), m.limit(0), c.limit(0))).count() == 0
