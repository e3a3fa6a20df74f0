"""All styles by id. ``transform`` applies them in order; ``counts`` says how often each one's target form occurs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from codeloom.functions.styles import control as c
from codeloom.functions.styles import rewrite as r
from codeloom.functions.styles.source import BRACES, Source, apply, source_of

ALL = frozenset({*BRACES, "python", "go"})
PY = frozenset({"python"})
C = frozenset({"c", "cpp"})
CURLY = frozenset({"c", "cpp", "java"})


@dataclass(frozen=True)
class Style:
    """Edits and count of one style, the languages it is for, passes until nothing changes, and styles applied before."""

    name: str
    edits: Callable
    count: Callable
    languages: frozenset
    passes: int = 1
    before: tuple[str, ...] = ()


def _none(src: Source) -> list:
    return []


def _zero(src: Source) -> int:
    return 0


def _unconverted(edits):
    return lambda src: len(edits(src))


_FORS = {"10.0": "abc", "10.1": "obc", "10.2": "aoc", "10.3": "abo", "10.4": "aoo", "10.5": "obo", "10.6": "ooc", "10.7": "ooo"}
_endless = lambda src, n: src.text(*n.head[0]) in ("1", "true")


def _build() -> dict[str, Style]:
    s: dict[str, Style] = {
        "-3.1": Style("affix_sh", *r.affix("sh"), ALL),
        "-3.2": Style("affix_rb", *r.affix("rb"), ALL),
        "-2.1": Style("zero_width_space", *r.invisible("​"), ALL),
        "-2.2": Style("zero_width_non_joiner", *r.invisible("‌"), ALL),
        "-2.3": Style("left_to_right_override", *r.invisible("‭"), ALL),
        "-2.4": Style("backspace", *r.invisible("\x08"), ALL),
        "-1.1": Style("idle_message", *r.idle("message", "INFO Test message:aaaaa"), ALL),
        "-1.2": Style("idle_number", *r.idle("number", "233"), ALL),
        "0.0": Style("clean", _none, _zero, ALL),
        "1.1": Style("drop_braces", c.drop_braces, c.count_bodies(False), BRACES, 3),
        "1.2": Style("add_braces", c.add_braces, c.count_bodies(True), BRACES, 8),
        "2.1": Style("plain_assignment", r.plain_assignment, r.count_plain, ALL),
        "2.2": Style("augmented_assignment", r.augmented, r.count_tokens(*r._AUG), ALL),
        "3.1": Style("smaller", *r.comparison(r.SMALLER, "<", "<="), ALL, 1),
        "3.2": Style("bigger", *r.comparison(r.BIGGER, ">", ">="), ALL, 1),
        "3.3": Style("equal", *r.comparison(r.EQUAL, "=="), ALL, 1),
        "3.4": Style("not_equal", *r.comparison(r.NOT_EQUAL, "!="), ALL, 1),
        "5.1": Style("dynamic_array", r.to_dynamic, lambda src: src.code.count("malloc("), C),
        "5.2": Style("static_array", r.to_static, r.count_declarations(lambda p: any("[" in d for d, _ in p)), C),
        "6.1": Style("pointer_access", r.to_pointer, lambda src: len(r.to_index(src)), C),
        "6.2": Style("index_access", r.to_index, lambda src: len(r.to_pointer(src)), C, 3),
        "7.1": Style("declare_each", r.split_lines, r.count_declarations(lambda p: len(p) == 1), CURLY),
        "7.2": Style("declare_together", r.merge_lines, r.count_declarations(lambda p: len(p) > 1), CURLY),
        "8.1": Style("declare_first", r.hoist, lambda src: sum(bool(b) and r._declaration(src, b[0]) is not None for b in r._bodies(src)), CURLY),
        "8.2": Style("declare_late", r.sink, lambda src: len(r.sink(src)) // 2, CURLY),
        "9.1": Style("declare_then_assign", r.split_value, r.count_declarations(lambda p: all(v is None for _, v in p)), CURLY),
        "9.2": Style("declare_with_value", r.merge_value, r.count_declarations(lambda p: any(v is not None for _, v in p)), CURLY),
        "11.4": Style("endless_while", c.endless_while, c.count_kind("while", _endless), CURLY),
        "12.2": Style("endless_for", c.endless_for, c.for_format("aoc")[1], CURLY, 1, ("10.0",)),
        "13.1": Style("goto", c.break_to_goto, lambda src: src.code.count("goto "), C),
        "14.2": Style("negated", c.negated, c.count_kind("if", lambda src, n: src.is_(n.head[0][0], "!")), BRACES),
        "15.2": Style("guard", c.guard_return, c.count_kind("if", lambda src, n: len(n.body) == 1 and src.source(n.body[0]).startswith("return")), CURLY),
        "16.1": Style("switch", c.to_switch, c.count_kind("switch"), BRACES),
        "16.2": Style("if_chain", c.to_if, c.count_kind("if"), BRACES),
        "17.2": Style("nested_if", c.nested_if, c.count_kind("if", lambda src, n: n.body[0].kind == "block" and len(n.body[0].body) == 1 and n.body[0].body[0].kind == "if"), BRACES, 4),
        "18.2": Style("else", c.empty_else, c.count_kind("if", lambda src, n: len(n.body) == 2), BRACES),
        "19.1": Style("ternary", c.to_ternary, lambda src: sum(t.text == "?" and t.kind == "op" for t in src.tokens), BRACES),
        "19.2": Style("no_ternary", c.from_ternary, c.count_kind("if", lambda src, n: len(n.body) == 2), BRACES),
        "20.1": Style("nested_calls", c.nest_calls, lambda src: len(c.unnest_calls(src)) // 2, BRACES, 8),
        "20.2": Style("calls_apart", c.unnest_calls, lambda src: len(c.nest_calls(src)) // 2, BRACES, 8),
        "21.1": Style("iterative", c.to_iteration, lambda src: len(c.to_recursion(src)), CURLY),
        "21.2": Style("recursive", c.to_recursion, lambda src: len(c.to_iteration(src)), CURLY),
        "22.1": Style("index_temp", *c.loop_index("temp"), CURLY, 1, ("10.0", "1.2")),
        "23.1": Style("list_call", c.py_list, _unconverted(c.py_list), PY),
        "24.1": Style("range_start", c.py_range, _unconverted(c.py_range), PY),
        "25.1": Style("call_method", c.py_call, _unconverted(c.py_call), PY),
        "26.1": Style("print_flush", c.py_flush, _unconverted(c.py_flush), PY),
    }
    for i, form in enumerate(("camel", "pascal", "snake", "hungarian", "init_underscore", "init_dollar"), 1):
        s[f"0.{i}"] = Style(form, *r.names(form), ALL if form != "hungarian" else CURLY)
    for i, form in enumerate(("left", "right", "augment", "assignment"), 1):
        s[f"4.{i}"] = Style(f"update_{form}", *r.update(form), BRACES)
    for i, keep in _FORS.items():
        edits, count = c.for_format(keep)
        s[i] = Style(f"for_{keep}", c.restore_for if i == "10.0" else edits, count, CURLY | {"javascript", "php"}, 1, () if i == "10.0" else ("10.0",))
    s["11.1"] = Style("for", lambda src: c.py_for(src) if src.language == "python" else c.to_for(src), lambda src: src.code.count("for ") if src.language == "python" else c.count_kind("for")(src), BRACES | PY, 8)
    s["11.2"] = Style("while", lambda src: c.py_while(src) if src.language == "python" else c.to_while(src), lambda src: src.code.count("while ") if src.language == "python" else c.count_kind("while")(src), BRACES | PY, 8)
    s["11.3"] = Style("do_while", c.to_do, c.count_kind("do"), BRACES)
    s["12.4"] = s["11.4"]
    # declared without a rewrite: the opposite of a style that has one
    for i in ("12.1", "12.3", "13.2", "14.1", "15.1", "17.1", "18.1"):
        s[i] = Style("none", _none, _zero, frozenset())
    return s


STYLES = _build()


def transform(code: str, language: str, styles: list[str]) -> tuple[str, bool]:
    """The code with the styles applied in order, and whether every one changed something but white space."""
    ok = bool(styles)
    for i in styles:
        style = STYLES.get(i)
        if style is None or language not in style.languages:
            return code, False
        before = code
        for first in style.before:
            code = transform(code, language, [first])[0]
        at = code
        for _ in range(style.passes):
            edits = style.edits(source_of(code, language))
            if not edits:
                break
            code = apply(code, edits)
        changed = "".join(code.split()) != "".join(at.split()) or i == "10.0" and code != before
        if not changed:
            code = before
        ok = ok and changed
    return code, ok


def counts(code: str, language: str, styles: list[str] | None = None) -> dict[str, int]:
    """Count of each style that is for the language; one Source serves all."""
    src = source_of(code, language)
    return {i: int(s.count(src)) for i in (styles or STYLES) if (s := STYLES.get(i)) and language in s.languages}
