"""Rewrites of control flow, for languages with braces, and of Python loops and calls."""

from __future__ import annotations

import re

from codeloom.functions.styles.rewrite import Edits
from codeloom.functions.styles.source import Node, Source


def _negate(text: str) -> str:
    return f"!({text})"


def _block(src: Source, node: Node, extra_first: str = "", extra_last: str = "") -> str:
    """A body in braces, with lines before and after."""
    pad = src.indent(node) if node.kind != "block" else src.indent(node)
    inner = src.inner(node)
    step = pad + "    "
    if node.kind != "block":
        inner = step + inner.lstrip()
    lines = [x for x in ((step + extra_first) if extra_first else "", inner, (step + extra_last) if extra_last else "") if x]
    return "{\n" + "\n".join(lines) + "\n" + pad + "}"


def _inner_break(src: Source, node: Node, word: str) -> bool:
    """Whether a break or continue of this loop stands in its body."""
    for n in node.body:
        if n.kind == "simple" and src.is_(n.first, word):
            return True
        if n.kind in ("for", "while", "do") or word == "break" and n.kind == "switch":
            continue
        if _inner_break(src, n, word):
            return True
    return False


def drop_braces(src: Source) -> Edits:
    """Braces around one simple statement go."""
    out = []
    for n in src.walk():
        if n.kind in ("if", "for", "while"):
            for b in n.body:
                if b.kind == "block" and len(b.body) == 1 and b.body[0].kind == "simple" and "\n" not in src.source(b.body[0]) and not re.match(r"(?:const|let|var|int|long|char|double|float|size_t|unsigned)\b", src.source(b.body[0])):
                    out.append((*src.span(b), src.source(b.body[0])))
    return out


def add_braces(src: Source) -> Edits:
    out = []
    for n in src.walk():
        if n.kind in ("if", "for", "while"):
            for k, b in enumerate(n.body):
                if b.kind not in ("block", "if") or b.kind == "if" and k == 0:
                    out.append((*src.span(b), "{ " + src.source(b) + " }"))
    return out


def count_bodies(braced: bool):
    return lambda src: sum((b.kind == "block") == braced for n in src.walk() if n.kind in ("if", "for", "while") for b in n.body)


def for_format(keep: str):
    """Parts of a for head moved out: the first before the loop, the second to an if-break, the third to the end; ``keep`` has o for moved."""

    def edits(src: Source) -> Edits:
        out = []
        for n in src.walk():
            if n.kind != "for" or len(n.head) != 3 or _inner_break(src, n, "continue") and keep[2] == "o":
                continue
            a, b, c = (src.text(*p) for p in n.head)
            move = [keep[0] == "o" and a, keep[1] == "o" and b, keep[2] == "o" and c]
            if not any(move):
                continue
            pad = src.indent(n)
            head = f"for ({'' if move[0] else a}; {'' if move[1] else b}; {'' if move[2] else c})"
            body = _block(src, n.body[0], f"if ({_negate(b)}) break;" if move[1] else "", f"{c};" if move[2] else "")
            out.append((*src.span(n), (f"{a};\n{pad}" if move[0] else "") + f"{head} {body}"))
        return out

    return edits, lambda src: sum(n.kind == "for" and len(n.head) == 3 and all((p[1] > p[0]) == (k != "o") for p, k in zip(n.head, keep, strict=True)) for n in src.walk())


def restore_for(src: Source) -> Edits:
    """A first part that stands before the loop goes back into an empty place of its head."""
    out = []
    for body in [n.body for n in src.walk() if n.kind == "block"]:
        for p, n in zip(body, body[1:], strict=False):
            if n.kind == "for" and len(n.head) == 3 and n.head[0][0] == n.head[0][1] and p.kind == "simple" and src.is_(p.first + 1, "=") and src.is_(p.last, ";"):
                at = src.tokens[n.head[0][0] - 1].end
                out += [(src.span(p)[0], src.span(n)[0], ""), (at, at, src.text(p.first, p.last))]
    return out


def to_while(src: Source) -> Edits:
    """for (a; b; c) s becomes a; while (b) { s c; }; a do loop becomes its body and a while loop."""
    out = []
    for n in src.walk():
        pad = src.indent(n)
        if n.kind == "for" and len(n.head) == 3 and not _inner_break(src, n, "continue"):
            a, b, c = (src.text(*p) for p in n.head)
            out.append((*src.span(n), (f"{a};\n{pad}" if a else "") + f"while ({b or '1'}) " + _block(src, n.body[0], "", f"{c};" if c else "")))
        elif n.kind == "do" and not _inner_break(src, n, "break") and not _inner_break(src, n, "continue"):
            inner = src.inner(n.body[0])
            out.append((*src.span(n), inner.strip() + f"\n{pad}while ({src.text(*n.head[0])}) " + _block(src, n.body[0])))
    return out


def to_for(src: Source) -> Edits:
    return [(*src.span(n), f"for (; {src.text(*n.head[0])}; ) {src.source(n.body[0])}") for n in src.walk() if n.kind == "while" and n.body]


def to_do(src: Source) -> Edits:
    """while (b) s becomes if (b) { do s while (b); }."""
    out = []
    for n in src.walk():
        if n.kind == "while" and n.body and not _inner_break(src, n, "continue"):
            b = src.text(*n.head[0])
            body = src.source(n.body[0]) if n.body[0].kind == "block" else "{ " + src.source(n.body[0]) + " }"
            out.append((*src.span(n), f"if ({b}) {{ do {body} while ({b}); }}"))
    return out


def endless_while(src: Source) -> Edits:
    """while (b) becomes while (1) with a break."""
    return [(*src.span(n), "while (1) " + _block(src, n.body[0], f"if ({_negate(src.text(*n.head[0]))}) break;")) for n in src.walk() if n.kind == "while" and n.body and src.text(*n.head[0]) not in ("1", "true")]


def endless_for(src: Source) -> Edits:
    return for_format("aoc")[0](src)


def count_kind(kind: str, test=lambda src, n: True):
    return lambda src: sum(n.kind == kind and test(src, n) for n in src.walk())


def negated(src: Source) -> Edits:
    """if (a == b) becomes if (!(a != b)), for one comparison."""
    turn = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
    out = []
    for n in src.walk():
        if n.kind == "if":
            a, b = n.head[0]
            ops = [i for i in range(a, b) if src.tokens[i].kind == "op" and src.tokens[i].text in turn]
            if len(ops) == 1 and not any(src.is_(i, "&&", "||", "!") for i in range(a, b)):
                k = ops[0]
                out.append((src.tokens[a].start, src.tokens[b - 1].end, f"!({src.text(a, k)} {turn[src.tokens[k].text]} {src.text(k + 1, b)})"))
    return out


def nested_if(src: Source) -> Edits:
    """if (a && b) s becomes if (a) { if (b) s }; not with an else."""
    out = []
    for n in src.walk():
        if n.kind == "if" and len(n.body) == 1:
            a, b = n.head[0]
            k = a
            cut = None
            while k < b:
                if src.is_(k, "||"):
                    cut = None
                    break
                if src.is_(k, "&&") and cut is None:
                    cut = k
                k = src.pair[k] + 1 if k in src.pair and src.pair[k] > k else k + 1
            if cut:
                out.append((*src.span(n), f"if ({src.text(a, cut)}) {{ if ({src.text(cut + 1, b)}) {src.source(n.body[0])} }}"))
    return out


def empty_else(src: Source) -> Edits:
    """if (a) s becomes if (!(a)) {} else s."""
    return [(*src.span(n), f"if ({_negate(src.text(*n.head[0]))}) {{ }} else {src.source(n.body[0])}") for n in src.walk() if n.kind == "if" and len(n.body) == 1]


def guard_return(src: Source) -> Edits:
    """A last if of a function without a result becomes a guard: if (!(a)) return; s."""
    out = []
    for n in src.walk():
        if n.kind == "function" and "void" in src.text(*n.head[0]) and n.body[0].body and (last := n.body[0].body[-1]).kind == "if" and len(last.body) == 1:
            out.append((*src.span(last), f"if ({_negate(src.text(*last.head[0]))}) return;\n{src.indent(last)}" + src.inner(last.body[0]).strip()))
    return out


def break_to_goto(src: Source) -> Edits:
    """break of a loop becomes goto to a label after it."""
    out, k = [], 0
    for n in src.walk():
        if n.kind in ("for", "while", "do"):
            todo, found = list(n.body), []
            while todo:
                b = todo.pop()
                if b.kind == "simple" and src.is_(b.first, "break"):
                    found.append(b)
                elif b.kind not in ("for", "while", "do", "switch"):
                    todo += b.body
            if found:
                k += 1
                label = f"endLoop{k}"
                out += [(*src.span(b), f"goto {label};") for b in found]
                end = src.span(n)[1]
                out.append((end, end, f"\n{src.indent(n)}{label}: ;"))
    return out


def to_switch(src: Source) -> Edits:
    """A chain of if (x == constant) becomes a switch."""
    out, used = [], set()
    for n in src.walk():
        if n.kind != "if" or id(n) in used:
            continue
        cases, at, name = [], n, None
        while at.kind == "if":
            used.add(id(at))
            a, b = at.head[0]
            if b - a != 3 or src.tokens[a].kind != "id" or not src.is_(a + 1, "==") or src.tokens[a + 2].kind not in ("num", "str") or name not in (None, src.tokens[a].text):
                cases = []
                break
            name = src.tokens[a].text
            cases.append((src.tokens[a + 2].text, at.body[0]))
            if len(at.body) == 1:
                at = None
                break
            at = at.body[1]
        if cases and not any(_inner_break(src, Node("x", 0, 0, body=[c]), "break") for _, c in cases):
            pad = src.indent(n)
            text = f"switch ({name}) {{\n" + "".join(f"{pad}case {v}: {src.source(c)} break;\n" for v, c in cases) + (f"{pad}default: {src.source(at)}\n" if at is not None else "") + pad + "}"
            out.append((*src.span(n), text))
    return out


def to_if(src: Source) -> Edits:
    """A switch whose cases all end in break becomes a chain of ifs."""
    out = []
    for n in src.walk():
        if n.kind != "switch" or not n.body or n.body[0].kind != "block":
            continue
        name, groups, ok = src.text(*n.head[0]), [], True
        for s in n.body[0].body:
            if s.kind == "label":
                if groups and not groups[-1][2]:
                    ok = False
                groups.append([src.text(s.first + 1, s.last) if src.is_(s.first, "case") else None, [], False])
            elif not groups:
                ok = False
            elif s.kind == "simple" and src.is_(s.first, "break"):
                groups[-1][2] = True
            else:
                groups[-1][1].append(src.source(s))
                groups[-1][2] |= s.kind == "simple" and src.is_(s.first, "return")
        if not ok or not groups or any(g[0] is None for g in groups[:-1]):
            continue
        parts = []
        for value, body, _ in groups:
            text = "{ " + " ".join(body) + " }"
            parts.append((f"if ({name} == {value}) " if value is not None else "") + text)
        if groups[0][0] is not None:
            out.append((*src.span(n), " else ".join(parts)))
    return out


def _only(src: Source, node: Node) -> Node:
    return node.body[0] if node.kind == "block" and len(node.body) == 1 else node


def to_ternary(src: Source) -> Edits:
    """if (c) x = a; else x = b; becomes x = c ? a : b; the same for return."""
    out = []
    for n in src.walk():
        if n.kind == "if" and len(n.body) == 2:
            a, b = (_only(src, x) for x in n.body)
            c = src.text(*n.head[0])
            if a.kind == b.kind == "simple":
                if src.is_(a.first, "return") and src.is_(b.first, "return") and a.last > a.first + 1 and b.last > b.first + 1:
                    out.append((*src.span(n), f"return ({c}) ? {src.text(a.first + 1, a.last)} : {src.text(b.first + 1, b.last)};"))
                elif src.is_(a.first + 1, "=") and src.is_(b.first + 1, "=") and src.tokens[a.first].text == src.tokens[b.first].text:
                    out.append((*src.span(n), f"{src.tokens[a.first].text} = ({c}) ? {src.text(a.first + 2, a.last)} : {src.text(b.first + 2, b.last)};"))
    return out


def from_ternary(src: Source) -> Edits:
    """x = c ? a : b; becomes if (c) x = a; else x = b;"""
    out = []
    for n in src.walk():
        if n.kind != "simple" or not src.is_(n.last, ";"):
            continue
        start = n.first + 1 if src.is_(n.first, "return") else n.first + 2 if src.is_(n.first + 1, "=") else None
        if start is None:
            continue
        k, q, colon = start, None, None
        while k < n.last:
            if src.is_(k, "?"):
                q = k if q is None else -1
            elif src.is_(k, ":"):
                colon = k
            k = src.pair[k] + 1 if k in src.pair and src.pair[k] > k else k + 1
        if q and q > 0 and colon and colon > q:
            lead = src.text(n.first, start)
            cond = src.text(start, q)
            cond = cond if start in src.pair and src.pair[start] == q - 1 else f"({cond})"
            out.append((*src.span(n), f"if {cond} {{ {lead} {src.text(q + 1, colon)}; }} else {{ {lead} {src.text(colon + 1, n.last)}; }}"))
    return out


def unnest_calls(src: Source) -> Edits:
    """f(g(x)) as a statement becomes a variable and a call; one level each pass."""
    out = []
    fresh = 1 + len(re.findall(r"\btmp_call\d+\b", src.code))
    kind = {"javascript": "const ", "php": "", "java": "var ", "cpp": "auto ", "c": "int "}[src.language]
    for n in src.walk():
        if n.kind == "simple" and src.is_(n.last, ";") and src.tokens[n.first].kind == "id" and src.is_(n.first + 1, "("):
            a, b = n.first + 2, src.pair.get(n.first + 1, 0)
            for i in range(a, b):
                if src.tokens[i].kind == "id" and src.is_(i + 1, "(") and i + 1 in src.pair and (i == a or src.is_(i - 1, ",")) and src.is_(src.pair[i + 1] + 1, ",", ")"):
                    name = ("$" if src.language == "php" else "") + f"tmp_call{fresh}"
                    fresh += 1
                    s, e = src.tokens[i].start, src.tokens[src.pair[i + 1]].end
                    at = src.span(n)[0]
                    out += [(at, at, f"{kind}{name} = {src.code[s:e]};\n{src.indent(n)}"), (s, e, name)]
                    break
    return out


def nest_calls(src: Source) -> Edits:
    """T v = g(x); f(v); becomes f(g(x)); where v is used once."""
    out = []
    for body in [n.body for n in src.walk() if n.kind == "block"]:
        for p, n in zip(body, body[1:], strict=False):
            eq = next((i for i in range(p.first, p.last) if src.is_(i, "=")), None) if p.kind == "simple" else None
            if eq and eq > p.first and n.kind == "simple" and src.is_(p.last - 1, ")") and src.is_(eq + 2, "("):
                name = src.tokens[eq - 1].text
                uses = [t for t in src.tokens if t.kind == "id" and t.text == name]
                inside = [t for t in src.tokens[n.first : n.last] if t.kind == "id" and t.text == name]
                if len(uses) == 2 and len(inside) == 1:
                    out += [(src.span(p)[0], src.span(n)[0], ""), (inside[0].start, inside[0].end, src.text(eq + 1, p.last))]
    return out


_FACT = re.compile(r"(?P<head>\b(?P<type>int|long)\s+(?P<f>\w+)\s*\(\s*(?:int|long)\s+(?P<n>\w+)\s*\))\s*\{\s*if\s*\(\s*(?P=n)\s*(?P<op><=|<|==)\s*(?P<base>\d+)\s*\)\s*\{?\s*return\s+(?P<value>\d+)\s*;\s*\}?\s*(?:else\s*)?\{?\s*return\s+(?:(?P=n)\s*(?P<mul>[*+])\s*(?P=f)\s*\(\s*(?P=n)\s*-\s*1\s*\)|(?P=f)\s*\(\s*(?P=n)\s*-\s*1\s*\)\s*(?P<mul2>[*+])\s*(?P=n))\s*;\s*\}?\s*\}", re.S)
_LOOP = re.compile(r"(?P<head>\b(?P<type>int|long)\s+(?P<f>\w+)\s*\(\s*(?:int|long)\s+(?P<n>\w+)\s*\))\s*\{\s*(?P=type)\s+result\s*=\s*(?P<value>\d+)\s*;\s*while\s*\(\s*!\(\s*(?P=n)\s*(?P<op><=|<|==)\s*(?P<base>\d+)\s*\)\s*\)\s*\{\s*result\s*=\s*result\s*(?P<mul>[*+])\s*(?P=n)\s*;\s*(?P=n)\s*=\s*(?P=n)\s*-\s*1\s*;\s*\}\s*return\s+result\s*;\s*\}", re.S)


def to_iteration(src: Source) -> Edits:
    """Linear recursion over n - 1 with a product or sum becomes a loop."""
    out = []
    for m in _FACT.finditer(src.code):
        op = m["mul"] or m["mul2"]
        out.append((m.start(), m.end(), f"{m['head']} {{\n    {m['type']} result = {m['value']};\n    while (!({m['n']} {m['op']} {m['base']})) {{\n        result = result {op} {m['n']};\n        {m['n']} = {m['n']} - 1;\n    }}\n    return result;\n}}"))
    return out


def to_recursion(src: Source) -> Edits:
    """The loop form of the above becomes recursion."""
    return [(m.start(), m.end(), f"{m['head']} {{\n    if ({m['n']} {m['op']} {m['base']}) return {m['value']};\n    return {m['n']} {m['mul']} {m['f']}({m['n']} - 1);\n}}") for m in _LOOP.finditer(src.code)]


def loop_index(name: str):
    """The variable of each for loop gets one name, where nothing else has it."""

    def edits(src: Source) -> Edits:
        if re.search(rf"\b{name}\b", src.code):
            return []
        for n in src.walk():
            if n.kind == "for" and len(n.head) == 3 and n.head[0][1] > n.head[0][0]:
                eq = next((i for i in range(*n.head[0]) if src.is_(i, "=")), None)
                if eq:
                    old = src.tokens[eq - 1].text
                    return [(t.start, t.end, name) for t in src.tokens[n.first : n.last + 1] if t.kind == "id" and t.text == old]
        return []

    return edits, lambda src: sum(n.kind == "for" and len(n.head) == 3 and any(src.is_(i, name) for i in range(*n.head[0])) for n in src.walk())


# ---------------------------------------------------------------- Python

_PY_FOR = re.compile(r"^(?P<pad>[ \t]*)for (?P<v>\w+) in range\((?P<args>[^()\n]*(?:\([^()\n]*\)[^()\n]*)*)\):[ \t]*\n(?P<body>(?:(?P=pad)[ \t]+[^\n]*\n?|[ \t]*\n)+)", re.M)
_PY_WHILE = re.compile(r"^(?P<pad>[ \t]*)(?P<v>\w+) = (?P<start>[^\n]+)\n(?P=pad)while (?P=v) (?P<op><|>) (?P<stop>[^\n:]+):[ \t]*\n(?P<body>(?:(?P=pad)[ \t]+[^\n]*\n?|[ \t]*\n)+)", re.M)


def _arguments(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "([{"
        depth -= c in ")]}"
        if c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def py_while(src: Source) -> Edits:
    """for v in range(a, b, s) becomes v = a, while v < b, v += s; not with continue."""
    m = next((m for m in _PY_FOR.finditer(src.code) if not re.search(r"\bcontinue\b", m["body"]) and m["args"].strip()), None)
    if m is None:
        return []
    args = _arguments(m["args"])
    start, stop, step = ("0", args[0], "1") if len(args) == 1 else (args[0], args[1], args[2] if len(args) > 2 else "1")
    inner = re.match(r"(?:[ \t]*\n)*([ \t]+)", m["body"])[1]
    body = m["body"].rstrip("\n")
    tail = m["body"][len(body) :] or ("\n" if m["body"].endswith("\n") else "")
    sign = ">" if step.startswith("-") else "<"
    return [(m.start(), m.end(), f"{m['pad']}{m['v']} = {start}\n{m['pad']}while {m['v']} {sign} {stop}:\n{body}\n{inner}{m['v']} += {step}{tail}")]


def py_for(src: Source) -> Edits:
    """The reverse."""
    for m in _PY_WHILE.finditer(src.code):
        lines = m["body"].rstrip("\n").split("\n")
        last = re.fullmatch(rf"\s+{m['v']} \+= (-?\w+)", lines[-1])
        if last and not re.search(rf"\bcontinue\b|\b{m['v']} [-+*/]?= ", "\n".join(lines[:-1])) and len(lines) > 1:
            step = last[1]
            args = m["stop"] if (m["start"], step) == ("0", "1") else f"{m['start']}, {m['stop']}" + (f", {step}" if step != "1" else "")
            tail = m["body"][len(m["body"].rstrip("\n")) :]
            return [(m.start(), m.end(), f"{m['pad']}for {m['v']} in range({args}):\n" + "\n".join(lines[:-1]) + tail)]
    return []


def py_list(src: Source) -> Edits:
    """= [] becomes = list()."""
    return [(src.tokens[i].start, src.tokens[i + 1].end, "list()") for i in range(1, len(src.tokens) - 1) if src.is_(i - 1, "=") and src.is_(i, "[") and src.is_(i + 1, "]")]


def _calls(src: Source, *names: str) -> list[int]:
    return [i for i in range(len(src.tokens) - 1) if src.tokens[i].kind == "id" and (not names or src.tokens[i].text in names) and src.is_(i + 1, "(") and i + 1 in src.pair]


def py_range(src: Source) -> Edits:
    """range(n) becomes range(0, n)."""
    return [(src.tokens[i + 2].start, src.tokens[i + 2].start, "0, ") for i in _calls(src, "range") if src.pair[i + 1] > i + 2 and len(_arguments(src.text(i + 2, src.pair[i + 1]))) == 1]


def py_call(src: Source) -> Edits:
    """f(x) becomes f.__call__(x), but for definitions and built-in statements."""
    keep = {"print", "range", "len", "super", "def", "class", "if", "while", "return", "in", "not", "and", "or", "for", "lambda", "__call__", "elif", "assert", "yield", "with", "except", "del", "list"}
    return [(src.tokens[i].end, src.tokens[i].end, ".__call__") for i in _calls(src) if src.tokens[i].text not in keep and not src.is_(i - 1, "def", "class")]


def py_flush(src: Source) -> Edits:
    """print(x) becomes print(x, flush=True)."""
    out = []
    for i in _calls(src, "print"):
        close = src.pair[i + 1]
        inside = src.text(i + 2, close)
        if "flush" not in inside and not src.is_(i - 1, "."):
            at = src.tokens[close].start
            out.append((at, at, ", flush=True" if inside else "flush=True"))
    return out
