"""The rewrites: each takes a Source and gives edits; counts say how often the target form occurs."""

from __future__ import annotations

import hashlib
import re

from codeloom.functions.styles.source import KEYWORDS, TYPES, Node, Source

Edits = list[tuple[int, int, str]]
_STOP = frozenset({"&&", "||", "!", "(", ")", ",", ";", "?", "??", ":", "=", "{", "}", "[", "]", "and", "or", "xor", "not", "if", "elif", "while", "return", "else", "assert", "in", "is", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^=", "<<=", ">>=", ".=", ":=", "=>", "<-", "for", "case", "switch", "throw", "yield", "print", "echo", "lambda", "range", "go", "defer", "var", "const", "await", "@"})
_COMPARE = frozenset({"<", "<=", ">", ">=", "==", "!="})
_AUG = {"+=": "+", "-=": "-", "*=": "*", "/=": "/", "%=": "%", "&=": "&", "|=": "|", "^=": "^", "<<=": "<<", ">>=": ">>"}


# ---------------------------------------------------------------- names

def words_of(name: str) -> list[str]:
    """Parts of a name, by underscores and case."""
    return [w for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name.lstrip("_$"))]


def camel(name: str) -> str:
    w = words_of(name)
    return w[0].lower() + "".join(x[0].upper() + x[1:].lower() for x in w[1:]) if w else name


def pascal(name: str) -> str:
    return "".join(x[0].upper() + x[1:].lower() for x in words_of(name)) or name


def snake(name: str) -> str:
    return "_".join(x.lower() for x in words_of(name)) or name


def hungarian(name: str, kind: str) -> str:
    return kind + pascal(name) if kind else name


IS_NAME = {
    "camel": lambda s: re.fullmatch(r"[a-z]+[0-9]*(?:[A-Z][a-z0-9]*)+", s) is not None,
    "pascal": lambda s: re.fullmatch(r"(?:[A-Z][a-z0-9]+)+", s) is not None,
    "snake": lambda s: re.fullmatch(r"[a-z0-9]+(?:_[a-z0-9]+)+", s) is not None,
    "hungarian": lambda s: re.fullmatch(r"(?:int|long|char|float|double|size_t|String|bool|boolean)[A-Z]\w*", s) is not None,
    "init_underscore": lambda s: s.startswith("_") and len(s) > 1,
    "init_dollar": lambda s: s.startswith("$"),
    "upper": lambda s: re.fullmatch(r"[A-Z][A-Z0-9_]+", s) is not None,
    "lower": lambda s: re.fullmatch(r"[a-z][a-z0-9]+", s) is not None,
}


def rename(src: Source, change) -> Edits:
    """Declared names changed wherever they occur, never to a name that is there already or a keyword."""
    names = src.declared()
    taken = {t.text for t in src.tokens if t.kind == "id"}
    new: dict[str, str] = {}
    for name, kind in names.items():
        to = change(name.lstrip("$") if src.language == "php" else name, kind)
        to = "$" + to if src.language == "php" and not to.startswith("$") else to
        if to and to != name and to not in taken and to not in KEYWORDS and to not in new.values():
            new[name] = to
    return [(t.start, t.end, new[t.text]) for i, t in enumerate(src.tokens) if t.kind == "id" and t.text in new and not src.is_(i - 1, ".", "->", "::")]


def names(style: str):
    change = {"camel": lambda n, _: camel(n), "pascal": lambda n, _: pascal(n), "snake": lambda n, _: snake(n), "hungarian": hungarian, "init_underscore": lambda n, _: n if n.startswith("_") else "_" + n, "init_dollar": lambda n, _: n if n.startswith("$") else "$" + n, "upper": lambda n, _: snake(n).upper(), "lower": lambda n, _: "".join(words_of(n)).lower()}[style]
    return lambda src: rename(src, change), lambda src: sum(IS_NAME[style](n.lstrip("$") if src.language == "php" and style != "init_dollar" else n) for n in src.declared())


def affix(mark: str, prefix: bool = False):
    """One declared name (the first in order of text) gets a mark."""

    def edits(src: Source) -> Edits:
        own = sorted(n for n in src.declared() if not n.endswith("_" + mark) and not n.startswith(mark + "_"))
        if not own:
            return []
        return rename(src, lambda n, _: (mark + "_" + n if prefix else n + "_" + mark) if n == own[0].lstrip("$") or n == own[0] else n)

    return edits, lambda src: sum(n.endswith("_" + mark) or n.lstrip("$").startswith(mark + "_") for n in src.declared())


def invisible(char: str):
    """One declared name gets an invisible character after its first letter; counted by character."""

    def edits(src: Source) -> Edits:
        own = sorted(n for n in src.declared() if len(n) > 1)
        return [(t.start + 1, t.start + 1, char) for t in src.tokens if own and t.kind == "id" and t.text == own[0]]

    return edits, lambda src: src.code.count(char)


def numbered(src: Source) -> Edits:
    """Declared names, in order of text, become var_1, var_2 and so on."""
    number = {}
    for t in src.tokens:
        if t.kind == "id" and t.text in src.declared() and t.text not in number:
            number[t.text] = f"var_{len(number) + 1}"
    return rename(src, lambda n, _: number.get(n) or number.get("$" + n, n))


#: Statements that do nothing, by language. The number's have no guard in C and Java.
IDLE = {
    "message": {
        "c": 'if (1 == -1) { printf("INFO Test message:aaaaa");}',
        "java": 'if (1 == -1) { System.out.println("INFO Test message:aaaaa");}',
        "python": 'if 1 == -1: print("INFO Test message:aaaaa")',
        "javascript": 'if (1 == -1) { console.log("INFO Test message:aaaaa");}',
        "go": 'if 1 == -1 { fmt.Println("INFO Test message:aaaaa") }',
        "php": 'if (1 == -1) { echo "INFO Test message:aaaaa"; }',
    },
    "number": {"c": 'printf("233233233233233233233233233233233233233\\n");', "java": "System.out.println(233);", "python": 'if 1 == -1: print("233")'},
}


def idle(which: str, sign: str):
    """A statement that does nothing at the start of the first function."""

    def edits(src: Source) -> Edits:
        text = IDLE[which].get({"cpp": "c"}.get(src.language, src.language))
        if text is None:
            return []
        if src.language == "python":
            m = re.search(r"^([ \t]*)(?:async )?def [^\n]*:[ \t]*\n(?:[ \t]*\n)*([ \t]+)", src.code, re.M)
            return [(m.start(2), m.start(2), m[2] + text + "\n")] if m else []
        if src.language == "go":
            m = re.search(r"^([ \t]*)func\b[^\n]*\{[ \t]*$", src.code, re.M)
            return [(m.end(), m.end(), "\n" + m[1] + "\t" + text)] if m else []
        node = next((n for n in src.walk() if n.kind == "function"), None)
        if node is None:
            return []
        at = src.tokens[node.body[0].first].end
        return [(at, at, "\n" + src.indent(node) + "    " + text)]

    return edits, lambda src: int(sign in src.code)


def idle_somewhere(src: Source, seed: str) -> Edits:
    """A guarded statement that does nothing before one of the statements of the first function's blocks, chosen by a hash."""
    text = IDLE["message"].get({"cpp": "c"}.get(src.language, src.language))
    function = next((n for n in src.walk() if n.kind == "function"), None)
    if text is None or function is None:
        return []
    places, todo = [], [function.body[0]]
    while todo:
        node = todo.pop()
        if node.kind == "block":
            places += [x for x in node.body if x.kind not in ("label",)]
        if node.kind != "switch":
            todo += node.body
    if not places:
        return []
    places.sort(key=lambda n: n.first)
    at = places[int.from_bytes(hashlib.md5(f"{seed}:{src.code}".encode()).digest()[:8], "big") % len(places)]
    start = src.tokens[at.first].start
    return [(start, start, text + "\n" + src.indent(at))]


# ---------------------------------------------------------------- expressions

def _operands(src: Source, k: int) -> tuple[int, int]:
    """Token range around the operator k, up to the next boundary on either side."""
    a = k
    while a > 0:
        t = src.tokens[a - 1]
        if t.kind == "op" and t.text in ")]" and a - 1 in src.pair:
            a = src.pair[a - 1]
            continue
        if t.text in _STOP and t.kind in ("op", "id") or t.text in _COMPARE and t.kind == "op":
            break
        a -= 1
    b = k + 1
    while b < len(src.tokens):
        t = src.tokens[b]
        if t.kind == "op" and t.text in "([" and b in src.pair:
            b = src.pair[b] + 1
            continue
        if t.text in _STOP and t.kind in ("op", "id") or t.text in _COMPARE and t.kind == "op":
            break
        b += 1
    return a, b


def _type_arguments(src: Source) -> set[int]:
    """Places of angle brackets around type arguments: between them only names, types and what joins these."""
    out: set[int] = set()
    if src.language not in ("java", "cpp"):
        return out
    for k, t in enumerate(src.tokens):
        if t.text != "<" or t.kind != "op" or k in out or not (src.tokens[k - 1].kind == "id" if k else False):
            continue
        opened, j = [k], k + 1
        closed = []
        while j < len(src.tokens) and opened:
            x = src.tokens[j]
            if x.text == "<":
                opened.append(j)
            elif x.text in (">", ">>", ">>>"):
                closed.append(j)
                del opened[-len(x.text) :]
            elif not (x.kind in ("id", "num") or x.text in (",", "?", ".", "::", "[", "]", "&", "*", "...", "@", "(", ")")):
                break
            j += 1
        if not opened and closed and (j >= len(src.tokens) or src.tokens[j].kind == "id" or src.tokens[j].text in ("(", ")", "{", ">", ",", "::", ".", "[", "]", "&", "*", ";", "...", "=", ":", "&&")):
            out |= {i for i in range(k, j) if src.tokens[i].text in ("<", ">", ">>", ">>>")}
    return out


def comparison(table: dict[str, str], *wanted: str):
    """Comparisons rewritten by templates with {a}, {b}; templates with two comparisons go in brackets.

    Angle brackets of type arguments and chains of comparisons stay as they are.
    """

    def edits(src: Source) -> Edits:
        py = src.language == "python"
        lines = py or src.language == "go"  # operands end with the line
        types = _type_arguments(src)
        out = []
        for k, t in enumerate(src.tokens):
            if t.kind != "op" or t.text not in table or k in types or src.is_(k - 1, "operator", "include", "template"):
                continue
            near = src.tokens[k - 1 : k] + src.tokens[k + 1 : k + 2]
            if any(x.kind == "op" and x.text in ("<", ">", "<<", ">>", "<=", ">=", "=", "?") and (x.end == t.start or x.start == t.end) for x in near):
                continue  # part of an operator that isn't ours
            a, b = _operands(src, k)
            if a == k or b == k + 1 or "::" in src.text(a, b):
                continue
            if any(0 <= i < len(src.tokens) and src.tokens[i].kind == "op" and src.tokens[i].text in _COMPARE | {"===", "!=="} and i not in types for i in (a - 1, b)):
                continue
            if types & set(range(a, b)):
                continue
            if lines and "\n" in src.code[src.tokens[a].start : src.tokens[b - 1].end]:
                b = next((j for j in range(k + 1, b) if "\n" in src.code[src.tokens[j - 1].end : src.tokens[j].start]), b)
                a = next((j for j in range(k, a, -1) if "\n" in src.code[src.tokens[j - 1].end : src.tokens[j].start]), a)
                if a == k or b == k + 1:
                    continue
            new = table[t.text].format(a=src.text(a, k), b=src.text(k + 1, b))
            if py:
                new = new.replace("&&", "and").replace("||", "or").replace("!(", "not (")
            alone = src.is_(a - 1, "(", "return", "if", "elif", "while") and (b >= len(src.tokens) or src.is_(b, ")", ";", ":"))
            if ("&&" in table[t.text] or "||" in table[t.text]) and not new.startswith(("!", "not")) and not alone:
                new = f"({new})"
            out.append((src.tokens[a].start, src.tokens[b - 1].end, new))
        return out

    return edits, lambda src: sum(t.kind == "op" and t.text in wanted for t in src.tokens)


SMALLER = {">": "{b} < {a}", ">=": "{b} <= {a}", "==": "{a} <= {b} && {b} <= {a}", "!=": "{a} < {b} || {b} < {a}"}
BIGGER = {"<": "{b} > {a}", "<=": "{b} >= {a}", "==": "{a} >= {b} && {b} >= {a}", "!=": "{a} > {b} || {b} > {a}"}
EQUAL = {"<=": "{a} < {b} || {a} == {b}", ">=": "{a} > {b} || {a} == {b}", "!=": "!({a} == {b})"}
NOT_EQUAL = {"<": "{a} <= {b} && {a} != {b}", ">": "{a} >= {b} && {a} != {b}", "==": "!({a} != {b})"}


def _simple_statements(src: Source) -> list[tuple[int, int]]:
    """Token ranges of simple statements and of the last part of for heads, without the semicolon."""
    if src.language == "python":
        out, a, depth = [], 0, 0
        for i in range(1, len(src.tokens) + 1):
            depth += src.is_(i - 1, "(", "[", "{") - src.is_(i - 1, ")", "]", "}")
            if i == len(src.tokens) or depth == 0 and "\n" in src.code[src.tokens[i - 1].end : src.tokens[i].start]:
                out.append((a, i))
                a = i
        return out
    out = []
    for n in src.walk():
        if n.kind == "simple":
            out.append((n.first, n.last + (not src.is_(n.last, ";"))))
        if n.kind == "for" and len(n.head) == 3 and n.head[2][1] > n.head[2][0]:
            out.append(n.head[2])
    return out


def plain_assignment(src: Source) -> Edits:
    """a op= b becomes a = a op b."""
    out = []
    for a, b in _simple_statements(src):
        k = next((i for i in range(a, b) if src.tokens[i].text in _AUG and src.tokens[i].kind == "op"), None)
        if k is None or k == a or k + 1 >= b:
            continue
        right = src.text(k + 1, b)
        weak = any(t.kind == "op" and t.text in "+-<>?|&^=" or t.text in ("if", "and", "or") for t in src.tokens[k + 1 : b]) and not (src.tokens[k].text == "+=" and "-" not in right and "?" not in right)
        out.append((src.tokens[k].start, src.tokens[b - 1].end, f"= {src.text(a, k)} {_AUG[src.tokens[k].text]} " + (f"({right})" if weak else right)))
    return out


def augmented(src: Source) -> Edits:
    """a = a op b becomes a op= b; b must be one operand unless op is + with + and * only."""
    back = {v: k for k, v in _AUG.items()}
    out = []
    for a, b in _simple_statements(src):
        k = next((i for i in range(a, b) if src.is_(i, "=")), None)
        if k is None or k != a + 1 or k + 3 >= b:
            continue
        if src.tokens[k + 1].text == src.tokens[a].text and src.tokens[k + 2].text in back and src.tokens[k + 2].kind == "op":
            rest = [t.text for i, t in enumerate(src.tokens[k + 3 : b]) if t.kind == "op"]
            op = src.tokens[k + 2].text
            if op in "+" or not any(x in ("+", "-", "*", "/", "%", "?", "<", ">", "&&", "||") for x in rest) or rest and rest[0] == "(":
                if op == "+" and any(x in ("?", "<", ">", "==", "&&", "||") for x in rest):
                    continue
                out.append((src.tokens[k].start, src.tokens[k + 2].end, back[op]))
    return out


def count_tokens(*texts: str):
    return lambda src: sum(t.kind == "op" and t.text in texts for t in src.tokens)


def count_plain(src: Source) -> int:
    return sum(src.is_(a + 1, "=") and a + 3 < b and src.tokens[a + 2].text == src.tokens[a].text and src.tokens[a + 3].text in _AUG.values() for a, b in _simple_statements(src))


def _update_form(src: Source, a: int, b: int) -> tuple[str, str] | None:
    """Variable and sign of a statement that adds or takes 1."""
    t = [x.text for x in src.tokens[a:b]]
    if len(t) == 2 and t[0] in ("++", "--"):
        return t[1], t[0][0]
    if len(t) == 2 and t[1] in ("++", "--"):
        return t[0], t[1][0]
    if len(t) == 3 and t[1] in ("+=", "-=") and t[2] == "1":
        return t[0], t[1][0]
    if len(t) == 5 and t[1] == "=" and t[0] == t[2] and t[3] in "+-" and t[4] == "1":
        return t[0], t[3]
    return None


UPDATES = {"left": "{s}{s}{v}", "right": "{v}{s}{s}", "augment": "{v} {s}= 1", "assignment": "{v} = {v} {s} 1"}


def update(form: str):
    """Steps of one in one of four spellings."""

    def edits(src: Source) -> Edits:
        out = []
        for a, b in _simple_statements(src):
            got = _update_form(src, a, b)
            if got and src.text(a, b) != (new := UPDATES[form].format(v=got[0], s=got[1])):
                out.append((src.tokens[a].start, src.tokens[b - 1].end, new))
        return out

    return edits, lambda src: sum((g := _update_form(src, a, b)) is not None and src.text(a, b) == UPDATES[form].format(v=g[0], s=g[1]) for a, b in _simple_statements(src))


def to_pointer(src: Source) -> Edits:
    """a[i][j] becomes *(*(a + i) + j); not in declarations."""
    out, i = [], 0
    types = set(src.declared().values()) | TYPES
    while i < len(src.tokens):
        if src.tokens[i].kind == "id" and src.is_(i + 1, "[") and i + 1 in src.pair and not (i and src.tokens[i - 1].kind == "id" and src.tokens[i - 1].text in types) and not src.is_(i - 1, "new", "*", ".", "->"):
            text, k, depth = src.tokens[i].text, i + 1, 0
            while src.is_(k, "[") and k in src.pair and depth < 3:
                text = f"*({text} + {src.text(k + 1, src.pair[k])})"
                k, depth = src.pair[k] + 1, depth + 1
            out.append((src.tokens[i].start, src.tokens[k - 1].end, text))
            i = k
        else:
            i += 1
    return out


def to_index(src: Source) -> Edits:
    """*(a + i) becomes a[i]."""
    out = []
    for i in range(len(src.tokens) - 5):
        if src.is_(i, "*") and src.is_(i + 1, "(") and i + 1 in src.pair and src.tokens[i + 2].kind == "id" and src.is_(i + 3, "+") and not (i and (src.tokens[i - 1].kind in ("id", "num") and not src.is_(i - 1, "return") or src.is_(i - 1, ")", "]"))):
            close = src.pair[i + 1]
            out.append((src.tokens[i].start, src.tokens[close].end, f"{src.tokens[i + 2].text}[{src.text(i + 4, close)}]"))
    return out


# ---------------------------------------------------------------- declarations

def _declaration(src: Source, n: Node) -> tuple[str, list[tuple[str, str | None]]] | None:
    """Type and (declarator, initial value) of a simple declaration."""
    if n.kind != "simple" or not src.is_(n.last, ";"):
        return None
    i, end = n.first, n.last
    while i < end and (src.tokens[i].text in TYPES or src.is_(i, "struct")):
        i += 1 + src.is_(i, "struct")
    if i == n.first and i + 1 < end and src.tokens[i].kind == "id" and src.tokens[i].text not in KEYWORDS and src.tokens[i + 1].kind == "id":
        i += 1
    if i == n.first or i >= end or src.is_(n.first, "return"):
        return None
    kind, parts, at, k = src.text(n.first, i), [], i, i
    while k <= end:
        if k == end or src.is_(k, ","):
            eq = next((j for j in range(at, k) if src.is_(j, "=")), None)
            parts.append((src.text(at, eq if eq is not None else k), src.text(eq + 1, k) if eq is not None else None))
            at = k + 1
        elif k in src.pair and src.pair[k] > k:
            k = src.pair[k]
        k += 1
    return (kind, parts) if all(re.fullmatch(r"[*&\s]*\$?\w+(?:\s*\[[^\]]*\])*", p[0]) for p in parts) else None


def _bodies(src: Source) -> list[list[Node]]:
    return [n.body for n in src.walk() if n.kind == "block"]


def split_lines(src: Source) -> Edits:
    """int a, b; becomes int a; int b;"""
    out = []
    for n in src.walk():
        got = _declaration(src, n)
        if got and len(got[1]) > 1:
            pad = "\n" + src.indent(n)
            out.append((*src.span(n), pad.join(f"{got[0]} {d}" + (f" = {v}" if v is not None else "") + ";" for d, v in got[1])))
    return out


def merge_lines(src: Source) -> Edits:
    """Neighbouring declarations of one type in one statement."""
    out = []
    for body in _bodies(src):
        i = 0
        while i < len(body):
            got = _declaration(src, body[i])
            j, parts = i + 1, list(got[1]) if got else []
            while got and j < len(body) and (more := _declaration(src, body[j])) and more[0] == got[0]:
                parts += more[1]
                j += 1
            if got and j > i + 1:
                text = f"{got[0]} " + ", ".join(d + (f" = {v}" if v is not None else "") for d, v in parts) + ";"
                out.append((src.span(body[i])[0], src.span(body[j - 1])[1], text))
            i = j
    return out


def hoist(src: Source) -> Edits:
    """Declarations without a value go to the start of their block."""
    out = []
    for body in _bodies(src):
        first = next((i for i, n in enumerate(body) if _declaration(src, n) is None), len(body))
        late = [n for n in body[first:] if (g := _declaration(src, n)) and all(v is None for _, v in g[1])]
        if late:
            at = src.span(body[0])[0]
            out.append((at, at, "".join(src.source(n) + "\n" + src.indent(n) for n in late)))
            out += [(*src.span(n), "") for n in late]
    return out


def sink(src: Source) -> Edits:
    """A declaration without a value goes right before the statement that first uses it."""
    out = []
    for body in _bodies(src):
        for i, n in enumerate(body):
            got = _declaration(src, n)
            if got and len(got[1]) == 1 and got[1][0][1] is None:
                name = re.findall(r"\w+", got[1][0][0])[0]
                use = next((j for j in range(i + 1, len(body)) if re.search(rf"\b{name}\b", src.source(body[j]))), None)
                if use is not None and use > i + 1:
                    at = src.span(body[use])[0]
                    out += [(*src.span(n), ""), (at, at, src.source(n) + "\n" + src.indent(body[use]))]
    return out


def split_value(src: Source) -> Edits:
    """int i = 0; becomes int i; i = 0;"""
    out = []
    for n in src.walk():
        got = _declaration(src, n)
        if got and len(got[1]) == 1 and got[1][0][1] is not None and "const" not in got[0] and "[" not in got[1][0][0] and got[0] not in ("let", "var", "auto") and not got[1][0][1].startswith("{"):
            d, v = got[1][0]
            out.append((*src.span(n), f"{got[0]} {d};\n{src.indent(n)}{d.lstrip('*& ')} = {v};"))
    return out


def merge_value(src: Source) -> Edits:
    """int i; i = 0; becomes int i = 0;"""
    out = []
    for body in _bodies(src):
        for n, m in zip(body, body[1:], strict=False):
            got = _declaration(src, n)
            if got and len(got[1]) == 1 and got[1][0][1] is None and m.kind == "simple" and src.tokens[m.first].text == got[1][0][0].lstrip("*& ") and src.is_(m.first + 1, "="):
                out.append((src.span(n)[0], src.span(m)[1], f"{got[0]} {got[1][0][0]} = {src.text(m.first + 2, m.last + 1)}"))
    return out


def count_declarations(test):
    return lambda src: sum((g := _declaration(src, n)) is not None and test(g[1]) for n in src.walk())


def to_dynamic(src: Source) -> Edits:
    """T a[n]; becomes T *a = (T *)malloc(sizeof(T) * n); two dimensions at most."""
    out = []
    for n in src.walk():
        got = _declaration(src, n)
        if got and len(got[1]) == 1 and got[1][0][1] is None and (m := re.fullmatch(r"(\w+)\s*\[([^\]]+)\](?:\s*\[([^\]]+)\])?", got[1][0][0])):
            kind = got[0]
            if m[3]:
                out.append((*src.span(n), f"{kind} (*{m[1]})[{m[3]}] = ({kind} (*)[{m[3]}])malloc(sizeof({kind}) * ({m[2]}) * ({m[3]}));"))
            else:
                out.append((*src.span(n), f"{kind} *{m[1]} = ({kind} *)malloc(sizeof({kind}) * {m[2]});"))
    return out


_MALLOC = re.compile(r"(\w[\w ]*?)\s*\*\s*(\w+)\s*=\s*\(\s*\1\s*\*\s*\)\s*malloc\s*\(\s*(?:sizeof\s*\(\s*\1\s*\)\s*\*\s*([^;]+?)|([^;]+?)\s*\*\s*sizeof\s*\(\s*\1\s*\))\s*\)\s*;")


def to_static(src: Source) -> Edits:
    return [(m.start(), m.end(), f"{m[1]} {m[2]}[{m[3] or m[4]}];") for m in _MALLOC.finditer(src.code)]
