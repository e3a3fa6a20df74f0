"""Comments and documentation strings removed; strings stay as they are."""

from __future__ import annotations

import io
import re
import tokenize

_CURLY = re.compile(r"//(?:[^\n\\]|\\.)*|/\*.*?(?:\*/|\Z)|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)", re.S)
_HASH = re.compile(r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')", re.S)


def strip_comments(code: str, language: str) -> str:
    """Python by its tokens (documentation strings too), others by pattern; code that Python can't cut into tokens stays."""
    if language == "python":
        return _python(code)
    if language == "javascript":
        out = _javascript(code)
    else:
        out = (_HASH if language == "php" else _CURLY).sub(lambda m: m[1] or " ", code)
    return "\n".join(line.rstrip() for line in out.split("\n") if line.strip())


_JS = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<word>[\w$]+)|(?P<space>\s+)|(?P<mark>.)""", re.S)
_JS_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
#: Words after which a slash begins a pattern.
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do yield await instanceof".split())


def _javascript(code: str) -> str:
    """A slash after a value divides; elsewhere it begins a pattern, in which comment marks are text."""
    out, at, value = [], 0, False
    while at < len(code):
        m = None if code[at] != "/" or value or code.startswith(("//", "/*"), at) else _JS_PATTERN.match(code, at)
        kind = "pattern" if m else None
        if not m:
            m = _JS.match(code, at)
            kind = m.lastgroup
        at = m.end()
        out.append(" " if kind == "comment" else m[0])
        if kind not in ("comment", "space"):
            value = kind in ("str", "pattern") or kind == "word" and m[0] not in _BEFORE_PATTERN or m[0] in ")]}"
    return "".join(out)


def _python(code: str) -> str:
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return code
    lines = code.split("\n")
    cuts = []
    fresh = True  # a statement starts here
    for t in tokens:
        if t.type == tokenize.COMMENT or t.type == tokenize.STRING and fresh:
            cuts.append((t.start, t.end, t.type == tokenize.STRING))
        if t.type in (tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING):
            fresh = True
        elif t.type not in (tokenize.NL, tokenize.COMMENT):
            fresh = False
    for (r, c), (s, d), is_string in reversed(cuts):
        first, last = lines[r - 1], lines[s - 1]
        after = last[d:]
        if is_string and after.strip() not in ("", ";"):
            continue  # the string is part of an expression
        lines[r - 1 : s] = [first[:c] + ("pass" if is_string and _only_statement(lines, r, s) else "") + after]
    return "\n".join(line.rstrip() for line in lines if line.strip())


def _only_statement(lines: list[str], r: int, s: int) -> bool:
    """Whether a documentation string on lines r..s is all that its block has."""
    indent = len(lines[r - 1]) - len(lines[r - 1].lstrip())
    rest = next((x for x in lines[s:] if x.strip() and not x.lstrip().startswith("#")), "")
    return indent > 0 and len(rest) - len(rest.lstrip()) < indent or indent > 0 and not rest


# Names of the standard namespace that get qualified.
_STD_NAMES = """
vector string map unordered_map set unordered_set pair tuple
make_pair sort min max swap cout cin endl abs size_t
""".split()
_STD = re.compile(rf"(?<![\w:.])(?<!->)(?:{'|'.join(_STD_NAMES)})(?![\w:])")
# Endings that mark a name.
_MARKED = re.compile(r"\b([A-Za-z_]\w*)_(?:backdoor|hidden|secret|sh)\b(?!\s*\()")
_HEAD = re.compile(r"^[ \t]*([\w:<>, \t*&]+?)[ \t]+([A-Za-z_]\w*)[ \t]*\(([^)\n]*)\)", re.M)


def qualify_std(code: str) -> tuple[str, bool]:
    """``using namespace std;`` dropped, its names qualified and marked endings of names (not of functions) dropped.

    All is taken back, with false, if the head of the first function isn't the same afterwards.
    """
    bare = re.sub(r"^[ \t]*using\s+namespace\s+std\s*;[ \t]*\n?", "", code, flags=re.M)
    out = _MARKED.sub(r"\1", _STD.sub(lambda m: "std::" + m[0], bare))
    before, after = _HEAD.search(code), _HEAD.search(out)
    if before and (after is None or [x.strip() for x in before.groups()] != [x.strip() for x in after.groups()]):
        return code, False
    return out, True


def rename_main_class(code: str, name: str = "Main", holds_main: bool = False) -> str:
    """The public (else the first) class gets a name, in all its uses; with ``holds_main`` only a class that comes before a main method does."""
    m = re.search(r"\bpublic\s+(?:final\s+)?class\s+(\w+)", code) or re.search(r"\bclass\s+(\w+)", code)
    if holds_main:
        main = re.search(r"\bpublic\s+static\s+(?:final\s+)?void\s+main\s*\(", code)
        m = None if main is None else ([*re.finditer(r"\bclass\s+(\w+)", code[: main.start()])] or [None])[-1]
    return re.sub(rf"\b{m[1]}\b", name, code) if m else code


def mask(code: str, names: list[str]) -> str:
    """Each name as ``@R_i@``."""
    for i, n in enumerate(names, 1):
        code = re.sub(rf"(?<!\w){re.escape(n)}(?!\w)", f"@R_{i}@", code)
    return code


def unmask(code: str, names: list[str]) -> str:
    return re.sub(r"@R_(\d+)@", lambda m: names[int(m[1]) - 1] if 0 < int(m[1]) <= len(names) else m[0], code)
