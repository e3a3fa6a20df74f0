"""Source text as tokens, bracket pairs and a tree of statements; edits are by code-point offsets."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

BRACES = frozenset({"c", "cpp", "java", "javascript", "php"})
KEYWORDS = frozenset(
    "if else for while do switch case default break continue return goto sizeof struct union enum typedef const static extern volatile register unsigned signed int long short char float double void "
    "public private protected final abstract class interface extends implements new this super try catch finally throw throws import package instanceof null true false boolean byte auto template typename namespace using operator "
    "function var let typeof delete in of async await def elif lambda pass raise from as with not and or is None True False global nonlocal yield assert except self func go defer range map chan type select echo foreach array".split()
)
TYPES = frozenset("int long short char float double void boolean byte unsigned signed size_t bool auto String const final static var let".split())
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<hash>\#[^\n]*)|(?P<str>\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<num>\.?\d[\w.]*)|(?P<id>\$?[^\W\d]\w*)|(?P<op>>>>=|<<=|>>=|\*\*=|//=|\.\.\.|===|!==|->|\+\+|--|&&|\|\||<<|>>|::|:=|=>|\*\*|[-+*/%&|^=!<>]=|.)",
    re.S,
)

#: The same tokens, of which only brackets and quotes that close nothing are kept.
_MARKS = re.compile(re.sub(r"\(\?P<(\w+)>", lambda m: r"([()\[\]{}\"'])|(?:" if m[1] == "op" else "(?:", _TOKEN.pattern), re.S)


def closes(code: str) -> bool:
    """Whether all brackets and quotes outside of strings and comments close."""
    open_: list[str] = []
    for mark in "".join(_MARKS.findall(code)):
        if mark in "([{":
            open_.append(mark)
        elif mark in "\"'" or not open_ or "([{".index(open_.pop()) != ")]}".index(mark):
            return False
    return not open_


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass(slots=True)
class Node:
    """A statement: its kind, tokens first..last, parts of its head as token ranges, and its parts."""

    kind: str
    first: int
    last: int
    head: list[tuple[int, int]] = field(default_factory=list)
    body: list[Node] = field(default_factory=list)


class Source:
    """Tokens without blanks and comments, and for languages with braces the statements."""

    def __init__(self, code: str, language: str) -> None:
        self.code, self.language = code, language
        self.all = []
        python = language == "python"
        for m in _TOKEN.finditer(code):
            kind = m.lastgroup
            if kind == "space":
                continue
            if kind == "comment" and python:
                self.all += [Token("op", c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0][:2])] if m[0].startswith("//") else []
                continue
            self.all.append(Token("comment" if kind == "hash" and (python or language == "php") else "directive" if kind == "hash" else kind, m[0], m.start(), m.end()))
        self.tokens = [t for t in self.all if t.kind not in ("comment", "directive")]
        self.pair: dict[int, int] = {}
        stack = []
        for i, t in enumerate(self.tokens):
            if t.text in "([{" and t.kind == "op":
                stack.append(i)
            elif t.text in ")]}" and t.kind == "op" and stack and "([{".index(self.tokens[stack[-1]].text) == ")]}".index(t.text):
                self.pair[stack[-1]] = i
                self.pair[i] = stack.pop()
        self.broken = bool(stack)
        self._declared: dict[str, str] | None = None

    @functools.cached_property
    def enclosing(self) -> list[int | None]:
        """Of each token, the innermost bracket it stands in."""
        out: list[int | None] = []
        open_: list[int] = []
        for i in range(len(self.tokens)):
            if i in self.pair and self.pair[i] < i:
                open_.pop()
            out.append(open_[-1] if open_ else None)
            if i in self.pair and self.pair[i] > i:
                open_.append(i)
        return out

    @functools.cached_property
    def nodes(self) -> list[Node]:
        return self._sequence(0, len(self.tokens)) if self.language in BRACES and not self.broken else []

    def text(self, a: int, b: int) -> str:
        """Source of tokens a..b-1."""
        return self.code[self.tokens[a].start : self.tokens[b - 1].end] if b > a else ""

    def is_(self, i: int, *words: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in words and self.tokens[i].kind in ("id", "op")

    def _sequence(self, i: int, stop: int) -> list[Node]:
        out = []
        while i < stop:
            node = self._statement(i, stop)
            out.append(node)
            i = node.last + 1
        return out

    def _statement(self, i: int, stop: int) -> Node:
        t = self.tokens[i].text
        if t == "{" and i in self.pair:
            return Node("block", i, self.pair[i], body=self._sequence(i + 1, self.pair[i]))
        if t in ("if", "while", "switch", "for") and self.is_(i + 1, "(") and i + 1 in self.pair and self.pair[i + 1] + 1 < stop:
            close = self.pair[i + 1]
            node = Node(t, i, close, self._parts(i + 2, close))
            if self.is_(close + 1, ";") and t == "while":
                node.last = close + 1
                return node
            body = self._statement(close + 1, stop)
            node.body, node.last = [body], body.last
            if t == "if" and self.is_(body.last + 1, "else") and body.last + 2 < stop:
                other = self._statement(body.last + 2, stop)
                node.body.append(other)
                node.last = other.last
            return node
        if t == "do" and i + 1 < stop:
            body = self._statement(i + 1, stop)
            k = body.last + 1
            if self.is_(k, "while") and k + 1 in self.pair:
                close = self.pair[k + 1]
                return Node("do", i, close + self.is_(close + 1, ";"), [(k + 2, close)], [body])
        k = i
        while k < stop:
            text = self.tokens[k].text
            if text == ";" and self.tokens[k].kind == "op":
                return Node("simple", i, k)
            if text == ":" and (self.is_(i, "case", "default") or k == i + 1 and self.tokens[i].kind == "id") and not self.is_(k + 1, ":"):
                return Node("label", i, k)
            if text == "{" and k in self.pair:
                if k > i and (self.is_(k - 1, ")", "const", "else", "try", "finally", "do") or self.tokens[k - 1].kind == "id") and not self.is_(k - 1, "="):
                    opener = next((j for j in range(i, k) if self.is_(j, "=")), None)
                    if opener is None:
                        return Node("function", i, self.pair[k], [(i, k)], [Node("block", k, self.pair[k], body=self._sequence(k + 1, self.pair[k]))])
                k = self.pair[k]
            elif text in ("(", "[") and k in self.pair:
                k = self.pair[k]
            k += 1
        return Node("simple", i, stop - 1)

    def _parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """Token ranges between semicolons at the top level of a..b-1."""
        out, k, at = [], a, a
        while k < b:
            if self.is_(k, ";"):
                out.append((at, k))
                at = k + 1
            elif k in self.pair and self.pair[k] > k:
                k = self.pair[k]
            k += 1
        return [*out, (at, b)]

    def walk(self):
        """All statements, outer ones first."""
        todo = self.nodes[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.body[::-1]

    def span(self, node: Node) -> tuple[int, int]:
        return self.tokens[node.first].start, self.tokens[node.last].end

    def source(self, node: Node) -> str:
        a, b = self.span(node)
        return self.code[a:b]

    def indent(self, node: Node) -> str:
        start = self.tokens[node.first].start
        line = self.code.rfind("\n", 0, start) + 1
        return re.match(r"[ \t]*", self.code[line:start])[0]

    def inner(self, node: Node) -> str:
        """Text of a body: what stands between the braces, or the single statement."""
        if node.kind == "block":
            return self.code[self.tokens[node.first].end : self.tokens[node.last].start].strip("\n").rstrip()
        return self.source(node)

    def declared(self) -> dict[str, str]:
        """Names that parameters, declarations and assignments bring in, with their type where one stands before."""
        if self._declared is None:
            self._declared = self._find_declared()
        return self._declared

    def _find_declared(self) -> dict[str, str]:
        if self.language == "go":
            return self._declared_in_go()
        out: dict[str, str] = {}
        tk = self.tokens
        python = self.language == "python"
        for i, t in enumerate(tk):
            if t.kind != "id" or t.text in KEYWORDS:
                continue
            before, after = tk[i - 1].text if i else "", tk[i + 1].text if i + 1 < len(tk) else ""
            if before in (".", "->", "::"):
                continue
            if python:
                opener = self.enclosing[i]
                in_def = opener is not None and opener >= 2 and tk[opener - 2].text == "def"
                if in_def and before in ("(", ",", "*", "**") or after == "=" and opener is None or before == "for" and opener is None or after in ("+=", "-=") and t.text in out:
                    out.setdefault(t.text, "")
            elif self.language == "php":
                if t.text.startswith("$"):
                    out.setdefault(t.text, "")
            elif self.language == "javascript":
                opener = self.enclosing[i]
                if before in ("let", "const", "var") or opener is not None and opener >= 1 and (tk[opener - 1].text == "function" or opener >= 2 and tk[opener - 2].text == "function") and before in ("(", ","):
                    out.setdefault(t.text, "")
            elif (i and tk[i - 1].kind == "id" and before not in ("return", "goto", "else", "new", "throw", "case", "throws", "struct", "class", "import", "package") or before in ("*", "&") and i > 1 and tk[i - 2].kind == "id" and tk[i - 2].text not in ("return",) and (i < 3 or tk[i - 3].text in ("(", ",", "{", ";", "struct", "const"))) and after in ("=", ";", ",", ")", "[", ":"):
                j = i - 1
                while j and tk[j].text in ("*", "&"):
                    j -= 1
                out.setdefault(t.text, tk[j].text)
        if self.language in ("c", "cpp", "java"):
            for node in self.walk():  # further names of a declaration
                if node.kind == "simple" and self.tokens[node.first].text in TYPES:
                    for k in range(node.first + 2, node.last):
                        if self.is_(k - 1, ",") and tk[k].kind == "id" and self.enclosing[k] == self.enclosing[node.first]:
                            out.setdefault(tk[k].text, tk[node.first].text)
        return out


    def _declared_in_go(self) -> dict[str, str]:
        """Names before ``:=``, after var and const, and in the brackets of a function's head, where types come after names."""
        out: dict[str, str] = {}
        tk = self.tokens

        def name(i: int) -> bool:
            return tk[i].kind == "id" and tk[i].text not in KEYWORDS and tk[i].text != "_"

        for i, t in enumerate(tk):
            if t.text == ":=" and t.kind == "op":
                k = i - 1
                while k >= 0 and name(k) and not self.is_(k - 1, "."):
                    out.setdefault(tk[k].text, "")
                    if not self.is_(k - 1, ","):
                        break
                    k -= 2
            elif t.text in ("var", "const") and t.kind == "id":
                k = i + 1
                while k < len(tk) and name(k):
                    out.setdefault(tk[k].text, tk[k + 1].text if k + 1 < len(tk) and tk[k + 1].kind == "id" else "")
                    if not self.is_(k + 1, ","):
                        break
                    k += 2
            elif t.text == "func" and t.kind == "id":
                k, lists = i + 1, 0
                while k < len(tk) and lists < 3:
                    if self.is_(k, "(") and k in self.pair:
                        out |= {n: kind for n, kind in self._go_parameters(k + 1, self.pair[k]).items() if n not in out}
                        k, lists = self.pair[k] + 1, lists + 1
                    elif tk[k].kind == "id" and self.is_(k + 1, "(") and lists < 2:
                        k += 1
                    else:
                        break
        return out

    def _go_parameters(self, a: int, b: int) -> dict[str, str]:
        parts, at, k = [], a, a
        while k <= b:
            if k == b or self.is_(k, ","):
                parts.append((at, k))
                at = k + 1
            elif k in self.pair and self.pair[k] > k:
                k = self.pair[k]
            k += 1
        named = [q - p > 1 and self.tokens[p].kind == "id" and self.tokens[p].text not in KEYWORDS and not self.is_(p + 1, ".", "[") or q - p > 3 and self.is_(p + 1, "[") and self.is_(p + 2, "]") for p, q in parts]
        if not any(named):
            return {}
        return {self.tokens[p].text: self.tokens[p + 1].text if q - p == 2 and self.tokens[p + 1].kind == "id" else "" for p, q in parts if q > p and self.tokens[p].kind == "id" and self.tokens[p].text not in KEYWORDS and self.tokens[p].text != "_"}


#: Sources that are kept, and the longest code of which one is.
KEPT, KEPT_CODE = 64, 20_000
_kept = functools.lru_cache(KEPT)(Source)


def source_of(code: str, language: str) -> Source:
    """The source of a code, one of the last that were asked for if it is among them; nothing changes a source."""
    return _kept(code, language) if len(code) <= KEPT_CODE else Source(code, language)


def apply(code: str, edits: list[tuple[int, int, str]]) -> str:
    """``code`` with edits (start, end, text); an edit that overlaps an earlier accepted one is left out."""
    done, out, at = [], [], 0
    for a, b, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if a >= at and (not done or a >= done[-1]):
            out += [code[at:a], new]
            at = b
            done.append(b)
    return "".join(out) + code[at:]
