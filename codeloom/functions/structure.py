"""Structure of code for comparison: sub-trees of statements, and where values come from."""

from __future__ import annotations

import ast
import functools
from collections import Counter

from codeloom.functions.styles.source import KEYWORDS, Node, Source, closes


def _shape(src: Source, node: Node) -> str:
    return f"({node.kind}{' ' if node.body else ''}{' '.join(_shape(src, b) for b in node.body)})"


def subtrees(code: str, language: str, src: Source | None = None) -> Counter:
    """S-expressions of all sub-trees; none for code that doesn't parse."""
    if language == "python":
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError):
            return Counter()
        out: Counter = Counter()

        def shape(n: ast.AST) -> str:
            kids = [shape(c) for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop))]
            s = f"({type(n).__name__}{' ' if kids else ''}{' '.join(kids)})"
            if kids:
                out[s] += 1
            return s

        shape(tree)
        return out
    src = src or Source(code, language)
    return Counter(_shape(src, n) for n in src.walk())


def flows(code: str, language: str, src: Source | None = None) -> list[tuple]:
    """(variable, comesFrom or computedFrom, parents) of every assignment, variables numbered as they come."""
    number: dict[str, str] = {}

    def var(name: str) -> str:
        return number.setdefault(name, f"var_{len(number)}")

    out = []
    if language == "python":
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError):
            return []
        for n in ast.walk(tree):
            if isinstance(n, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and n.value is not None:
                targets = n.targets if isinstance(n, ast.Assign) else [n.target]
                parents = [x.id for x in ast.walk(n.value) if isinstance(x, ast.Name)]
                for t in targets:
                    for x in ast.walk(t):
                        if isinstance(x, ast.Name):
                            out.append((x.id, "computedFrom" if len(parents) != 1 or not isinstance(n.value, ast.Name) else "comesFrom", tuple(parents)))
            elif isinstance(n, (ast.For, ast.comprehension)):
                parents = [x.id for x in ast.walk(n.iter) if isinstance(x, ast.Name)]
                out += [(x.id, "comesFrom", tuple(parents)) for x in ast.walk(n.target) if isinstance(x, ast.Name)]
    else:
        src = src or Source(code, language)
        for i, t in enumerate(src.tokens):
            if t.kind == "op" and t.text in ("=", "+=", "-=", "*=", "/=", "%=", ":=") and i and src.tokens[i - 1].kind == "id":
                k, parents, plain = i + 1, [], 0
                while k < len(src.tokens) and not src.is_(k, ";", ",", ")"):
                    if src.tokens[k].kind == "id" and src.tokens[k].text not in KEYWORDS and not src.is_(k + 1, "("):
                        parents.append(src.tokens[k].text)
                    plain += 1
                    k = src.pair[k] if src.is_(k, "[") and k in src.pair else k
                    k += 1
                out.append((src.tokens[i - 1].text, "comesFrom" if plain == 1 and parents else "computedFrom", tuple(parents)))
    return [(var(a), how, tuple(sorted(var(p) for p in parents))) for a, how, parents in out]


@functools.lru_cache(maxsize=256)
def features(code: str, language: str) -> tuple[Counter, Counter]:
    """Sub-trees and value flows of a code; those of the last codes are kept, as one code is often in several pairs."""
    src = None if language == "python" else Source(code, language)
    return subtrees(code, language, src), Counter(flows(code, language, src))


def compared(hypothesis: str, reference: str, language: str) -> tuple[int, int, int, int]:
    """Matched and all sub-trees, matched and all value flows of the reference."""
    a, b = features(hypothesis, language), features(reference, language)
    return (*matched(a[0], b[0]), *matched(a[1], b[1]))


def matched(a: Counter, b: Counter) -> tuple[int, int]:
    """How many of b's entries a has, and b's entries."""
    return sum((a & b).values()), sum(b.values())


def well_formed(code: str, language: str) -> bool:
    """Python that parses; in other languages brackets and quotes that close."""
    if language == "python":
        try:
            ast.parse(code)
        except (SyntaxError, ValueError, RecursionError):
            return False
        return True
    return closes(code)
