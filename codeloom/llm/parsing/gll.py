"""Generalised LL parsing with a graph-structured stack, memoised over token kinds.

A grammar is a set of rules in EBNF; each rule becomes a small deterministic automaton over tokens and other rules. The
parser runs all alternatives, and the grammars of all dialects of a language, side by side on one stack: a configuration is a set
of (automaton state, stack node) pairs, a stack node the set of places to return to. Nodes and configurations are shared
and numbered, so the step from one configuration over a token is computed once and then looked up. Where only one
pair is left after an opening bracket, its node moves to a plain stack, so that what follows is independent of nesting.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:'([^']*)'|([A-Za-z_][A-Za-z0-9_]*)|([|()*+?=;]))")
#: Kinds that open a bracket: after them the stack below may be set aside.
OPENING = frozenset({"{", "(", "[", "INDENT"})
#: Configurations kept; beyond, all are forgotten and found anew.
MOST = 400_000


def _rules(text: str) -> dict[str, object]:
    tokens, at = [], 0
    text = re.sub(r"#.*", "", text).strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        tokens.append(("lit", m[1]) if m[1] is not None else ("name", m[2]) if m[2] else ("op", m[3]))
        at = m.end()
    at = 0

    def alternatives():
        nonlocal at
        options = [sequence()]
        while at < len(tokens) and tokens[at] == ("op", "|"):
            at += 1
            options.append(sequence())
        return ("alt", options)

    def sequence():
        nonlocal at
        parts = []
        while at < len(tokens) and tokens[at] not in (("op", "|"), ("op", ")"), ("op", ";")):
            if tokens[at] == ("op", "("):
                at += 1
                part = alternatives()
                at += 1
            else:
                part = tokens[at]
                at += 1
            while at < len(tokens) and tokens[at][0] == "op" and tokens[at][1] in "*+?":
                part = (tokens[at][1], part)
                at += 1
            parts.append(part)
        return ("seq", parts)

    rules = {}
    while at < len(tokens):
        name = tokens[at][1]
        at += 2
        rules[name] = alternatives()
        at += 1
    return rules


def _renamed(body, names: dict[str, str]):
    """A rule's body with other names of rules."""
    kind, arg = body
    if kind in ("alt", "seq"):
        return (kind, [_renamed(x, names) for x in arg])
    if kind in ("*", "+", "?"):
        return (kind, _renamed(arg, names))
    return (kind, names.get(arg, arg)) if kind == "name" else body


def _refers(body) -> set[str]:
    kind, arg = body
    if kind in ("alt", "seq"):
        return set().union(*(_refers(x) for x in arg)) if arg else set()
    if kind in ("*", "+", "?"):
        return _refers(arg)
    return {arg} if kind == "name" else set()


def together(texts: list[str], start: str) -> dict:
    """Rules of several dialects under one start; what is the same in a dialect as in the first is there once."""
    first = _rules(texts[0])
    out = dict(first)
    starts = [start]
    for i, text in enumerate(texts[1:], 1):
        own = _rules(text)
        other = {n for n, body in own.items() if first.get(n) != body}
        while more := {n for n, body in own.items() if n not in other and _refers(body) & other}:
            other |= more
        names = {n: f"{n}/{i}" for n in other}
        out |= {names[n]: _renamed(own[n], names) for n in other}
        starts.append(names.get(start, start))
    out["<start>"] = ("alt", [("seq", [("name", s)]) for s in starts])
    return out


class Grammar:
    """Rules ``name = alternatives ;`` with '...' for token kinds, * + ? and ( ); names without a rule are token kinds.

    Each text is the grammar of one dialect; a sentence of any of them is accepted.
    """

    def __init__(self, *texts: str, start: str = "unit") -> None:
        rules = together(list(texts), start)
        start = "<start>"
        self.names = list(rules)
        number = {n: i for i, n in enumerate(rules)}
        self.shift: list[dict[str, int]] = []  # of each state: kind -> state
        self.call: list[dict[int, int]] = []  # of each state: rule -> state after it
        self.final: list[bool] = []
        self.begin: list[int] = []
        for name, body in rules.items():
            self.begin.append(self._automaton(name, body, number))
        self._order(number)
        self.start = self.begin[number[start]]
        self.forget()

    def _automaton(self, name: str, body, number: dict[str, int]) -> int:
        eps: list[list[int]] = []
        moves: list[list[tuple]] = []

        def new() -> int:
            eps.append([])
            moves.append([])
            return len(eps) - 1

        def build(node, a: int) -> int:
            kind, arg = node
            if kind == "alt":
                end = new()
                for option in arg:
                    eps[build(option, a)].append(end)
                return end
            if kind == "seq":
                for part in arg:
                    a = build(part, a)
                return a
            if kind in ("*", "+", "?"):
                into, end = new(), new()
                eps[a].append(into)
                out = build(arg, into)
                eps[out].append(end)
                if kind != "?":
                    eps[out].append(into)
                if kind != "+":
                    eps[into].append(end)
                return end
            end = new()
            moves[a].append((("rule", number[arg]) if kind == "name" and arg in number else ("kind", arg), end))
            return end

        first = new()
        last = build(body, first)

        def closed(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for s in eps[todo.pop()]:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
            return frozenset(seen)

        known: dict[frozenset, int] = {}

        def state(of: frozenset) -> int:
            if of not in known:
                known[of] = len(self.shift)
                self.shift.append({})
                self.call.append({})
                self.final.append(last in of)
                todo.append(of)
            return known[of]

        todo: list[frozenset] = []
        begin = state(closed([first]))
        if self.final[begin]:
            raise ValueError(f"rule {name} can be empty")
        while todo:
            of = todo.pop()
            by: dict[tuple, set] = {}
            for s in of:
                for symbol, to in moves[s]:
                    by.setdefault(symbol, set()).add(to)
            for (kind, arg), to in by.items():
                (self.call if kind == "rule" else self.shift)[known[of]][arg] = state(closed(to))
        return begin

    def _order(self, number: dict[str, int]) -> None:
        """First kinds of each rule, and an order in which a rule comes before those that it begins with."""
        n = len(self.begin)
        done: dict[int, int] = {}
        order: list[int] = []

        def visit(r: int) -> None:
            if done.get(r) == 1:
                raise ValueError(f"rule {self.names[r]} begins with itself")
            if r not in done:
                done[r] = 1
                for q in self.call[self.begin[r]]:
                    visit(q)
                done[r] = 2
                order.append(r)

        for r in range(n):
            visit(r)
        self.first: list[set[str]] = [set() for _ in range(n)]
        for r in order:
            self.first[r] = set(self.shift[self.begin[r]]).union(*(self.first[q] for q in self.call[self.begin[r]]))
        self.rank = [0] * n
        for i, r in enumerate(reversed(order)):
            self.rank[r] = i

    def forget(self) -> None:
        self.nodes: list[frozenset] = [frozenset()]  # node 0: the bottom, where a set-aside stack goes on
        self.node_ids: dict[frozenset, int] = {frozenset(): 0}
        self.configs: list[tuple] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.closes: list[bool] = []  # whether a rule may end at the bottom
        self.on_top: dict[tuple, int] = {}
        self.restored: dict[tuple, int] = {}
        self.first_id = self._config({(self.start, 0)})

    def _node(self, edges: frozenset) -> int:
        i = self.node_ids.get(edges)
        if i is None:
            i = self.node_ids[edges] = len(self.nodes)
            self.nodes.append(edges)
        return i

    def _config(self, pairs: set) -> int:
        """Number of a configuration; pairs with the same state become one with all their places to return to."""
        by: dict[int, set] = {}
        for s, node in pairs:
            by.setdefault(s, set()).add(node)
        merged = []
        for s, own in by.items():
            if len(own) > 1 and 0 not in own:
                own = {self._node(frozenset().union(*(self.nodes[x] for x in own)))}
            merged += [(s, x) for x in own]
        key = frozenset(merged)
        i = self.ids.get(key)
        if i is None:
            i = self.ids[key] = len(self.configs)
            self.configs.append(tuple(merged))
            self.steps.append({})
            self.closes.append(any(n == 0 and self.final[s] for s, n in self._ended(merged)))
        return i

    def _ended(self, pairs) -> set:
        """The pairs, and those to which rules that may end here return."""
        all_, todo = set(pairs), list(pairs)
        while todo:
            s, node = todo.pop()
            if self.final[s]:
                for back in self.nodes[node]:
                    if back not in all_:
                        all_.add(back)
                        todo.append(back)
        return all_

    def _put(self, node: int, below: int) -> int:
        """The stack ``node`` with ``below`` as its bottom; stacks may be deep, so this doesn't recur."""
        done, todo = self.on_top, [node]
        while todo:
            n = todo[-1]
            if n == 0 or (n, below) in done:
                todo.pop()
                continue
            missing = [m for _, m in self.nodes[n] if m and (m, below) not in done]
            if missing:
                todo += missing
                continue
            done[n, below] = self._node(frozenset((s, done[m, below] if m else below) for s, m in self.nodes[n]))
            todo.pop()
        return done[node, below] if node else below

    def _restore(self, config: int, below: int) -> int:
        i = self.restored.get((config, below))
        if i is None:
            i = self.restored[config, below] = self._config({(s, self._put(n, below)) for s, n in self.configs[config]})
        return i

    def _step(self, config: int, kind: str) -> int:
        """Configuration after ``kind``; -1 if there is none. Twice its number, plus 1 if the stack changes there."""
        pairs = self._ended(self.configs[config])
        calls: dict[int, set] = {}
        todo = list(pairs)
        after: set = set()
        while True:
            for s, node in todo:
                if kind in self.shift[s]:
                    after.add((self.shift[s][kind], node))
                for rule, back in self.call[s].items():
                    if kind in self.first[rule]:
                        calls.setdefault(rule, set()).add((back, node))
            if not calls:
                break
            rule = min(calls, key=self.rank.__getitem__)
            todo = [(self.begin[rule], self._node(frozenset(calls.pop(rule))))]
        if not after:
            return -1
        to = self._config(after)
        pairs = self.configs[to]
        opens = kind in OPENING and len(pairs) == 1 and pairs[0][1] != 0 and not self.final[pairs[0][0]]
        return 2 * to + (opens or self.closes[to])

    def _after(self, now: int, below: int, kind: str, cells: list, known: dict) -> tuple[int, int] | None:
        """The state after a token, as in ``accepts``; what is set aside is a chain of shared cells."""
        to = self.steps[now].get(kind)
        if to is None:
            to = self.steps[now][kind] = self._step(now, kind)
        if to < 0:
            return None
        now = to >> 1
        if to & 1:
            if self.closes[now]:
                while below and self.closes[now]:
                    below, node = cells[below]
                    now = self._restore(now, node)
            else:
                ((state, node),) = self.configs[now]
                if (below, node) not in known:
                    known[below, node] = len(cells)
                    cells.append((below, node))
                below = known[below, node]
                now = self._config({(state, 0)})
        return now, below

    def _accepts_branches(self, kinds: list[str]) -> bool:
        """Whether a choice of branches of all conditional directives is a sentence.

        The states before a directive go into its branches, and past it where it has no else; those after each branch go on
        behind the end, and into the next branch too, as many texts hold when all branches are read. Equal states are one.
        """
        cells, known = [(0, 0)], {}
        states = {(self.first_id, 0)}
        open_: list[list] = []  # states before, states after its branches so far, whether an else was seen
        for kind in kinds:
            if kind == "\x01if":
                open_.append([states, set(), False])
            elif kind in ("\x01elif", "\x01else"):
                if not open_ or open_[-1][2]:
                    return False
                open_[-1][1] |= states
                open_[-1][2] = kind == "\x01else"
                states = open_[-1][0] | states
            elif kind == "\x01endif":
                if not open_:
                    return False
                before, after, seen = open_.pop()
                states = states | after | (set() if seen else before)
            elif kind[0] != "\x01":
                states = {s for now, below in states if (s := self._after(now, below, kind, cells, known)) is not None}
                if not states and not open_:
                    return False
        return bool(states) and not open_ and kinds[-1] == "EOF"

    def accepts(self, kinds: list[str]) -> bool:
        """Whether the kinds, followed by EOF, are a sentence; kinds of conditional directives fork what is read."""
        if len(self.configs) > MOST:
            self.forget()
        if any(k[0] == "\x01" for k in kinds):
            return self._accepts_branches(kinds)
        steps, below = self.steps, []
        now = self.first_id
        for kind in kinds:
            to = steps[now].get(kind)
            if to is None:
                to = steps[now][kind] = self._step(now, kind)
            if to < 0:
                return False
            now = to >> 1
            if to & 1:
                if self.closes[now]:  # what was set aside goes on
                    while below and self.closes[now]:
                        now = self._restore(now, below.pop())
                else:
                    ((state, node),) = self.configs[now]
                    below.append(node)
                    now = self._config({(state, 0)})
        return bool(kinds) and kinds[-1] == "EOF"
