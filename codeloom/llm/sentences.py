"""Problem 9: sentence boundaries across languages and scripts.

A pushdown automaton runs over the marks of a text: terminators, quotation marks, brackets, line breaks and blanks
between Thai words. Its stack holds the open quotations and brackets; abbreviations are looked up in a trie from their
end; what follows a terminator decides where the script has letter case, the script's own terminators where not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations after which a sentence goes on whatever follows.
_GOES_ON = """
dr mr mrs ms prof capt lt col gen sgt st rev hon fig figs eq eqs sec ch chap p pp vol nos no art cf vs approx est e.g i.e viz al ca inc max min ref refs ed eds
tab app ex resp incl excl jan feb mar apr jun jul aug sep sept oct nov dec mt ver v.s
hr fr hrn nr bd z.b d.h u.a i.d.r s.o s.u bzw vgl kap abb evtl ggf inkl exkl mio mrd sog anm aufl tel geb gest str z.t o.ä i.a u.u z b d h
m mme mlle mm n° env v p.ex c.-à-d éd av apr boul mgr
sr sra srta dra d.ª pág págs cap núm aprox p.ej ej ud uds vd ee gral prov avda lic ing
см рис гл с стр табл ср напр проф акад ул им г гг тов т.е т.к т.н в.т.ч т ил
βλ σελ εικ αρ κεφ δρ κ κα πρβλ δηλ π.χ λ.χ τ.μ πίν
डॉ श्री प्रो कु पं सं पृ
د أ م ص ج ت هـ ق
ดร นาย รศ ผศ ศ พ.ศ ค.ศ
""".split()
# Abbreviations that can also be the last word of a sentence.
_CAN_END = """
etc a.m p.m inc ltd co corp jr bros usw ff f u.ä etc.pp и.т.д и.т.п т.д т.п др и.др кл κ.λπ κ.ά κ.τ.λ π.μ μ.μ p.m. ea et.al
""".split()
# Words with which a sentence goes on after a quotation, in scripts without letter case.
_AFTER_QUOTE = re.compile(
    r"\s*(?:[,，、;；:：)\]）】」』》〉.。!！?？…—–\-·،؛।]|然后|然後|接着|接著|随后|隨後|于是|於是|就|便|并|並|而|但|却|卻|后|後|之后|才|又|也|还|還|再|时|時|的|地|这|這|那|他说|他問|他问|她|问|問|说|說|道|写|寫|喊|回答|"
    r"と|って|という|は|が|を|に|の|で|も|から|まで|など|へ|や|"
    r"하고|라고|라는|라며|하며|이라고|이라는|라면서|고|며|는|은|이라|와|과|"
    r"और|तो|फिर|लेकिन|पर|तथा|कहकर|ऐसा|यह|कह|पूछ|लिख|को|से|में|का|की|के|ने|"
    r"ثم|و|ف|لكن|قال|سأل|كتب|أجاب|قبل|بعد|"
    r"แล้ว|และ|แต่|ก่อน|ว่า|จึง|ก็)"
)
# Abbreviations that are words in lower case, and units, which end a sentence after a number before a capital.
_ALSO_WORDS = frozenset("no ms art app ex est mar gen dec".split())
_UNITS = re.compile(r"\d\s?(?:sec|min|max|h|s|m|d|b|с|г|м|т|ч)$")
_ORDINAL_BEFORE = re.compile(r"(?:^|[\s(„\"'])(?:der|die|das|dem|den|des|am|im|zum|zur|vom|beim|ins|ans|ein|eine|einem|einen|einer|eines|jeder|jede|jedes|dieser|diese|dieses|unser|unsere|sein|seine|ihr|ihre|ab|bis|seit|und|oder|vor|nach|auf|in|zu)\s+\d{1,4}$", re.I)

_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "“": "”", "„": "“", "‚": "‘", "‘": "’", '"': '"', "'": "'", "`": "`", "〝": "〟"}
_BRACKETS = frozenset("([{（［【")
_CLOSERS = frozenset(")]}）］】」』》〉»›”’\"'“‘〟")
_FULL = frozenset("。！？｡．।॥؟։۔")
_ASCII = frozenset(".!?")
_TERMINAL = _FULL | _ASCII | frozenset("…‥;;")
_THAI = "ก-ฮะ-ฺเ-ๅ็-๎"
#: Letters without case; their scripts end sentences without regard to the next letter.
_UNCASED = re.compile(r"[֐-׿؀-ۿݐ-ݿऀ-෿ก-໿ᄀ-ᇿ぀-ヿ㄰-㆏㐀-䶿一-鿿가-힯]")
_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_GREEK = re.compile(r"[Ͱ-ͽͿ-Ͽἀ-῿]")
_EVENT = re.compile(rf"(?P<thai>(?<=[{_THAI}])\s+(?=[{_THAI}]))|[.!?…‥。！？｡．।॥؟։۔;;]+|[()\[\]{{}}（）［］【】「」『』《》〈〉«»‹›“”„‚‘’\"'`〝〟]|\n")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_MARKER = re.compile(r"[^\S\n]*(?:[-*+•‣▪◦·–—][^\S\n]+|(?:\d{1,3}[.)]|[A-Za-z]\)|[ivxIVX]{2,4}\))[^\S\n]+|\((?:\d{1,3}|[A-Za-z]|[ivx]{2,4})\)[^\S\n]+|\d{1,3}[、．][^\S\n]*)(?=\S)")
_BULLET = re.compile(r"[^\S\n]*[-*+•‣▪◦·]")
_SPACE = re.compile(r"\s*")
_ENDS_LINE = re.compile(r"[.!?…。！？।؟:：;][\"'”’»)\]）」』]*$")


def _trie(words: list[str], value: int, root: dict) -> dict:
    for word in words:
        node = root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node[""] = max(value, node.get("", 0))
    return root


_TRIE = _trie(_CAN_END, 2, _trie(_GOES_ON, 1, {}))


def abbreviation(text: str, end: int, start: int) -> int:
    """Kind of the longest abbreviation that ends before ``end`` (the place of a full stop): 0 none, 1 goes on, 2 can end.

    Blanks between the letters of an abbreviation count as its inner full stop's.
    """
    node, i, kind = _TRIE, end - 1, 0
    while i >= start:
        c = text[i]
        if c in "   \n" and i > start and text[i - 1] == ".":
            i -= 1
            continue
        node = node.get(c) or node.get(c.lower())
        if node is None:
            break
        if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] in "_.-")):
            kind = node[""]
        i -= 1
    return kind


class _Seen:
    """Whether a kind of letter has come up in the sentence so far; each part of a text is looked at once."""

    def __init__(self, letters: re.Pattern) -> None:
        self.letters, self.start, self.at, self.found = letters, -1, -1, False

    def __call__(self, text: str, start: int, at: int) -> bool:
        if start != self.start:
            self.start, self.at, self.found = start, start, False
        if not self.found and at > self.at:
            self.found = self.letters.search(text, self.at, at) is not None
        self.at = max(self.at, at)
        return self.found


def _goes_on(text: str, mark: str, at: int, end: int, start: int, stop: int, quoted: bool, uncased: bool) -> bool:
    """Whether the sentence goes on after the marks text[at:end]; ``quoted``: they stand within a quotation that ends at ``end``."""
    after = _SPACE.match(text, end, stop).end()
    if after >= stop:
        return False
    nxt = text[after]
    if quoted:
        if uncased or _UNCASED.match(nxt):
            return _AFTER_QUOTE.match(text, end, stop) is not None or after == end and not _CJK.match(nxt) and nxt.isalnum()
        return nxt.islower() or nxt in ",;:—–-)]}…»”.!?" or after == end and nxt.isalnum()
    if mark[-1] in _FULL:
        return nxt in "，、；：,"
    if nxt in ",;:":
        return True
    if after == end:  # no blank: within a name, number or address, unless the blank is missing
        if mark == "." and nxt.isupper() and after + 1 < stop and (text[after + 1].islower() or text[after + 1] == " "):
            word = re.search(r"(?:^|[\s(\"'„«“`])([^\W\d_]{2,}|\d+(?:[.,]\d+)?)[)\"'”»`]*$", text[max(start, at - 40) : at])
            return not (word and (word[1].islower() or word[1].istitle() or word[1][0].isdigit()) and not abbreviation(text, at, start) and re.match(r"[^\W\d_]+(?:['’][^\W\d_]+)?(?=[\s,])", text[after:stop]) is not None)
        if mark[-1] in "!?" and (nxt.isupper() or _CJK.match(nxt)):
            return not (text[at - 1].isalpha() or text[at - 1] in "`)\"'”»")
        return True
    if mark[0] in "…‥" or mark.startswith(".."):
        return nxt.islower() if not uncased else True
    if mark[-1] == ".":
        kind = abbreviation(text, at, start)
        word = re.search(r"[^\W\d_]+$", text[max(start, at - 24) : at])
        if kind == 1 and nxt.isupper() and word is not None and (word[0] in _ALSO_WORDS or _UNITS.search(text[max(start, at - 8) : at])):
            return False
        if kind == 1:
            return True
        single = word is not None and len(word[0]) == 1 and (at - 2 < start or not (text[at - 2].isalnum() or text[at - 2] in "_.`-'’"))
        if kind == 0 and single and (word[0].isupper() or uncased):
            return True
        if uncased:
            return False
        if nxt.islower():
            return True
        if kind == 2:
            return nxt.isdigit()
        if single and nxt.isdigit():
            return True
        return nxt.isupper() and _ORDINAL_BEFORE.search(text[max(start, at - 30) : at]) is not None
    if uncased:
        return False
    return nxt.islower()


def _sentences(text: str, start: int, stop: int, ignore: frozenset = frozenset()) -> list[tuple[int, int]] | set:
    """Sentences of one paragraph or list item; the places of marks that were opened and never closed, if there are any.

    Marks at the places in ``ignore`` open and close nothing.
    """
    uncased, greek, cjk = _Seen(_UNCASED), _Seen(_GREEK), _Seen(_CJK)
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    awaited: Counter = Counter()  # closing marks of what is open
    begin = _SPACE.match(text, start, stop).end()
    ended = False  # whether the last thing seen was a terminator within a quotation
    last_mark = ""
    last_end = -1
    for m in _EVENT.finditer(text, begin, stop):
        at, end, mark = m.start(), m.end(), m[0]
        if at < begin:
            continue
        c = mark[0]
        if m["thai"]:
            if not stack:
                out.append((begin, at))
                begin = end
            continue
        if c == "\n":
            continue
        if c in _TERMINAL:
            if c in ";;":
                if stack or len(mark) > 1 and mark.strip(";;") == "" or not (c == ";" or greek(text, begin, at)):
                    continue
                nxt = _SPACE.match(text, end, stop).end()
                if nxt == end and nxt < stop or nxt < stop and text[nxt].islower():
                    continue
                out.append((begin, end))
                begin = nxt
                continue
            last_mark, last_end = mark, end
            if stack or all(x in "…‥" for x in mark) and cjk(text, begin, at):
                continue
            while end < stop and text[end] in "”’»」』）)" and not any(o for o, _ in stack):
                end += 1
            if not _goes_on(text, mark, at, end, begin, stop, False, uncased(text, begin, at)):
                out.append((begin, end))
                begin = _SPACE.match(text, end, stop).end()
            continue
        if at in ignore:
            continue
        closes = False
        if stack:
            top = stack[-1][0]
            if top == "`":
                if c == "`":
                    awaited[_PAIRS[stack.pop()[0]]] -= 1
                continue
            closes = c == _PAIRS[top] or top == "„" and c in "“”\"" or top == "“" and c in "”\"" and c == "”" or top == "»" and c == "«"
            if c in "'’" and closes:
                closes = not (end < stop and text[end].isalnum() and not _CJK.match(text[end])) and at > 0 and not text[at - 1].isspace()
            elif not closes and c in ")]}）］】」』》〉»›”" and awaited[c] > 0:
                while _PAIRS[stack[-1][0]] != c:  # what was opened within isn't closed
                    awaited[_PAIRS[stack.pop()[0]]] -= 1
                closes = True
        if closes:
            opener, opened = stack.pop()
            awaited[_PAIRS[opener]] -= 1
            if not stack:
                inner = text[opened + 1 : at].rstrip()
                ended = bool(inner) and inner[-1] in _TERMINAL - {";", ";"}
                if ended:
                    mark_at = last_end - len(last_mark)
                    if opener in _BRACKETS:
                        after = _SPACE.match(text, end, stop).end()
                        own = opened == begin
                        if own and not (after < stop and (text[after].islower() and not uncased(text, begin, at) or text[after] in ",;:，、；：.。")):
                            out.append((begin, end))
                            begin = after
                    elif not _goes_on(text, last_mark, mark_at, end, begin, stop, True, uncased(text, begin, at)):
                        out.append((begin, end))
                        begin = _SPACE.match(text, end, stop).end()
            continue
        if c in _PAIRS:
            before = text[at - 1] if at > start else " "
            if c == "'" and (before.isalnum() or before in "_)`]" or end >= stop or text[end].isspace()):
                continue
            if c == '"' and end < stop and text[end].isspace() and not before.isspace():
                continue
            if c == "“" and before.isalnum() and not _CJK.match(before) and not (end < stop and text[end].isalnum()):
                continue
            stack.append((c, at))
            awaited[_PAIRS[c]] += 1
    if stack:
        return {at for _, at in stack}
    if begin < stop:
        out.append((begin, stop))
    return out


def _parts(text: str) -> Iterator[tuple[int, int]]:
    """Paragraphs, and within paragraphs of lists the items."""
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        stop = m.start() if m else len(text)
        if text[at:stop].strip():
            starts, line = [at], at
            first = text[at:stop].lstrip("\n")
            listed = _MARKER.match(first) is not None
            while (line := text.find("\n", line, stop) + 1) > 0:
                if _MARKER.match(text, line, stop):
                    previous = text[text.rfind("\n", at, line - 1) + 1 if text.rfind("\n", at, line - 1) >= 0 else at : line - 1].rstrip()
                    if listed or previous.endswith((":", "：")) or _BULLET.match(text, line, stop) and _ENDS_LINE.search(previous):
                        listed = True
                        starts.append(line)
            for i, s in enumerate(starts):
                yield s, starts[i + 1] if i + 1 < len(starts) else stop
        at = m.end() if m else stop


def offsets(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, in code points, without surrounding white space; together they cover all else."""
    if "\r" in text:
        text = text.replace("\r\n", " \n").replace("\r", "\n")
    out = []
    for start, stop in _parts(text):
        marker = _MARKER.match(text, start, stop)
        body = marker.end() if marker else start
        ignore: frozenset = frozenset()
        # marks that turn out unclosed open nothing; each pass finds all that the ones before leave open, and never one twice
        while isinstance(got := _sentences(text, body, stop, ignore), set):
            ignore |= got
        if marker and got:
            got[0] = (start, got[0][1])
        for a, b in got:
            piece = text[a:b]
            a += len(piece) - len(piece.lstrip())
            b -= len(piece) - len(piece.rstrip())
            if a < b:
                out.append((a, b))
    return out


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, start_off, end_off`` of each sentence; null, empty and blank texts have none. Repeated rows are repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, a, b) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for a, b in offsets(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_off", "end_off"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return texts.mapInPandas(run, "doc_id long, start_off int, end_off int")
