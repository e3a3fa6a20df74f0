"""Words of records: folding, hashing and the sources that problems 4 to 6 read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records with fewer words are no case.
LEAST_WORDS = 10
#: Runs of letters, digits and underscores.
_WORD = re.compile(r"\w+")
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95))
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts are folded in slices of about so many code points, to bound memory.
SLICE = 1_000_000


def sources(functions: DataFrame, cs: DataFrame) -> DataFrame:
    """``src, key, text`` of both tables; rows of ``cs`` with one ``idx`` are one record (the largest code, nulls last)."""
    a = functions.select(F.lit("functions_raw").alias("src"), F.col("pos").cast("long").alias("key"), F.col("func").alias("text"))
    b = cs.select(F.lit("cs").alias("src"), F.col("idx").alias("key"), F.col("code").alias("text"))
    return a.union(b)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Folder:
    """Skip-and-fold table over code points: 0 skips, anything else is the folded code point.

    The table is filled as code points are met. A few letters fold by context or into several code points; texts with
    those are lower-cased first.
    """

    def __init__(self) -> None:
        self.fold = np.zeros(0x110000, np.uint32)
        self.known = np.zeros(0x110000, bool)
        self.odd = np.zeros(0x110000, bool)
        self._learn(range(128))
        self.powers = [np.ones(1, _U) for _ in range(3)]

    def _learn(self, codes) -> None:
        for c in codes:
            low = chr(c).lower()
            if len(low) != 1 or c in (0x3A3, 0x3C2):
                self.odd[c] = True
            low = low if len(low) == 1 else chr(c)
            if low.isalnum() or low == "_":
                self.fold[c] = ord(low)
            self.known[c] = True

    def _codes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not text.isascii():
            new = np.unique(codes[~self.known[codes]])
            self._learn(int(c) for c in new)
        return codes

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two polynomial hashes and the number of words of each text."""
        done = [self._slice(texts[a:b]) for a, b in self.slices(texts)]
        if not done:
            return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def slices(self, texts: list[str]):
        """Ranges of rows whose texts have together about SLICE code points."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) < SLICE):
                size += len(texts[end]) + 1
                end += 1
            yield at, end
            at = end

    def word_hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word of all texts, in order; the row of each word; words and hash of the word sequence of each row."""
        where, starts, place, record, symbol, _, _, n_words = self._fold(texts)
        powers = self._powers(0, _BASES[0], int(place.max(initial=0)) + 2)
        run = np.concatenate([np.zeros(1, _U), np.cumsum(mix(symbol + _U(0x632BE59BD9B4E019)) * powers[place], dtype=_U)])
        first = np.flatnonzero(starts)
        after = np.append(first[1:], len(where))
        back = self._powers(2, _INVERSE, len(powers))
        words = mix((run[after] - run[first]) * back[place[first]])
        ends = np.cumsum(n_words)
        begins = ends - n_words
        index = np.arange(len(words)) - np.repeat(begins, n_words)
        run = np.concatenate([np.zeros(1, _U), np.cumsum(words * self._powers(0, _BASES[0], int(n_words.max(initial=0)) + 1)[index], dtype=_U)])
        return words, record[first], n_words, mix(run[ends] - run[begins] + n_words.astype(_U))

    def _slice(self, texts: list[str]) -> tuple:
        where, starts, place, record, symbol, edges, last, n_words = self._fold(texts)
        out = []
        for i, base in enumerate(_BASES):
            powers = self._powers(i, base, int(place.max(initial=0)) + 2)
            value = mix(symbol + _U(0x632BE59BD9B4E019) * _U(i + 1)) * powers[place]
            value += np.where(starts, powers[np.maximum(place - 1, 0)] * _U(0x2545F4914F6CDD1D), _U(0))
            run = np.concatenate([np.zeros(1, _U), np.cumsum(value, dtype=_U)])
            out.append(run[last] - run[edges])
        return out[0], out[1], n_words

    def _fold(self, texts: list[str]) -> tuple:
        codes = self._codes("\x00".join(texts) + "\x00")
        if codes.max() > 127 and self.odd[codes].any():
            texts = [t if t.isascii() else t.lower() for t in texts]
            codes = self._codes("\x00".join(texts) + "\x00")
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        begins = ends - np.diff(ends, prepend=0)
        folded = self.fold[codes]
        kept = folded != 0
        start = kept.copy()
        start[1:] &= ~kept[:-1]
        where = np.flatnonzero(kept)
        starts = start[where]
        place = np.cumsum(starts.astype(np.int64) + 1)
        edges = np.searchsorted(where, begins)
        last = np.append(edges[1:], len(where))
        before = np.concatenate([[0], place])[edges]
        record = np.repeat(np.arange(len(texts)), last - edges)
        place = place - before[record] - 1
        words = np.concatenate([[0], np.cumsum(starts)])
        n_words = words[last] - words[edges]
        symbol = folded[where].astype(_U)
        return where, starts, place, record, symbol, edges, last, n_words

    def _powers(self, i: int, base: np.uint64, n: int) -> np.ndarray:
        if len(self.powers[i]) < n:
            steps = np.full(max(n, 2 * len(self.powers[i])), base, _U)
            steps[0] = _U(1)
            self.powers[i] = np.multiply.accumulate(steps)
        return self.powers[i]


#: Texts are compared in blocks of so many code points.
BLOCK = 4096
_folder: list[Folder] = []


def _folded_blocks(folder: Folder, text: str) -> Iterator[np.ndarray]:
    """What the fold table leaves of a text, block by block, with a 0 before every word but the first."""
    if not text.isascii() and folder.odd[folder._codes(text)].any():
        text = text.lower()  # letters that fold by their neighbours
    inside = begun = False
    for at in range(0, len(text), BLOCK):
        folded = folder.fold[folder._codes(text[at : at + BLOCK])]
        kept = folded != 0
        start = kept.copy()
        start[1:] &= ~kept[:-1]
        start[0] &= not inside
        inside = bool(kept[-1])
        where = np.flatnonzero(kept)
        if not len(where):
            continue
        starts = np.flatnonzero(start[where])
        if not begun and len(starts) and starts[0] == 0:
            starts = starts[1:]
        begun = True
        yield np.insert(folded[where], starts, 0)


def same_words(a: str, b: str) -> bool:
    """Two pointers run over both texts, skipping what isn't a word; of either only a block is folded at a time."""
    if not _folder:
        _folder.append(Folder())
    x, y = _folded_blocks(_folder[0], a), _folded_blocks(_folder[0], b)
    p = q = np.zeros(0, np.uint32)
    while True:
        p = p if len(p) else next(x, None)
        q = q if len(q) else next(y, None)
        if p is None or q is None:
            return p is q
        n = min(len(p), len(q))
        if not np.array_equal(p[:n], q[:n]):
            return False
        p, q = p[n:], q[n:]


def word_count(text: str) -> int:
    return sum(1 for _ in _WORD.finditer(text.lower()))


def ranges(owner: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(owner):
        return []
    cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(owner)], strict=True))


_P, _Q = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def shingles(words: np.ndarray, record: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``n`` consecutive words of each record as hashes, sorted by record and hash, and their records."""
    m = len(words) - n + 1
    if m <= 0:
        return words[:0], record[:0]
    run = mix(words[n - 1 :] * _P)
    for i in range(n - 2, -1, -1):
        run = mix((words[i : i + m] + run * _Q) ^ _P)
    whole = record[:m] == record[n - 1 :]
    run, owner = run[whole], record[:m][whole]
    for a, b in ranges(owner):  # records are short, so sorting each is quicker than sorting all by two keys
        run[a:b].sort()
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    return run[new], owner[new]
