"""Periodic runs of words, found on a Re-Pair grammar.

A run is a stretch of words with smallest period q (words q apart are identical), of at least
max(LEAST, EXPONENT * q) words, that no neighbouring word extends.  Spark deals the documents
out; a task takes them in slices of about SLICE_BYTES and works on all of a slice at once:

1. Words get ids.  In a run every pair of neighbours occurs at least EXPONENT - 1 times in its
   document, so the words are cut into stretches where a rarer pair stands: no run crosses a
   cut.  Stretches shorter than LEAST words end here.
2. Re-Pair: each round counts the pairs of neighbouring symbols inside stretches and replaces,
   where a pair beats both its neighbours (by count, then hash), all its occurrences by one
   symbol; the pair of most occurrences always does.  When no pair repeats, what is left of a
   stretch is paired off until one symbol spans it.
3. For each symbol, once, the runs that cross the boundary between its two parts: one side has
   at least half the run, so it begins (or ends) with a square of the period; squares at the
   ends of symbols come from the Z-function of their words, once a symbol.
4. The runs of a symbol are put at all places where it was made, and intervals of one period
   that overlap by the period or more are joined.  A run is complete at the lowest symbol that
   spans it, so the joined intervals are the runs.

Word ids are exact (no hashes stand for words).  A null text has no words.  Null ids stay null, repeated ids give a
row each, an empty table gives none, extra columns are dropped.  One document is in one task;
its cost is n log n in its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.words import Words, mix, text_buffers

LEAST, EXPONENT = 6, 4
SLICE_BYTES = 2 << 20
RESULT = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_ids(words: Words) -> np.ndarray:
    """A number for each word, equal for equal words of the slice; words of one hash are compared."""
    _, first, ids = np.unique(words.hash, return_index=True, return_inverse=True)
    length = words.end - words.start
    same = length == length[first][ids]
    if same.all():
        a, b = words.start, words.start[first][ids]
        far = np.repeat(b - a, length)
        at = np.arange(length.sum()) + np.repeat(a - np.cumsum(length) + length, length)
        if (words.raw[at] == words.raw[at + far]).all():
            return ids
    known: dict[bytes, int] = {}  # a hash stands for different words
    raw = words.raw.tobytes()
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)], np.int64)


def stretches(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The stretch of each word in which runs may be; -1 for words outside."""
    n = len(ids)
    inside = doc[1:] == doc[:-1]
    _, pair = np.unique(ids[:-1] * np.int64(n + 1) + ids[1:], return_inverse=True)
    _, key, count = np.unique(doc[:-1] * np.int64(n + 1) + pair, return_inverse=True, return_counts=True)
    joined = inside & (count[key] >= EXPONENT - 1)
    number = np.r_[0, np.cumsum(~joined)]
    long = np.bincount(number) >= LEAST
    return np.where(long[number], number, -1)


class Grammar:
    """Symbols of the stretches' words: terminals are word ids, symbol ``first + i`` has the parts
    ``left[i]`` and ``right[i]``.  ``made`` has, round by round, symbols and the places of their first words."""

    def __init__(self, ids: np.ndarray, stretch: np.ndarray) -> None:
        self.first = self.next = int(ids.max(initial=-1)) + 1
        self.left: list[int] = []
        self.right: list[int] = []
        self.made: list[tuple[np.ndarray, np.ndarray]] = []
        self.known: dict[tuple[int, int], int] = {}
        at = np.flatnonzero(stretch >= 0)
        self.symbol, self.place, self.stretch = ids[at].astype(np.int64), at, stretch[at]
        while self._repair():
            pass
        while self._pair_off():
            pass

    def _replace(self, chosen: np.ndarray, names: np.ndarray) -> None:
        self.made.append((names, self.place[chosen]))
        self.symbol[chosen] = names
        keep = np.ones(len(self.symbol), bool)
        keep[chosen + 1] = False
        self.symbol, self.place, self.stretch = self.symbol[keep], self.place[keep], self.stretch[keep]

    def _name(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Symbols of different pairs, new where the pair has none."""
        out = np.empty(len(left), np.int64)
        for i, pair in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            if (have := self.known.get(pair)) is None:
                have = self.known[pair] = self.next
                self.left.append(pair[0])
                self.right.append(pair[1])
                self.next += 1
            out[i] = have
        return out

    def _repair(self) -> bool:
        """One round: pairs that repeat and beat their neighbours are replaced."""
        s = self.symbol
        if len(s) < 2:
            return False
        inside = self.stretch[1:] == self.stretch[:-1]
        # of equal symbols in a row every second pair counts, so occurrences never overlap
        equal = inside & (s[1:] == s[:-1])
        i = np.arange(len(equal))
        begin = np.maximum.accumulate(np.where(equal & ~np.r_[False, equal[:-1]], i, -1))
        counts = inside & ~(equal & ((i - begin) % 2 == 1))
        key, pair = np.unique(s[:-1] * np.int64(self.next) + s[1:], return_inverse=True)
        n = np.bincount(pair, weights=counts, minlength=len(key)).astype(np.int64)
        order = np.lexsort((mix(key.astype(np.uint64)), n))
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key))
        rank = np.where(n >= 2, rank, -1)[pair]
        rank[~counts] = -1
        won = (rank >= 0) & (rank > np.r_[-1, rank[:-1]]) & (rank > np.r_[rank[1:], -1])
        chosen = np.flatnonzero(won)
        often = np.bincount(pair[chosen], minlength=len(key)) >= 2
        chosen = chosen[often[pair[chosen]]]
        if not len(chosen):
            return False
        kinds, which = np.unique(pair[chosen], return_inverse=True)
        self._replace(chosen, self._name(key[kinds] // self.next, key[kinds] % self.next)[which])
        return True

    def _pair_off(self) -> bool:
        """Pairs off the symbols of each stretch, first with second, third with fourth."""
        same = np.r_[False, self.stretch[1:] == self.stretch[:-1]]
        if not same.any():
            return False
        i = np.arange(len(same))
        begin = np.maximum.accumulate(np.where(~same, i, 0))
        chosen = np.flatnonzero((i - begin) % 2 == 0)
        chosen = chosen[np.r_[same[1:], False][chosen]]
        left, right = self.symbol[chosen], self.symbol[chosen + 1]
        self._replace(chosen, self._name(left, right))
        return True


def prefix_squares(w: list[int]) -> list[tuple[int, int]]:
    """(q, longest common prefix of w and w[q:]) of each q with a square w[:2 q], by the Z-function."""
    n = len(w)
    z = [0] * n
    left = right = 0
    out = []
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
        if k >= i:
            out.append((i, k))
    return out


class Squares:
    """Squares at the ends of symbols, found once a symbol."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.have = ids, {}

    def of(self, symbol: int, at: int, length: int, back: bool) -> list[tuple[int, int]]:
        if (found := self.have.get((symbol, back))) is None:
            w = self.ids[at : at + length]
            w = w[::-1] if back else w
            # a square's second half begins with the first word
            some = length >= 2 and (w[1 : length // 2 + 1] == w[0]).any()
            found = self.have[symbol, back] = prefix_squares(w.tolist()) if some else []
        return found


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    step, at = 64, 0
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def crossing(w: np.ndarray, middle: int, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of ``w`` with words on both sides of ``middle``."""
    n, found = len(w), {}
    for q, k in right:  # w[middle:] begins with a square
        start = middle - _shared(w[:middle][::-1], w[: middle + q][::-1])
        found.setdefault((start, min(n, middle + q + k)), []).append(q)
    for q, k in left:  # w[:middle] ends with one
        end = middle + _shared(w[middle:], w[middle - q :])
        found.setdefault((max(0, middle - q - k), end), []).append(q)
    out = []
    for (start, end), periods in found.items():
        q = min(periods)
        if start < middle < end and end - start >= max(LEAST, EXPONENT * q):
            out.append((start, end, q))
    return out


def find_runs(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(start, end, period) rows, by start and period, of the runs of words ``ids``; none crosses from one ``doc`` to another."""
    none = np.zeros((0, 3), np.int64)
    if len(ids) < LEAST:
        return none
    stretch = stretches(ids, doc)
    if (stretch < 0).all():
        return none
    g = Grammar(ids, stretch)
    if not g.made:
        return none
    symbol, place = (np.concatenate(x) for x in zip(*g.made, strict=True))
    length = np.ones(g.next, np.int64)
    where = np.zeros(g.next, np.int64)
    for i, (a, b) in enumerate(zip(g.left, g.right, strict=True)):
        length[g.first + i] = length[a] + length[b]
    where[symbol] = place  # any place will do
    squares = Squares(ids)
    rows = []
    for i in np.flatnonzero(length[g.first :] >= LEAST).tolist():
        s, a, b = g.first + i, g.left[i], g.right[i]
        at, middle, n = int(where[s]), int(length[a]), int(length[s])
        left, right = squares.of(a, at, middle, True), squares.of(b, at + middle, n - middle, False)
        if left or right:
            rows += [(s, *r) for r in crossing(ids[at : at + n], middle, left, right)]
    if not rows:
        return none
    return joined(_placed(np.array(rows, np.int64), symbol, place))


def _placed(rows: np.ndarray, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Runs of symbols at all places of the symbols."""
    order = np.argsort(symbol, kind="stable")
    symbol, place = symbol[order], place[order]
    first, last = np.searchsorted(symbol, rows[:, 0]), np.searchsorted(symbol, rows[:, 0], "right")
    many = last - first
    at = place[np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    return np.stack([at + np.repeat(rows[:, 1], many), at + np.repeat(rows[:, 2], many), np.repeat(rows[:, 3], many)], axis=1)


def joined(found: np.ndarray) -> np.ndarray:
    """Intervals of one period that overlap by it or more, as one; of one interval's periods the smallest."""
    found = np.unique(found[:, [2, 0, 1]], axis=0)
    out: list[list[int]] = []
    for q, start, end in found.tolist():
        if out and out[-1][2] == q and start <= out[-1][1] - q:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, q])
    best: dict[tuple[int, int], int] = {}
    for start, end, q in out:
        best[start, end] = min(q, best.get((start, end), q))
    return np.array(sorted((start, end, q) for (start, end), q in best.items()), np.int64).reshape(-1, 3)


def _slice_rows(ids: pa.Array, raw: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    words = Words(raw, off)
    runs = find_runs(word_ids(words), words.doc) if len(words) else np.zeros((0, 3), np.int64)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept = np.cumsum(gone[:-1]) == 0
    doc_of = words.doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    data = raw.tobytes()
    texts, lists = [], []
    cuts = np.searchsorted(doc_of, np.arange(len(off)))
    for d in range(len(off) - 1):
        a, b = words.at[d], words.at[d + 1]
        own = np.flatnonzero(kept[a:b]) + a
        texts.append(b" ".join([data[x:y] for x, y in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)]).decode())
        lists.append([{"start": s - a, "length": e - s, "period": q} for s, e, q in runs[cuts[d] : cuts[d + 1]].tolist()])
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(words.at), pa.int64()), pa.array(lists, _RUNS), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without repeats:
    of each run the first period stays, kept words are joined by one space."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffers(b.column("text"))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
                yield _slice_rows(b.column("doc_id").slice(at, to - at).cast(pa.int64()), raw[off[at] : off[to]], off[at : to + 1] - off[at])
                at = to

    return docs.select("doc_id", "text").mapInArrow(task, RESULT)
