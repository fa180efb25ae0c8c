"""Benchmark decontamination by spaced seeds.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]`` after ASCII letters are
lowered and ASCII punctuation is taken as space.  A document overlaps an item when some
``WINDOW`` consecutive words of each, aligned word by word, agree at ``WINDOW - ALLOWED``
places or more.  A shorter item must occur whole; one of six words or more may differ in one
word, one of fewer in none.  Items of fewer than ``shortest`` words (a parameter, 1 unless
given) are not searched.

1. *Seeds.*  Three masks, each of 6 words in a span of 9, ignore the other positions; every
   way to substitute two of twelve words leaves one of the masks untouched at some offset (a
   test tries all), so no overlap is missed.  Items of 6 to 11 words have two seeds, their
   halves, of which one substitution leaves one; shorter items are their own seed.  Spark
   tasks make the seeds of the benchmark, each with the windows that hold it; equal windows of
   several items stand once, and which items have a window is a table of its own.
2. *Join.*  Seeds of the documents that a bitmap of the benchmark's seeds lets pass (at most
   2**MOST_BITS bits, broadcast; where it is full more pass, none is lost) are joined with the
   benchmark's on the seed, each with the words around it.  Spark sends the benchmark's to all
   tasks below its own broadcast threshold and splits frequent seeds (a one-word item, say) as
   skewed partitions beyond it.
3. *Verification.*  Each pair is compared word by word (64-bit hashes of words); windows
   found by several seeds count once.
4. *Items.*  The windows of a document, counted, are joined with the items that have them.

A result row is a document and an item; a window that several items have counts for each, and
one that an item has twice counts twice.  Null or empty texts and items overlap with nothing.  A null item id is an item like
any other and sorts first; rows with a null document id give one row with a null id.
Repeated rows count as one.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import GRAM_BASE, LOWER, NO_ID, SPACE, Words, handing_back, mix, slices
from tidewire.operators.graph import written

WINDOW, ALLOWED, SHORTEST = 12, 2, 1
MASKS = ((0, 3, 4, 6, 7, 8), (0, 1, 2, 6, 7, 8), (0, 2, 3, 4, 5, 7))
SPAN = 9
#: the bitmap has about so many bits a seed, and never more than 2**MOST_BITS
BITS_A_SEED, MOST_BITS = 64, 26
PLAIN = LOWER.copy()
PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
SEEDS = "seed bigint, kind int, shift int, window binary, item_id bigint, first bigint"
HITS = "seed bigint, doc_id bigint, at bigint, around binary"
assert SPACE[32]


def kind_of(size: int) -> list[tuple[int, int, tuple[int, ...], int]]:
    """(kind, words before the seed, mask, words of the surroundings) of the seeds of an item of so many words."""
    if size >= WINDOW:
        return [(k, WINDOW - SPAN, mask, 2 * WINDOW - SPAN) for k, mask in enumerate(MASKS)]
    if size < 6:
        return [(100 + size, 0, tuple(range(size)), size)]
    half = size // 2
    return [(200 + size, 0, tuple(range(half)), size), (300 + size, half, tuple(range(size - half)), size)]


def needed(size: int) -> int:
    """Words that must agree in a window of so many."""
    return size - (ALLOWED if size >= WINDOW else size // 6)


def _seeds(h: np.ndarray, kind: int, mask: tuple[int, ...]) -> np.ndarray:
    n = max(0, len(h) - max(mask))
    g = np.full(n, kind + 1, np.uint64)
    for p in mask:
        g *= np.uint64(GRAM_BASE)
        g += h[p : p + n]
    return mix(g)


def _around(h: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, before: int, size: int) -> np.ndarray:
    """Hashes of ``size`` words from ``before`` words ahead of each position; 0 outside its text."""
    place = (at - before)[:, None] + np.arange(size)
    inside = (place >= begin[:, None]) & (place < end[:, None])
    return np.where(inside, h[np.clip(place, 0, max(len(h) - 1, 0))], np.uint64(0))


def item_seeds(benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(seed, kind, shift, window, item_id, first): seeds of all items, each with the windows that hold it.

    A window has a row for each seed, shift and place in an item.
    """

    @handing_back
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, off in slices(batches, "item_id"):
            w = Words(PLAIN[raw], off)
            h = np.maximum(w.hash, np.uint64(1))
            size = np.diff(w.at)
            for kind, before, mask, around in {k for n in np.unique(size[size >= max(shortest, 1)]).tolist() for k in kind_of(n)}:
                g = _seeds(h, kind, mask)
                at = np.arange(len(g))
                own = w.doc[at]
                fit = (w.doc[at + max(mask)] == own) & (size[own] >= WINDOW if kind < 100 else size[own] == around)
                if kind >= 100:
                    fit &= at - w.at[own] == before  # a short item is its only window
                at, own = at[fit], own[fit]
                if not len(at):
                    continue
                words = _around(h, at, w.at[own], w.at[own + 1], before, around)
                span = min(WINDOW, around)
                for shift in range(around - span + 1):
                    window = np.ascontiguousarray(words[:, shift : shift + span])
                    ok = (window != 0).all(axis=1)
                    n = int(ok.sum())
                    cols = [g[at[ok]].view(np.int64), np.full(n, kind, np.int32), np.full(n, shift, np.int32), pa.array([x.tobytes() for x in window[ok]], pa.binary()), ids[own[ok]], at[ok] - w.at[own[ok]] - before + shift]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=["seed", "kind", "shift", "window", "item_id", "first"])

    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(seeds, SEEDS).distinct()


def _bitmap(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the seeds' leading bits, and how many bits these are; gathered as 64-bit words, at most 2**(MOST_BITS - 6)."""
    n = seeds.select("seed").distinct().count()
    bits = min(MOST_BITS, max(12, int(np.ceil(np.log2(max(1, n) * BITS_A_SEED)))))
    lead = seeds.select(F.shiftrightunsigned("seed", 64 - bits).alias("lead"))
    got = lead.selectExpr("lead DIV 64 AS w", "shiftleft(1L, CAST(lead % 64 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool), bits


def window_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, window, n, first_word, last_word, most_equal): the windows of ``items``, the rows of
    :func:`item_seeds`, that each document has, at how many places."""
    sc = docs.sparkSession.sparkContext
    seeds = written(items.select("seed", "kind", "shift", "window").distinct())
    kinds = {r.kind: r.n for r in seeds.groupBy("kind").agg(F.max(F.octet_length("window") / 8).cast("int").alias("n")).collect()}  # at most 20 kinds
    wanted = sorted({k for n in kinds.values() for k in kind_of(n) if k[0] in kinds})
    known = sc.broadcast(_bitmap(seeds) if wanted else (np.zeros(1 << 12, bool), 12))

    @handing_back
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = known.value
        for ids, raw, off in slices(batches):
            w = Words(PLAIN[raw], off)
            h = np.maximum(w.hash, np.uint64(1))
            for kind, before, mask, around in wanted:
                g = _seeds(h, kind, mask)
                at = np.flatnonzero(bitmap[(g >> np.uint64(64 - bits)).astype(np.int64)]) if len(g) else np.zeros(0, np.int64)
                own = w.doc[at]
                same = w.doc[at + max(mask)] == own
                at, own = at[same], own[same]
                if len(at):
                    words = _around(h, at, w.at[own], w.at[own + 1], before, around)
                    yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(ids[own]), pa.array(at - w.at[own] - before), pa.array([x.tobytes() for x in words], pa.binary())], names=["seed", "doc_id", "at", "around"])

    @handing_back
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            around, window = (batch.column(c).to_pylist() for c in ("around", "window"))
            shift = batch.column("shift").to_numpy()
            equal = np.zeros(batch.num_rows, np.int32)
            least = np.array([needed(len(x) // 8) for x in window], np.int32)
            lengths = np.array([len(x) for x in window])
            for n in np.unique(lengths).tolist():
                pick = np.flatnonzero(lengths == n)
                mine = b"".join(around[i][8 * s : 8 * s + n] for i, s in zip(pick.tolist(), shift[pick].tolist(), strict=True))
                theirs = b"".join(window[i] for i in pick.tolist())
                a, b = (np.frombuffer(x, np.uint64).reshape(len(pick), -1) for x in (mine, theirs))
                equal[pick] = np.where((a != 0).all(axis=1), (a == b).sum(axis=1), 0)
            good = np.flatnonzero(equal >= least)
            kept = batch.take(pa.array(good))
            start = kept.column("at").to_numpy() + shift[good]
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("window"), pa.array(start), pa.array(equal[good])], names=["doc_id", "window", "start", "equal"])

    hits = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, HITS)
    pairs = hits.join(seeds.drop("kind"), "seed").select("doc_id", "at", "around", "shift", "window")
    found = pairs.mapInArrow(verify, "doc_id bigint, window binary, start bigint, equal int")
    once = found.groupBy("doc_id", "window", "start").agg(F.max("equal").alias("equal"))
    last = F.col("start") + F.octet_length("window") / 8
    return once.groupBy("doc_id", "window").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_word"), F.max(last.cast("bigint")).alias("last_word"), F.max("equal").alias("most_equal"))


def overlaps(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word, most_equal) of each overlapping document and item."""
    items = written(item_seeds(benchmark, shortest))
    owners = items.select("window", "item_id", "first").distinct().groupBy("window", "item_id").agg(F.count(F.lit(1)).alias("times"))
    out = window_hits(docs, items).join(owners, "window").groupBy("doc_id", "item_id").agg(
        F.sum(F.col("n") * F.col("times")).alias("n_windows"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("most_equal").alias("most_equal")
    )
    return out.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("doc_id", "item_id")})


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with their columns.

    Rows are told apart by a hash of id and text, so a row with a null or a repeated id is
    judged by its own text.  The keys of what goes are a table of their own, so the documents
    move only where it is too large for Spark to broadcast.
    """
    key = lambda: F.xxhash64("doc_id", "text")
    hits = window_hits(docs.select(key().alias("doc_id"), "text"), written(item_seeds(benchmark, shortest)))
    leaks = written(hits.select(F.col("doc_id").alias("_key")).distinct())
    return docs.withColumn("_key", key()).join(leaks, "_key", "left_anti").select(*docs.columns)
