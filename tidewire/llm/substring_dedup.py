"""Removal of repeated word windows by difference-cover anchors.

A window is ``window`` consecutive words of one document.  A window is removed when
its word sequence also starts in a document with a smaller id.

1. *Anchors.*  Positions ``p`` with ``p mod 7`` in the difference cover {0, 1, 3} are
   kept: every shift between two occurrences is a difference of two members, so any two
   occurrences of the same ``window`` words hold, within the first 7 positions, one
   position that is a cover position in both.  The ``window - 6`` words from there are
   the anchor; both occurrences hold the same one.  Only these hashes are shuffled
   (3/7 of all positions, 4 bytes each).
2. *Extension.*  Documents are told which of their anchors another document has; each
   such anchor is extended to the windows that hold it, and only those windows are
   compared, by 64-bit hash, against the smallest document that has them.
3. Documents are told which windows to remove.

Null or empty text has no words.  Rows that repeat a ``doc_id`` count as one document
for "smaller id" and each gives one result row; a null id stays null and counts as smaller
than all others.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import exchange as X
from tidewire.llm.words import NO_ID, Words, slices

PERIOD, COVER = 7, (0, 1, 3)
OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the anchors of a slice."""
    g, ok = w.grams(window - PERIOD + 1)
    at = np.flatnonzero(ok)
    within = at - w.at[w.doc[at]]
    at = at[np.isin(within % PERIOD, COVER)]
    return at, g[at]


def _per_owner(table: pa.Table, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    cols = [table.column(c).to_pylist() for c in ("owners", "counts", "keys")]
    owner, key = X.unpack(*cols, dtype)
    order = np.lexsort((key, owner))
    return owner[order], key[order]


def _told(ids: np.ndarray, doc: np.ndarray, key: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which (document, key) of a slice are among the told (owner, key) facts."""
    hit = np.zeros(len(key), bool)
    lo, hi = np.searchsorted(owner, ids, "left"), np.searchsorted(owner, ids, "right")
    first, size = X.groups(doc)
    for a, m in zip(first.tolist(), size.tolist(), strict=True):
        d = doc[a]
        if lo[d] < hi[d]:
            mine = keys[lo[d] : hi[d]]
            k = key[a : a + m]
            at = np.minimum(np.searchsorted(mine, k), len(mine) - 1)
            hit[a : a + m] = mine[at] == k
    return hit


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and the kept text."""
    if window < PERIOD:
        raise ValueError(f"a window needs at least {PERIOD} words")
    n = X.buckets(docs)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, off in slices(batches):
            w = Words(raw, off)
            at, key = _anchors(w, window)
            (owner, k), (shared, sk) = X.combine(ids[w.doc[at]], key)
            bucket = (k % np.uint64(n)).astype(np.int32)
            for out in (
                X.pack(bucket, X.FACT, owner, (k >> np.uint64(32)).astype(np.uint32)),
                X.pack(X.owner_bucket(shared, n * X.FINER), X.TOLD, shared, (sk >> np.uint64(32)).astype(np.uint32)),
            ):
                if out is not None:
                    yield out

    def windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        owner, keys = _per_owner(right, "uint32")
        out = []
        if len(owner):
            for ids, raw, off in slices(left.select(["doc_id", "text"]).to_batches()):
                w = Words(raw, off)
                at, h = _anchors(w, window)
                hit = at[_told(ids, w.doc[at], (h >> np.uint64(32)).astype(np.uint32), owner, keys)]
                if not len(hit):
                    continue
                g, ok = w.grams(window)
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, np.maximum(hit - (PERIOD - 1), 0), 1)
                np.add.at(edge, hit + 1, -1)
                cand = np.flatnonzero((np.cumsum(edge)[: len(g)] > 0) & ok)
                (own, k), (later, lk) = X.combine(ids[w.doc[cand]], g[cand], "later")
                out += [
                    X.pack((k % np.uint64(n)).astype(np.int32), X.FACT, own, k),
                    X.pack(X.owner_bucket(later, n * X.FINER), X.TOLD, later, lk),
                ]
        return pa.Table.from_batches([b for b in out if b is not None], X.ARROW_PACKED)

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        owner, keys = _per_owner(right, "uint64")
        cols: tuple[list, ...] = ([], [], [], [], [])
        for ids, raw, off in slices(left.select(["doc_id", "text"]).to_batches()):
            gone = None
            lo, hi = np.searchsorted(owner, ids, "left"), np.searchsorted(owner, ids, "right")
            if (lo < hi).any():
                w = Words(raw, off)
                g, ok = w.grams(window)
                at = np.flatnonzero(ok)
                at = at[_told(ids, w.doc[at], g[at], owner, keys)]
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[: len(w)] > 0
            data, o = raw.tobytes(), off.tolist()
            for d, i in enumerate(ids.tolist()):
                ws = data[o[d] : o[d + 1]].split()
                kept = ws
                if gone is not None and lo[d] < hi[d]:
                    mask = gone[w.at[d] : w.at[d + 1]]
                    kept = [x for x, m in zip(ws, mask.tolist(), strict=True) if not m]
                text = b" ".join(kept)
                for c, v in zip(cols, (i, len(ws), len(ws) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace")), strict=True):
                    c.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    told = X.shared_facts(X.scan(docs, anchors), n, "uint32")
    by_doc = docs.withColumn("bucket", X.owner_bucket_column(F.col("doc_id"), n * X.FINER)).groupBy("bucket")
    spread = by_doc.cogroup(told.groupBy("bucket")).applyInArrow(windows, X.PACKED)
    gone = X.shared_facts(spread, n, "uint64", "later")
    return by_doc.cogroup(gone.groupBy("bucket")).applyInArrow(remove, OUT).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
