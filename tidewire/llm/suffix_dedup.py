"""Removal of repeated byte strings by enhanced suffix arrays and their interval trees.

A byte is removed when a ``length``-byte string that covers it also starts in a document
with a smaller id.  Strings never cross documents; overlaps count.

A suffix array over all bytes of a corpus would move every byte many times, so suffixes
are taken at *anchors* only: positions whose 16-byte hash is the smallest among the 16-byte strings of
some ``length`` consecutive bytes.  Whether a position is an anchor depends on these bytes
alone, so two occurrences of the same string hold the same anchor at the same offset.

1. Anchors are exchanged as packed facts; documents learn which also occur in another.
2. For those, the suffix from the anchor (``length`` bytes) and the bytes to its left are
   sent to the partition of the anchor's hash, which holds all suffixes that start alike.
   Equal suffixes with equal left sides are combined in each slice of documents: the smallest
   document's is sent, and what the others repeat is known at once.
3. Each partition sorts its suffixes, takes the common prefix of neighbours (the enhanced
   suffix array) and builds the tree of common-prefix intervals with one stack scan.  An
   interval of depth d holds *all* occurrences of its d-byte prefix, not just neighbours.
   Its occurrences are split by their left extensions; where these are diverse the groups
   part, and each group is one repeat of ``length`` bytes with all its occurrences.  Every occurrence
   but those of the group's smallest document is marked.
4. Documents receive the marks and drop the covered bytes.

Null or empty text has no bytes.  Rows that repeat a ``doc_id`` count as one document for
"smaller id"; each gives one row; a null id stays null and counts as smaller than all others.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import exchange as X
from tidewire.llm.words import BASE, BASE_INVERSE, NO_ID, mix, powers, slices

LENGTH, SEED = 50, 16
SUFFIXES = f"{X.PACKED}, suffixes binary"
OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def _sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f over each ``width`` consecutive values (f is minimum or maximum), by doubling."""
    have, size = x, 1
    while size * 2 <= width:
        have = f(have[:-size], have[size:])
        size *= 2
    rest = width - size
    return f(have[: len(have) - rest], have[rest:]) if rest else have


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions, rows and 64-bit hashes of the anchors of a slice.

    A few positions beside row ends may be anchors of strings that cross rows; they do no harm.
    """
    n, width = len(raw), length - SEED + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(raw.astype(np.uint64) + np.uint64(1), powers(BASE, n), out=sums[1:])
    np.cumsum(sums, out=sums)
    h = mix((sums[SEED:] - sums[:-SEED]) * powers(BASE_INVERSE, n + 1)[: n - SEED + 1])
    top = (h >> np.uint64(32)).astype(np.uint32)
    low = _sliding(np.minimum, top, width)
    edge = np.zeros(width - 1, np.uint32)
    most = _sliding(np.maximum, np.concatenate([edge, low, edge]), width)
    at = np.flatnonzero(top == most)
    row = np.searchsorted(off, at, "right") - 1
    keep = (at + SEED <= off[row + 1]) & (off[row + 1] - off[row] >= length)
    return at[keep], row[keep], h[at[keep]]


def suffix_order(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of suffixes by their bytes, then by the bytes to their left."""
    words = [np.ascontiguousarray(m[:, k : k + 8]).view(">u8").ravel() for m in (right, left) for k in range(0, m.shape[1], 8)]
    return np.lexsort(words[::-1])


def common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before (0 for the first), within their sizes."""
    if not len(rows):
        return np.zeros(0, np.int64)
    differs = rows[1:] != rows[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], np.minimum(first, np.minimum(size[1:], size[:-1]))])


def intervals(lcp: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(depth, first, last, depth of parent) of the common-prefix intervals, by one stack scan."""
    found: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for at, depth in enumerate([*lcp.tolist()[1:], 0]):
        first = at
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            found.append((d, first, at, max(depth, stack[-1][0] if stack else 0)))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return found


def marks(owner: np.ndarray, right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, length: int) -> np.ndarray:
    """For each suffix a bit for each s: the string of ``length`` bytes that starts s bytes
    before it also occurs in a document with a smaller id."""
    n = len(owner)
    order = suffix_order(right, left)
    found = np.zeros(n, np.uint64)
    tree = np.array(intervals(common(right[order], right_size[order])), np.int64).reshape(-1, 4)
    # left extensions: their order and the common part of neighbours
    by_left = np.lexsort([np.ascontiguousarray(left[:, k : k + 8]).view(">u8").ravel() for k in range(0, left.shape[1], 8)][::-1])
    left_common = common(left[by_left], left_size[by_left])
    for s in range(length - SEED + 1):
        depth = length - s
        level = tree[(tree[:, 0] >= depth) & (tree[:, 3] < depth)]  # the intervals that hold all of each depth-byte prefix
        if not len(level):
            continue
        size = level[:, 2] - level[:, 1] + 1
        ends = np.cumsum(size)
        member = order[np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(level[:, 1], size)]
        node = np.repeat(np.arange(len(level)), size)
        extension = np.empty(n, np.int64)
        extension[by_left] = np.cumsum(left_common < s)
        whole = left_size[member] >= s
        member, node = member[whole], node[whole]
        side = extension[member]
        at = np.lexsort((owner[member], side, node))
        member, node, side = member[at], node[at], side[at]
        if not len(member):
            continue
        first, count = X.groups(node * (n + 2) + side)
        smallest = np.repeat(owner[member[first]], count)
        found[member[owner[member] > smallest]] |= np.uint64(1 << s)
    return found


def _record(length: int) -> np.dtype:
    return np.dtype([("owner", "<i8"), ("at", "<i8"), ("rs", "u1"), ("ls", "u1"), ("right", "u1", (length,)), ("left", "u1", (length - SEED,))])


def _shrink(rec: np.ndarray) -> bytes:
    """Suffix records field by field, compressed: they are mostly text, all over the bucket's documents."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(rec[f]).tobytes() for f in rec.dtype.names))


def _grow(data: bytes, record: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    rec = np.empty(len(raw) // record.itemsize, record)
    at = 0
    for f in record.names:
        kind = record[f]
        rec[f] = np.frombuffer(raw, kind.base, len(rec) * int(np.prod(kind.shape)), at).reshape(len(rec), *kind.shape)
        at += len(rec) * kind.itemsize
    return rec


def _fits(rs: np.ndarray, ls: np.ndarray, length: int) -> np.ndarray:
    """For each suffix a bit for each s whose string of ``length`` bytes is all inside its sides."""
    span = np.arange(length - SEED + 1)
    return ((span <= ls[:, None]) & (length - span <= rs[:, None])).astype(np.uint64) @ (np.uint64(1) << span.astype(np.uint64))


def _combined(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each record has the smallest document of those with equal bytes, and whether it has a larger one."""
    content = np.empty(len(rec), [(f, rec.dtype[f]) for f in ("rs", "ls", "right", "left")])
    for f in content.dtype.names:
        content[f] = rec[f]
    _, kind = np.unique(content.view(np.dtype((np.void, content.dtype.itemsize))), return_inverse=True)
    least = np.full(kind.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, rec["owner"])
    later = rec["owner"] > least[kind]
    return ~later, later


def _wide(m: np.ndarray) -> np.ndarray:
    """Columns padded to whole 8-byte words."""
    return np.pad(m, ((0, 0), (0, -m.shape[1] % 8)))


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept text."""
    if not SEED < length <= SEED + 34:
        raise ValueError(f"length must be from {SEED + 1} to {SEED + 34}")
    n = X.buckets(docs)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    record, back = _record(length), length - SEED
    short = lambda h: (h >> np.uint64(8)).astype(np.uint32)  # noqa: E731  top bits of the smallest hashes are alike
    bucket = lambda h: (mix(h) % np.uint64(n)).astype(np.int32)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, off in slices(batches):
            at, row, h = anchors(raw, off, length)
            (own, k), (known, kk) = X.combine(ids[row], h)
            for out in (X.pack(bucket(k), X.FACT, own, short(k)), X.pack(X.owner_bucket(known, n * X.FINER), X.TOLD, known, short(kk))):
                if out is not None:
                    yield out

    def suffixes(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        owner, keys = X.unpack(*(right.column(c).to_pylist() for c in ("owners", "counts", "keys")), "uint32")
        told = np.unique(X.owner_bucket(owner, 1 << 31).astype(np.uint64) << np.uint64(32) | keys) if len(owner) else np.zeros(0, np.uint64)
        rows: list[tuple] = []
        for ids, raw, off in slices(left.select(["doc_id", "text"]).to_batches()) if len(told) else ():
            p, r, h = anchors(raw, off, length)
            want = X.owner_bucket(ids[r], 1 << 31).astype(np.uint64) << np.uint64(32) | short(h)
            hit = told[np.minimum(np.searchsorted(told, want), len(told) - 1)] == want
            p, r, h = p[hit], r[hit], h[hit]
            padded = np.concatenate([np.zeros(back, np.uint8), raw, np.zeros(length, np.uint8)])
            rec = np.zeros(len(p), record)
            rec["owner"], rec["at"] = ids[r], p - off[r]
            rec["rs"], rec["ls"] = np.minimum(off[r + 1] - p, length), np.minimum(p - off[r], back)
            rec["right"] = padded[(p + back)[:, None] + np.arange(length)] * (np.arange(length) < rec["rs"][:, None])
            rec["left"] = padded[(p + back - 1)[:, None] - np.arange(back)] * (np.arange(back) < rec["ls"][:, None])
            sent, known = _combined(rec)
            bits = _fits(rec["rs"][known].astype(np.int64), rec["ls"][known].astype(np.int64), length)
            own, key = rec["owner"][known], rec["at"][known].astype(np.uint64) << np.uint64(back + 1) | bits
            packed = X.pack(X.owner_bucket(own[bits > 0], n * X.FINER), X.TOLD, own[bits > 0], key[bits > 0])
            rows += [(*x.values(), None) for x in packed.to_pylist()] if packed is not None else []
            rec, b = rec[sent], bucket(h[sent])
            order = np.argsort(b, kind="stable")
            rec, b = rec[order], b[order]
            rows += [(int(b[a]), X.FACT, None, None, None, _shrink(rec[a : a + m])) for a, m in zip(*(x.tolist() for x in X.groups(b)), strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "kind", "owners", "counts", "keys", "suffixes"])

    def scan_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            known = batch.filter(pc.equal(batch.column("kind"), X.TOLD))
            if known.num_rows:
                yield known.select(X.ARROW_PACKED.names)
            got += batch.column("suffixes").drop_null().to_pylist()
        rec = np.concatenate([_grow(x, record) for x in got]) if got else np.zeros(0, record)
        del got
        if not len(rec):
            return
        # equal suffixes with equal left sides are one entry, with the smallest of their documents
        content = np.ascontiguousarray(rec[["rs", "ls", "right", "left"]]).copy()
        packed = np.empty(len(rec), [("rs", "u1"), ("ls", "u1"), ("right", "u1", (length,)), ("left", "u1", (back,))])
        for f in packed.dtype.names:
            packed[f] = content[f]
        whole = packed.view(np.dtype((np.void, packed.dtype.itemsize)))
        grid = _wide(whole.view(np.uint8).reshape(len(rec), -1))
        words = [np.ascontiguousarray(grid[:, k : k + 8]).view(">u8").ravel() for k in range(0, grid.shape[1], 8)]
        order = np.lexsort([rec["owner"], *words[::-1]])
        new = np.ones(len(rec), bool)
        new[1:] = (grid[order[1:]] != grid[order[:-1]]).any(axis=1)
        entry = np.empty(len(rec), np.int64)
        entry[order] = np.cumsum(new) - 1
        head = order[new]
        rs, ls = rec["rs"][head].astype(np.int64), rec["ls"][head].astype(np.int64)
        bits = marks(rec["owner"][head], _wide(rec["right"][head]), rs, _wide(rec["left"][head]), ls, length)[entry]
        # a document after the first with the same bytes around repeats every string that fits
        fits = _fits(rs, ls, length)
        later = rec["owner"] > rec["owner"][head][entry]
        bits[later] |= fits[entry[later]]
        hit = np.flatnonzero(bits)
        out = X.pack(X.owner_bucket(rec["owner"][hit], n * X.FINER), X.TOLD, rec["owner"][hit], rec["at"][hit].astype(np.uint64) << np.uint64(back + 1) | bits[hit])
        if out is not None:
            yield out

    def remove(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        owner, keys = X.unpack(*(right.column(c).to_pylist() for c in ("owners", "counts", "keys")), "uint64")
        order = np.argsort(owner, kind="stable")
        owner, keys = owner[order], keys[order]
        at, bits = (keys >> np.uint64(back + 1)).astype(np.int64), keys
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for ids, raw, off in slices(left.select(["doc_id", "text"]).to_batches()):
            lo, hi = np.searchsorted(owner, ids, "left"), np.searchsorted(owner, ids, "right")
            for d, i in enumerate(ids.tolist()):
                data = raw[off[d] : off[d + 1]]
                n_all, spans = len(data), 0
                if lo[d] < hi[d]:
                    p, m = at[lo[d] : hi[d]], bits[lo[d] : hi[d]]
                    edge = np.zeros(n_all + 1, np.int64)
                    for s in range(back + 1):
                        start = p[(m >> np.uint64(s)) & np.uint64(1) > 0] - s
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + length, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    data = data[~gone]
                kept = data.tobytes()
                for c, v in zip(cols, (i, n_all, n_all - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")), strict=True):
                    c.append(v)
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    told = X.shared_facts(X.scan(docs, facts), n, "uint32")
    by_doc = docs.withColumn("bucket", X.owner_bucket_column(F.col("doc_id"), n * X.FINER)).groupBy("bucket")
    spread = by_doc.cogroup(told.groupBy("bucket")).applyInArrow(suffixes, SUFFIXES)
    marked = spread.repartitionById(n, "bucket").mapInArrow(scan_trees, X.PACKED)
    return by_doc.cogroup(marked.groupBy("bucket")).applyInArrow(remove, OUT).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
