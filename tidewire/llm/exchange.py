"""Shuffling millions of small (owner, key) facts as packed binary rows.

A task packs what it found into one binary row per target bucket, so that Spark
moves a few large rows instead of one row per fact: 4 to 8 bytes a fact rather than
about 30.  Buckets are Spark partitions; there are as many as the session's shuffle
partitions, or more where the measured size of the texts asks for it.
Facts are combined inside a slice before they are sent: a key that many owners of a
slice share is sent once, so a key of a third of all rows stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "bucket int, kind int, owners binary, counts binary, keys binary"
ARROW_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
FACT, TOLD = 0, 1


#: a bucket holds about so many bytes of documents
BUCKET_BYTES = 64 << 20


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(docs: DataFrame, column: str = "text") -> int:
    """Buckets for a table: as many as shuffle partitions, and more where these would be over BUCKET_BYTES."""
    size = docs.agg(F.sum(F.octet_length(column).cast("bigint"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


P1, P2, SPREAD = 2147483647, 2147483629, 1640531527
#: groups that hold whole documents are this many times finer than shuffle partitions
FINER = 2


def owner_bucket(owner: np.ndarray, n: int) -> np.ndarray:
    """Bucket of an id; :func:`owner_bucket_column` gives the same in Spark."""
    return (np.mod(owner, P1) * SPREAD % P2 % n).astype(np.int32)


def owner_bucket_column(owner: Column, n: int) -> Column:
    return (F.pmod(owner.cast("bigint"), F.lit(P1).cast("bigint")) * F.lit(SPREAD).cast("bigint") % F.lit(P2).cast("bigint") % F.lit(n)).cast("int")


def pack(bucket: np.ndarray, kind: int, owner: np.ndarray, key: np.ndarray) -> pa.RecordBatch | None:
    """One row per bucket that has facts: distinct owners, facts per owner, keys."""
    if not len(owner):
        return None
    order = np.lexsort((key, owner, bucket))
    bucket, owner, key = bucket[order], owner[order], key[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(owner)]])
    rows: list[list] = [[], [], [], [], []]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        own = owner[a:b]
        change = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        rows[0].append(int(bucket[a]))
        rows[1].append(kind)
        rows[2].append(own[change].tobytes())
        rows[3].append(np.diff(np.append(change, b - a)).astype(np.uint32).tobytes())
        rows[4].append(key[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, ARROW_PACKED, strict=True)], schema=ARROW_PACKED)


def unpack(owners: list[bytes], counts: list[bytes], keys: list[bytes], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Owners (one per fact) and keys of packed rows."""
    own = np.frombuffer(b"".join(owners), np.int64)
    cnt = np.frombuffer(b"".join(counts), np.uint32)
    return np.repeat(own, cnt), np.frombuffer(b"".join(keys), dtype)


def distinct(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct facts sorted by (key, owner)."""
    order = np.lexsort((owner, key))
    owner, key = owner[order], key[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], key[keep]


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and size of each run of equal keys."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    return first, np.diff(np.append(first, len(key)))


def shared_facts(facts: DataFrame, n: int, dtype: str, respond: str = "all") -> DataFrame:
    """Tells owners which of their keys another owner has too.

    ``facts`` has :data:`PACKED` rows, ``FACT`` rows by bucket of the key and ``TOLD``
    rows that only pass through.  ``respond='all'`` answers every owner of a key that
    at least two owners have; ``'later'`` answers all but the smallest owner.
    The answer has ``TOLD`` rows, by one of ``n * FINER`` buckets of the owner.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[list, list, list] = ([], [], [])
        told: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            cols = [batch.column(c).to_pylist() for c in ("owners", "counts", "keys")]
            for i, kind in enumerate(kinds):
                for into, col in zip(got if kind == FACT else told, cols, strict=True):
                    into.append(col[i])
        owner, key = distinct(*unpack(*got, dtype))
        first, size = groups(key)
        many = np.repeat(size > 1, size)
        if respond == "later":
            many[first] = False
        known, known_key = unpack(*told, dtype)
        owner, key = np.concatenate([known, owner[many]]), np.concatenate([known_key, key[many]])
        out = pack(owner_bucket(owner, n * FINER), TOLD, owner, key)
        if out is not None:
            yield out

    return facts.repartitionById(n, "bucket").mapInArrow(answer, PACKED)


def combine(owner: np.ndarray, key: np.ndarray, keep_rest: str = "all") -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Splits a slice's facts into those to send (one owner for each key, the smallest)
    and those already known to be shared.  With ``'all'`` the known ones include the
    smallest owner; with ``'later'`` they don't."""
    owner, key = distinct(owner, key)
    first, size = groups(key)
    many = np.repeat(size > 1, size)
    if keep_rest == "later":
        many[first] = False
    return (owner[first], key[first]), (owner[many], key[many])


def scan(docs: DataFrame, facts: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(facts, PACKED)
