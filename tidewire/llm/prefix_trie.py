"""Prefix trie of conversations by truncation peeling.

A conversation is its sequence of turns (role, text).  Each distinct sequence of the first d
turns of one or more conversations is a node of depth d; the root has no turn.

1. Every turn becomes a 32-byte digest of (role, text); a conversation's *path* is the
   digests of its turns in a row, so the paths of a node's members share their first 32 d
   bytes.  Equal paths become one row with their count and smallest id.
2. Paths are dealt out by range.  Each task peels its own: from the greatest depth down, the
   nodes that are left from the level below meet the paths that end here, the last turn is
   stripped and what is left is grouped again, with all aggregates summed on the way.
   A node is the SHA-256 of its path.
3. Only nodes on the first or last path of a task can go on in another task.  These *open*
   nodes, at most two a level and task, are added up by node; those that several tasks have
   are peeled the same way by Spark, one round a level, as deep as two tasks share a path.

A frequent first turn, or a sequence that any number of conversations share, is thus spread
over tasks.  Only a single conversation's digests (32 bytes a turn) are ever held together.

Turns are ordered by ``turn`` (null first), then role and text; a null role or text is empty.
Repeated rows are turns of their own.  Rows with a null ``conv_id`` belong to no conversation and
are left out.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.components import use_checkpoints, written
from tidewire.llm.exchange import partitions

WORD = r"[^\x20\x09-\x0D]+"
#: bytes of a turn's digest
TURN = 32
#: a task peels paths of about so many bytes
TASK_BYTES = 16 << 20
#: ids of one node are joined to text in chunks of 2 ** CHUNK_BITS consecutive ids
CHUNK_BITS = 12
ROOT = hashlib.sha256(b"").digest()

_FIELDS = [("node", "binary"), ("parent", "binary"), ("depth", "bigint"), ("conv_id", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"),
           ("open", "boolean"), ("words", "bigint"), ("own_children", "bigint"), ("own_leaves", "bigint"), ("own_saved", "bigint")]
PEELED = ", ".join(f"{name} {kind}" for name, kind in _FIELDS)
_ARROW = pa.schema([(name, {"binary": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind]) for name, kind in _FIELDS])


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words) of each turn: its place from 1, and its words in number."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).alias("words"))


def paths(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, path, words) of each conversation of digested rows; ``conversations`` names further
    ones, which may have no turn."""
    turn = F.struct("pos", "digest", "words")
    each = rows.select("conv_id", turn.alias("turn"))
    if conversations is not None:
        each = each.unionByName(conversations.select("conv_id", F.lit(None).cast(each.schema["turn"].dataType).alias("turn")))
    convs = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return convs.select("conv_id", path.alias("path"), F.col("turns.words").alias("words"))


def _node(path: Column) -> Column:
    return F.unhex(F.sha2(path, 256))


class _Node:
    """What a task knows of a node; ``own_*`` leave out the children that are open."""

    __slots__ = ("children", "conv", "count", "leaves", "own_children", "own_leaves", "own_saved", "path", "saved")

    def __init__(self, path: int) -> None:
        self.path, self.conv, self.count = path, None, 0
        self.children = self.leaves = self.saved = self.own_children = self.own_leaves = self.own_saved = 0

    def add(self, conv: int, count: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.count += count


def _chain(path: bytes) -> list[bytes]:
    """The nodes of a path, root first."""
    state, out = hashlib.sha256(), [ROOT]
    for at in range(0, len(path), TURN):
        state.update(path[at : at + TURN])
        out.append(state.copy().digest())
    return out


def _level(level: dict[bytes, _Node], depth: int, words: list, chains: list, ends: set[bytes]) -> tuple[list[tuple], dict[bytes, _Node]]:
    """Closes the nodes of a depth: their rows (without the parent's conv_id), and the level above."""
    out, above = [], {}
    for key, n in level.items():
        last = words[n.path][depth - 1] if depth else 0
        leaves, saved = n.leaves if n.children else 1, n.saved + (n.count - 1) * last
        parent = chains[n.path][depth - 1] if depth else None
        is_open = key in ends
        out.append((key, parent, depth, n.conv, n.count, n.children, leaves, saved, is_open, last, n.own_children, n.own_leaves, n.own_saved))
        if depth:
            up = above.setdefault(parent, _Node(n.path))
            up.add(n.conv, n.count)
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            if not is_open:
                up.own_children, up.own_leaves, up.own_saved = up.own_children + 1, up.own_leaves + leaves, up.own_saved + saved
    return out, above


def peel(rows: list[tuple[bytes, int, int, list[int]]]) -> Iterator[list[tuple]]:
    """Rows of ``PEELED``, a level at a time, of distinct paths (path, count, smallest id, words)."""
    chains = [_chain(path) for path, *_ in rows]
    words = [w for *_, w in rows]
    by_depth = defaultdict(list)
    for i, chain in enumerate(chains):
        by_depth[len(chain) - 1].append(i)
    order = range(len(rows))
    ends = {key for i in (min(order, key=lambda i: rows[i][0]), max(order, key=lambda i: rows[i][0])) for key in chains[i]}
    level: dict[bytes, _Node] = {}
    below: list[tuple] = []
    for depth in range(max(by_depth), -1, -1):
        for i in by_depth.get(depth, ()):
            level.setdefault(chains[i][depth], _Node(i)).add(rows[i][2], rows[i][1])
        conv_of = {key: n.conv for key, n in level.items()}
        # the parents of the level below are complete now; one that is open gets its conv_id later
        yield [(*r[:4], None if r[1] in ends else conv_of[r[1]], *r[4:]) for r in below]
        below, level = _level(level, depth, words, chains, ends)
    yield [(*r[:4], None, *r[4:]) for r in below]


def _peel_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for b in batches:
        rows += zip(*(b.column(c).to_pylist() for c in ("path", "n", "conv_id", "words")), strict=True)
    if rows:
        for level in peel(rows):
            for at in range(0, len(level), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*level[at : at + 50_000], strict=True), _ARROW, strict=True)], schema=_ARROW)


def _peel_shared(shared: DataFrame, alone: DataFrame) -> DataFrame:
    """Peels the nodes that several tasks have, from their greatest depth down; ``alone`` are open nodes of one task."""
    spark = shared.sparkSession
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/levels-{uuid.uuid4()}"
    told = ["parent", "n_leaves", "saved_tokens"]
    deepest = shared.agg(F.max("depth")).first()[0]
    above = None
    for depth in range(deepest, -1, -1):
        under = alone.filter(F.col("depth") == depth + 1).select(*told)
        under = under if above is None else under.unionByName(above.select(*told))
        sums = under.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        rows = shared.filter(F.col("depth") == depth).join(sums, "node", "left").fillna(0, ["c", "l", "s"])
        children = F.col("own_children") + F.col("c")
        rows = rows.select(
            "node", "parent", "depth", "conv_id", "n_convs", children.alias("n_children"), F.when(children == 0, 1).otherwise(F.col("own_leaves") + F.col("l")).alias("n_leaves"),
            (F.col("own_saved") + F.col("s") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        )
        rows.write.parquet(f"{folder}/{depth}")
        above = spark.read.schema(rows.schema).parquet(f"{folder}/{depth}")
    return spark.read.schema(above.schema).parquet(*(f"{folder}/{depth}" for depth in range(deepest + 1)))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of (conv_id, path, words) rows: node, depth, conv_id (smallest member), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (words of shared turns, counted once less than they occur)."""
    spark = conversations.sparkSession
    use_checkpoints(spark)
    distinct = written(conversations.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words")))
    size = distinct.agg(F.sum(F.octet_length("path").cast("bigint"))).first()[0] or 0
    peeled = written(distinct.repartitionByRange(max(partitions(spark), -(-size // TASK_BYTES)), "path").mapInArrow(_peel_task, PEELED))
    names = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    rest = ["own_children", "own_leaves", "own_saved"]
    merged = peeled.filter("open").groupBy("node").agg(
        F.count(F.lit(1)).alias("tasks"), *(F.min(c).alias(c) for c in ("parent", "depth", "conv_id", "n_children", "n_leaves", "saved_tokens", "words")), *(F.sum(c).alias(c) for c in ["n_convs", *rest])
    )
    merged = written(merged)
    alone, shared = merged.filter("tasks = 1").select(*names), merged.filter("tasks > 1")
    ends = alone if shared.isEmpty() else alone.unionByName(_peel_shared(shared, alone))
    named = ends.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent"))
    out = peeled.filter("NOT open").select(*names, "parent_conv_id").unionByName(ends.withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    return out.join(named, "parent", "left").select("node", "depth", "conv_id", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), *names[4:])


def members(conversations: DataFrame) -> DataFrame:
    """(conv_id, node): the node at which each conversation ends."""
    return conversations.select("conv_id", _node(F.col("path")).alias("node"))


def _digest_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the joined chunks of each node; rows come ordered by node and chunk."""
    node, state, done = None, None, ([], [])
    for b in batches:
        for key, text in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    done[0].append(node)
                    done[1].append(state.hexdigest())
                node, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if node is not None:
        done[0].append(node)
        done[1].append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["node", "ids_sha256"])


def digest_ids(ended: DataFrame) -> DataFrame:
    """(node, ids_sha256) of (conv_id, node) rows: SHA-256 of the ids in decimal, ascending, comma-joined.

    The ids of a node go through its digest in order, in chunks of bounded size, so any number of them
    needs the memory of one.
    """
    chunks = ended.groupBy("node", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("node", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return chunks.repartition(F.col("node")).sortWithinPartitions("node", "chunk").mapInArrow(_digest_task, "node binary, ids_sha256 string")
