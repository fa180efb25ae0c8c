"""An inverted-file index of vectors, for searches that need not be exact.

Centroids are fitted on at most SAMPLE vectors; every vector is put in the cell of its nearest
centroid, cells are cut in blocks of about BLOCK.  A query reads the cells of its ``probes`` nearest
centroids only.  How many that must be depends on the data: :func:`probes_for` measures it on at most
ASKED queries.  Clustered vectors need a few cells of about sqrt(n) / 2, so a query's cost grows with the
square root of the table; vectors without any structure need most cells, as with every such index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.graph import use_checkpoints, written

#: bounds of the sample, of the centroids (all that is broadcast), of blocks and of packs of queries
SAMPLE, SAMPLE_BYTES, CELLS, BLOCK, PACK = 16384, 64 << 20, 1024, 2048, 256
#: probes are measured on so many queries at most, for a share of hits a little above what is wanted
ASKED, AIM = 128, 0.95


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    m = np.asarray(x, np.float64)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def fit(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Centroids by k-means on the sphere; the first rows of the sample are the start."""
    x = unit(sample)
    centres = x[:n].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
        centres = unit(centres)
    return centres


@dataclass
class Index:
    """Blocks (cell, part, ids, vectors) and the centroids of the cells."""

    blocks: DataFrame
    centroids: np.ndarray
    count: int


def _vectors(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    return rows.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def build(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> Index:
    """The index of vectors of one length; rows without id or vector are left out."""
    use_checkpoints(vectors.sparkSession)
    rows = _vectors(vectors, ident, vector)
    count, length = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, length or 1))))
    sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(size).select("v").collect()]
    centroids = fit(np.array(sample), min(cells or max(1, round(count**0.5 / 2)), CELLS, len(sample))) if sample else np.zeros((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_matrix(b.column("v")) @ shared.value.T).argmax(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], ["id", "v", "cell"])

    put = written(rows.mapInArrow(task, "id bigint, v array<double>, cell int"))
    parts = put.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # at most CELLS rows
    cut = put.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = cut.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v")).alias("r")).select("cell", "part", F.col("r.id").alias("ids"), F.flatten("r.v").alias("vectors"))
    return Index(written(blocks), centroids, count)


def search(index: Index, queries: DataFrame, k: int, probes: int, ident: str = "query_id", vector: str = "query") -> DataFrame:
    """(query_id, vec_id, score, probe, rank): the k best by cosine among the vectors of the query's ``probes``
    nearest cells, ties to the smaller id, without the vector of the query's own id; ``probe`` is the
    place of the vector's cell among the query's.
    """
    schema = "query_id bigint, vec_id bigint, score double, probe int"
    spark, cells = queries.sparkSession, len(index.centroids)
    if not cells:
        return spark.createDataFrame([], f"{schema}, rank int")
    probes = min(cells, probes)
    shared = spark.sparkContext.broadcast(index.centroids)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _matrix(b.column("v")) @ shared.value.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.tolist(), pa.list_(pa.int32()))], ["id", "v", "cells"])

    asked = _vectors(queries, ident, vector).mapInArrow(ask, "id bigint, v array<double>, cells array<int>").select("id", "v", F.posexplode("cells").alias("probe", "cell"))
    asked = written(asked)
    many = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs"))
    packs = asked.join(F.broadcast(many), "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.col("packs")).alias("pack")).agg(F.collect_list(F.struct("id", "v", "probe")).alias("r"))
    # a pack goes to every block of its cell
    parts = index.blocks.groupBy("cell").agg(F.max("part").alias("last"))
    packs = packs.join(F.broadcast(parts), "cell").select("cell", F.explode(F.sequence(F.lit(0), "last")).alias("part"), F.col("r.id").alias("asked"), F.col("r.probe").alias("probe"), F.flatten("r.v").alias("sought"))
    met = packs.join(index.blocks, ["cell", "part"])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                asked, probe, sought, ids, vs = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("asked", "probe", "sought", "ids", "vectors"))
                s = unit(sought.reshape(len(asked), -1)) @ unit(vs.reshape(len(ids), -1)).T
                s[asked[:, None] == ids[None, :]] = -np.inf
                few = min(k, len(ids))
                # all that reach the k-th best, so that ties are settled by id later
                least = np.partition(s, len(ids) - few, axis=1)[:, len(ids) - few]
                at, to = np.nonzero((s >= least[:, None] - 1e-12) & np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(asked[at]), pa.array(ids[to]), pa.array(s[at, to]), pa.array(probe[at] + 1, pa.int32())], ["query_id", "vec_id", "score", "probe"])

    found = met.select("asked", "probe", "sought", "ids", "vectors").mapInArrow(score, schema)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k)


def probes_for(index: Index, queries: DataFrame, k: int, aim: float = AIM, ident: str = "query_id", vector: str = "query") -> int:
    """The fewest probes with which at most ASKED of the queries (those with the smallest hashes) find a share
    ``aim`` of their true k best: all cells are searched for these once."""
    some = queries.orderBy(F.xxhash64(ident), ident).limit(ASKED)
    found = search(index, some, k, len(index.centroids), ident, vector).groupBy("probe").count().collect()  # at most CELLS rows
    need, have = aim * sum(r["count"] for r in found), 0
    for r in sorted(found, key=lambda r: r.probe):
        have += r["count"]
        if have >= need:
            return r.probe
    return 1


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: queries, wanted pairs and hits; a vector that scores like the last wanted one is as good."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("wanted"))
    good = found.join(last, "query_id").filter(F.col("score") >= F.col("least") - 1e-9).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    both = last.join(good, "query_id", "left").select("query_id", "wanted", F.least("wanted", F.coalesce("hits", F.lit(0))).alias("hits"))
    return both.agg(F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"), F.sum("hits").alias("hits"))
