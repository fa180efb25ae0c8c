"""Size-aware heavy-light join of shingle sets by Jaccard similarity.

Two documents link when ``100 * |A & B| >= 80 * |A | B|`` over their distinct 5-word
shingles (words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lowered; a shorter text is one
shingle).  Documents without words link with nothing.

1. *Classes.*  Documents with the same set (size and two 64-bit sums) form one class by an
   aggregate; the smallest id stands for it.  Copies cost nothing from here on.
2. *Candidates.*  A linked set shares at least t = ceil(0.8 n) of its n shingles, so the
   first floor(0.4 n) + 1 by hash hold floor(0.2 n) + 1 shared ones in both sets.  Only those are
   exchanged (as packed facts); a set with too few shared ones among them can't link.
3. *Order.*  Candidates learn how many candidates have each of their shingles (counts are
   summed for blocks of sets first, so a shingle that all sets have costs one number a
   block) and order them rare first.
4. *Light and heavy.*  A set of at most ``x`` shingles is light: it enumerates the
   ``SUBSET``-element subsets of its prefix of n - t + SUBSET shingles; linked light sets
   share one.  Heavier sets, and light ones that could link with heavier, enter inverted
   lists of the n - t + 1 rarest shingles.  The boundary ``x`` is chosen by cost in rows
   exchanged: a subset is one row, a list entry two (itself and its comparison with the list's
   leader; lists are not scanned pair by pair, so their length does not enter).
5. *Links.*  The sets of a key are first compared with a leader, in five rounds, each set
   with the leader that it shares most keys with; sets found connected need no further comparison.  What is left, pairs
   of one key that lie in different components, is bounded exhaustively, in blocks, by 1024-bit
   parity maps and compared where these allow a link.  All comparisons
   are exact over whole sets, and no pair that could join two components is left out.

Null text has no words.  A row with a null id gives a row with its set's size and a null
component: it links with nothing, as no id could stand for it.  Rows that repeat an id each
give a row; the set of the row with most shingles, then the largest sums, stands for the
id where it links.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import exchange as X
from tidewire.llm.components import components, written
from tidewire.llm.skew import join_on_key
from tidewire.llm.words import Words, handing_back, mix, shingle_sets, slices

SHINGLE, PERCENT, SUBSET, ROUNDS = 5, 80, 2, 5
#: bits of a set's parity map; pairs of a group are bounded in square blocks of BLOCK sets
BITS, BLOCK = 1024, 1024
#: a set's row carries so many of its smallest keys, to give a pair once
FIRST = 32
SECOND = np.uint64(0xA0761D6478BD642F)


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares with any set it links with."""
    return (PERCENT * n + 99) // 100


def _sets(ids: np.ndarray, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Sorted shingles, first position and size for each row, and a fingerprint of each set."""
    g, doc = shingle_sets(Words(raw, off, lower=True), SHINGLE)
    at = np.searchsorted(doc, np.arange(len(ids) + 1))
    n = np.diff(at)
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(g ^ s), dtype=np.uint64)]) for s in (np.uint64(0), SECOND)]
    prints = np.stack([n.astype(np.uint64), *(s[at[1:]] - s[at[:-1]] for s in sums)], axis=1)
    return g, at, n, [p.tobytes() for p in prints]


def _owner(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.int64).reshape(-1, 3)[:, 1]


def set_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, fp, owner) for each row: size and fingerprint of its set."""

    @handing_back
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, off in slices(batches):
            _, _, n, prints = _sets(ids, raw, off)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(prints, pa.binary()), pa.array(_owner(prints))], names=["doc_id", "n", "fp", "owner"])

    return docs.mapInArrow(sizes, "doc_id bigint, n bigint, fp binary, owner bigint")


def _prefix_facts(n_buckets: int):
    @handing_back
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, off in slices(batches):
            g, at, n, prints = _sets(ids, raw, off)
            spare = n - needed(n)
            take = np.minimum(n, 2 * spare + 1)
            row = np.repeat(np.arange(len(ids)), n)
            keep = np.arange(len(g)) - at[row] < take[row]
            (own, k), (known, kk) = X.combine(_owner(prints)[row[keep]], g[keep])
            top = lambda x: (x >> np.uint64(16)).astype(np.uint32)  # noqa: E731  the top bits of prefixes are alike
            for out in (
                X.pack((mix(k) % np.uint64(n_buckets)).astype(np.int32), X.FACT, own, top(k)),
                X.pack(X.owner_bucket(known, n_buckets * X.FINER), X.TOLD, known, top(kk)),
            ):
                if out is not None:
                    yield out

    return facts


def _shared_counts(key: tuple, table: pa.Table) -> pa.Table:
    owner, keys = X.unpack(*(table.column(c).to_pylist() for c in ("owners", "counts", "keys")), "uint32")
    keys, owner = X.distinct(keys, owner)
    first, size = X.groups(owner)
    return pa.table({"owner": pa.array(owner[first]), "shared": pa.array(size)})


def candidate_sets(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, n, grams) of one document for each class that may link with another class."""
    n = X.buckets(docs)
    told = X.shared_facts(docs.mapInArrow(_prefix_facts(n), X.PACKED), n, "uint32")
    shared = told.groupBy("bucket").applyInArrow(_shared_counts, "owner bigint, shared bigint")
    classes = sizes.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("owner").alias("owner"))
    partner = F.floor((F.col("n") * PERCENT + 99) / 100)  # the smallest size that it can link with
    least = F.floor(partner - F.floor((partner * PERCENT + 99) / 100)) + 1
    chosen = classes.join(shared, "owner").filter(F.col("shared") >= least).select(F.col("id").alias("doc_id"), "fp")

    @handing_back
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = np.array(batch.column("fp").to_pylist(), object)
            done = 0
            for ids, raw, off in slices([batch]):
                g, at, n, prints = _sets(ids, raw, off)
                same = [k for k in range(len(ids)) if prints[k] == want[done + k]]
                done += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids[same]), pa.array(n[same]), pa.array([g[at[k] : at[k + 1]].tobytes() for k in same], pa.binary())], names=["id", "n", "grams"])

    return docs.join(chosen, "doc_id").select("doc_id", "text", "fp").mapInArrow(grams, "id bigint, n bigint, grams binary").dropDuplicates(["id"])


def _gram_counts(n: int):
    """Counts of each shingle over a block of sets, packed by bucket of the shingle."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.frombuffer(b"".join(table.column("grams").to_pylist()), np.uint64), return_counts=True)
        bucket = (mix(keys) % np.uint64(n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        first, size = X.groups(bucket[order])
        rows = [(int(bucket[order[a]]), key[0].as_py(), counts[order[a : a + m]].astype(np.uint32).tobytes(), keys[order[a : a + m]].tobytes()) for a, m in zip(first.tolist(), size.tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "counts", "keys"])

    return count


@handing_back
def _total_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Total count of each shared shingle, for each block that has it."""
    block, counts, keys = [], [], []
    for batch in batches:
        block += batch.column("block").to_pylist()
        counts += [np.frombuffer(x, np.uint32) for x in batch.column("counts").to_pylist()]
        keys += [np.frombuffer(x, np.uint64) for x in batch.column("keys").to_pylist()]
    if not keys:
        return
    ends = np.cumsum([len(k) for k in keys])
    names, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts), minlength=len(names)).astype(np.uint32)[place]
    for b, k, t in zip(block, keys, np.split(total, ends[:-1]), strict=True):
        many = t > 1
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([t[many].tobytes()], pa.binary()), pa.array([k[many].tobytes()], pa.binary())], names=["block", "counts", "keys"])


def _prefix(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Rare-first prefixes of the sets of a block: (id, n, single, wide, bits)."""
    keys = np.frombuffer(b"".join(right.column("keys").to_pylist()), np.uint64)
    count = np.frombuffer(b"".join(right.column("counts").to_pylist()), np.uint32)
    order = np.argsort(keys)
    keys, count = keys[order], count[order]
    out: list[list] = [[], [], [], [], []]
    for i, data in zip(left.column("id").to_pylist(), left.column("grams").to_pylist(), strict=True):
        g = np.frombuffer(data, np.uint64)
        at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
        both = keys[at] == g if len(keys) else np.zeros(len(g), bool)
        spare = int(both.sum()) - int(needed(np.array([len(g)]))[0])
        if spare < 0:
            continue  # fewer shared shingles than any link needs
        g, c = g[both], count[at[both]]
        rare = np.lexsort((g, c))[: spare + SUBSET]
        bits = np.bincount((np.frombuffer(data, np.uint64) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
        for col, v in zip(out, (i, len(data) // 8, spare + 1, g[rare].tobytes(), np.packbits(bits.astype(np.uint8)).tobytes()), strict=True):
            col.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "n", "single", "wide", "bits"])


def prefixes(sets: DataFrame) -> DataFrame:
    n = X.buckets(sets, "grams")
    blocks = sets.withColumn("block", X.owner_bucket_column(F.col("id"), n * X.FINER)).groupBy("block")
    counts = blocks.applyInArrow(_gram_counts(n), "bucket int, block int, counts binary, keys binary").repartitionById(n, "bucket").mapInArrow(_total_counts, "block int, counts binary, keys binary")
    return blocks.cogroup(counts.groupBy("block")).applyInArrow(_prefix, "id bigint, n bigint, single bigint, wide binary, bits binary")


def boundary(prefix: DataFrame) -> int:
    """The largest size at which enumerating subsets costs no more than scanning lists: a light
    set sends its subsets, a heavy one its lists' entries and a comparison for each list."""
    wide = F.col("single") + (SUBSET - 1)
    cost = prefix.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 4).alias("band")).agg(
        F.max("n").alias("n"), F.sum(wide * (wide - 1) / 2).alias("subsets"), F.sum(F.col("single") * 2).alias("lists")
    )
    x = 0
    for row in sorted(cost.collect()):  # bands of sizes: four for each power of two
        if row["subsets"] > row["lists"]:
            break
        x = row["n"]
    return x


def keys(prefix: DataFrame, x: int) -> DataFrame:
    """(key, id, n): subset keys of light sets, list keys of heavy sets and of those near the boundary."""

    @handing_back
    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in range(0, len(frame), 500):
                found = []
                for i, n, single, wide in frame[["id", "n", "single", "wide"]].iloc[part : part + 500].itertuples(index=False):
                    g = np.frombuffer(wide, np.uint64)
                    if n <= x and len(g) >= SUBSET:
                        pairs = np.array(list(combinations(range(len(g)), SUBSET)))
                        h = mix(np.sort(g[pairs], axis=1) @ np.array([0x9FB21C651E98DF25, 0xD1B54A32D192ED03], np.uint64))
                        found.append((i, n, h))
                    if n > x or 100 * n >= PERCENT * x:
                        found.append((i, n, g[:single]))
                if found:
                    size = [len(h) for _, _, h in found]
                    yield pd.DataFrame({"key": np.concatenate([h for *_, h in found]).view(np.int64), "id": np.repeat([f[0] for f in found], size), "n": np.repeat([f[1] for f in found], size)})

    return prefix.select("id", "n", "single", "wide").mapInPandas(emit, "key bigint, id bigint, n bigint")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared over the whole sets."""
    left = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).join(sets.select(F.col("id").alias("a"), F.col("grams").alias("left")), "a")
    rows = pairs.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("right")), "b").select("a", "b", "right")

    @handing_back
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = join_on_key(rows, left.checkpoint(), "a", weight="pairs")
    return joined.select("a", "b", "left", "right").mapInArrow(compare, "a bigint, b bigint")


def _fits(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _possible(n: np.ndarray, bits: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether two sets may be similar enough: they differ in at least as many shingles as
    their parity maps differ in bits, and may differ in (100 - PERCENT) / (100 + PERCENT) of both sizes."""
    apart = np.bitwise_count(bits ^ others).sum(axis=-1, dtype=np.int64)
    return apart * (100 + PERCENT) <= (n + m) * (100 - PERCENT)


def _maps(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _plausible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (a, b) that their parity maps don't rule out."""
    rows = pairs.join(maps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a").join(maps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")

    @handing_back
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _possible(batch.column("na").to_numpy(), _maps(batch.column("ba")), batch.column("nb").to_numpy(), _maps(batch.column("bb")))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(bound, "a bigint, b bigint")


def _across(joined: DataFrame, maps: DataFrame) -> DataFrame:
    """All pairs (a, b) of one key and different components that their parity maps don't rule out.

    The sets of a key are dealt to blocks of about BLOCK; a group is one pair of blocks, so no
    task meets more than twice that of a key, however many sets have it.  Keys of one block
    are grouped many at a time.  Each row carries the FIRST smallest keys of its set, whatever
    the length of the text.  A pair is always given by the smallest key that its sets share, and not
    by a key for which these carried keys show a smaller shared one; few pairs are given twice.
    """
    slots = X.partitions(joined.sparkSession)
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    slot = F.when(parts > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(slots)))
    spread = joined.select(slot.alias("slot"), "key", "id", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    rows = spread.select("slot", "key", "id", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(maps.select("id", "n", "bits"), "id")
    rows = rows.join(joined.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST).alias("keys")), "id")

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys, ids, comp, own, n = (table.column(c).to_numpy() for c in ("key", "id", "component", "own", "n"))
        bits = _maps(table.column("bits"))
        lists = table.column("keys").combine_chunks()
        at_key, all_keys = lists.offsets.to_numpy(), lists.values.to_numpy()
        below = lambda i, k: all_keys[at_key[i] : at_key[i] + np.searchsorted(all_keys[at_key[i] : at_key[i + 1]], k)]
        low, high = key[1].as_py(), key[2].as_py()
        found: list[np.ndarray] = []
        for at, size in zip(*(x.tolist() for x in X.groups(keys)), strict=True):
            part = np.arange(at, at + size)
            left, right = part[own[part] == low], part[own[part] == high]
            for i in left.tolist():
                j = right[right > i] if low == high else right
                j = j[comp[j] != comp[i]]
                if len(j):
                    j = j[_possible(n[i], bits[i], n[j], bits[j])]
                    mine = below(i, keys[at])
                    j = j[[not np.isin(below(x, keys[at]), mine).any() for x in j.tolist()]] if len(mine) else j
                    found.append(np.stack([np.full(len(j), ids[i]), ids[j]], axis=1))
        got = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(got.min(axis=1, initial=1 << 62)), "b": pa.array(got.max(axis=1, initial=-(1 << 62)))})

    return rows.groupBy("slot", "low", "high").applyInArrow(pairs, "a bigint, b bigint")


def links(sets: DataFrame) -> DataFrame:
    """(id, component) of the sets that link with another set."""
    spark = sets.sparkSession
    prefix = prefixes(sets).checkpoint()
    all_keys = keys(prefix, boundary(prefix))
    sizes = all_keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    open_keys = join_on_key(all_keys, sizes, "key", weight="size").checkpoint()
    found = done = labels = None
    for number in range(ROUNDS + 1):
        named = open_keys.withColumn("component", F.col("id")) if labels is None else open_keys.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("id", "n", "component"), F.xxhash64("id", F.lit(number))).alias("lead")).filter("low <> high")
        joined = written(join_on_key(named.drop("size"), mixed, "key", weight="size"))
        if number < ROUNDS:
            pairs = joined.filter("component <> lead.component").select(F.col("lead.id").alias("l"), F.col("id").alias("i"), "n", F.col("lead.n").alias("ln"))
            # each set meets the leader with which it shares most keys
            pairs = pairs.filter(_fits("n", "ln")).groupBy("i", "l").agg(F.count(F.lit(1)).alias("shared")).groupBy("i").agg(F.max_by("l", F.struct("shared", "l")).alias("l"))
            pairs = pairs.select(F.least("l", "i").alias("a"), F.greatest("l", "i").alias("b")).distinct()
        else:
            pairs = _across(joined, prefix).distinct()
        pairs = written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            if number >= ROUNDS or joined.isEmpty():
                break
            continue
        new = written(_linked(_plausible(pairs, prefix) if number < ROUNDS else pairs, sets))
        found = new if found is None else found.unionByName(new)
        done = pairs if done is None else done.unionByName(pairs)
        labels = components(found)
        open_keys = joined.select("key", "id", "n")
    return spark.createDataFrame([], "id bigint, component bigint") if labels is None else labels


def join_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = every.filter("doc_id IS NOT NULL")
    sizes = set_sizes(named).checkpoint()
    sets = candidate_sets(named, sizes).checkpoint()
    labels = links(sets)
    classes = sizes.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size"))
    known = classes.join(labels, "id", "left").select("fp", "size", F.coalesce("component", "id").alias("component"))
    known = known.filter("size > 1 OR component IS NOT NULL").checkpoint()
    out = join_on_key(sizes, known, "fp", weight="size", how="left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    bare = set_sizes(every.filter("doc_id IS NULL")).select(F.lit(None).cast("bigint").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return out.unionByName(bare)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with their columns.

    Rows with a null id stay.
    """
    drop = written(join_components(docs).filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(drop, "doc_id", "left_anti")
