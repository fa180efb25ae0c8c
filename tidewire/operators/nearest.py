"""Links that stand for all related pairs of rows within a span of time, so that no pair is formed.

Components and first-fit groups need not all related pairs.  Say row x is related to the earlier rows y and z, and y to
z too, which comes before y: then the link to y leads to all that the link to z leads to.  So of earlier rows that
are related to each other the nearest is enough.

:func:`rule_links` is for relations that are unions of rules "equal in these columns, within this gap": a row is linked with
the one before it by each rule.  :func:`class_links` is for relations that hang on few columns (the *class* of a
row) and on the gap, and don't come back at a longer gap: a row is linked with the nearest of each related class, less those
that a nearer one leads to.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.graph import written

#: rows that are looked at together in a task
CHUNK = 512


def rule_links(rows: DataFrame, key: str, order: list[Column], keys: list[str], seconds: Column, rules: list[tuple[list[str], int]]) -> DataFrame:
    """(a, b) of rows of equal ``keys``; ``rules`` are (columns, gap in seconds); null and empty columns are equal to none.

    ``seconds`` never falls or never rises in the ``order``, ties of which go by key.
    """
    out = None
    for columns, gap in rules:
        some = rows
        for c in [*keys, *columns]:
            some = some.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != "") if c in columns else F.col(c).isNotNull())
        w = Window.partitionBy(*keys, *columns).orderBy(*order, F.col(key))
        near = some.select(F.col(key).alias("a"), F.lag(key).over(w).alias("b"), F.abs(seconds - F.lag(seconds).over(w)).alias("gap"))
        near = near.filter((F.col("gap") <= gap) & (F.col("a") != F.col("b"))).select("a", "b")
        out = near if out is None else out.unionByName(near)
    return out.distinct()


def _piece(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Links of the own rows of a piece (_id, _o, _p, _own, _c) by the reach of its classes (ca, cb, reach)."""
    rows = rows.sort_values(["_o", "_id"], kind="stable")
    ids, p, own = rows["_id"].to_numpy(), rows["_p"].to_numpy(np.int64), rows["_own"].to_numpy(bool)
    names, code = np.unique(rows["_c"].to_numpy(np.int64), return_inverse=True)
    reach = np.full((len(names), len(names)), -1, np.int64)
    reach[np.searchsorted(names, pairs["ca"].to_numpy(np.int64)), np.searchsorted(names, pairs["cb"].to_numpy(np.int64))] = pairs["reach"].to_numpy(np.int64)
    # rows of a class that is related to others over a longer gap than to itself stand alone
    loose = np.flatnonzero(reach.max(axis=0, initial=-1) > np.diagonal(reach))
    if len(loose):
        alone = np.isin(code, loose)
        of = np.r_[np.arange(len(names)), code[alone]]
        code = code.copy()
        code[alone] = len(names) + np.arange(int(alone.sum()))
        reach = reach[of][:, of]
    last = np.full(len(reach), -1, np.int64)
    late, early = [], []
    for at in range(0, len(ids), CHUNK):
        here = np.arange(at, min(at + CHUNK, len(ids)))
        met = np.full((len(here) + 1, len(last)), -1, np.int64)
        met[0] = last
        met[here - at + 1, code[here]] = here
        met = np.maximum.accumulate(met, axis=0)
        last, before = met[-1], met[:-1]
        asks = own[here]
        here, before = here[asks], before[asks]
        left = np.where((before >= 0) & (p[here][:, None] - p[before] <= reach[code[here]]), before, -1)
        while len(here):
            best = left.max(axis=1, initial=-1)
            some = best >= 0
            here, left, best = here[some], left[some], best[some]
            late.append(here)
            early.append(best)
            left[(p[best][:, None] - p[left] <= reach[code[best]]) | (left == best[:, None])] = -1
    a, b = (ids[np.concatenate(x)] if x else ids[:0] for x in (late, early))
    return pd.DataFrame({"a": a, "b": b})[lambda f: f["a"] != f["b"]]


def class_links(rows: DataFrame, key: str, order: Column, keys: list[str], seconds: Column, columns: list[str], gaps: list[int], related: Callable[[Column], Column]) -> DataFrame:
    """(a, b): links that stand for all pairs of rows of equal ``keys`` that are ``related``, within the last of ``gaps``.

    ``order`` is a whole number that places the rows, ties go by key; ``seconds`` rises with it.  ``related`` is a condition on
    ``columns`` (suffixed _a and _b) at a gap in seconds that is one of ``gaps``, the ends of the bands inside which it doesn't
    change.  Rows meet in pieces of time as wide as the last gap, each with the one before; a task holds one piece and the
    pairs of its classes, of which there are as many as pairs of rows where no two rows are alike.
    """
    span = gaps[-1]
    kind = dict(rows.select(key).dtypes)[key]
    named = rows.select(*keys, F.col(key).alias("_id"), order.cast("bigint").alias("_o"), seconds.cast("bigint").alias("_p"), F.xxhash64(F.to_json(F.struct(*columns))).alias("_c"), *columns)
    for c in keys:
        named = named.filter(F.col(c).isNotNull())
    bucket = F.floor(F.col("_p") / span)
    named = written(named.withColumn("_x", F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own"))))).select("*", F.col("_x.b").alias("_b"), F.col("_x.own").alias("_own")).drop("_x"))
    # the relation of two classes is found once, whatever the number of pieces in which they meet
    kinds = written(named.groupBy(*keys, "_c").agg(*[F.first(c).alias(c) for c in columns]))
    there = written(named.select(*keys, "_b", "_c").distinct())
    met = there.withColumnRenamed("_c", "ca").join(there.withColumnRenamed("_c", "cb"), [*keys, "_b"])
    side = lambda s: kinds.select(*keys, F.col("_c").alias(f"c{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    full = met.select(*keys, "ca", "cb").distinct().join(side("a"), [*keys, "ca"]).join(side("b"), [*keys, "cb"])
    held = full.withColumn("_g", F.explode(F.array(*[F.lit(g) for g in gaps]))).filter(related(F.col("_g")))
    reach = written(held.select(*keys, "ca", "cb", "_g").groupBy(*keys, "ca", "cb").agg(F.max("_g").cast("bigint").alias("reach")))
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_b"])]
    pairs = met.join(reach, [*keys, "ca", "cb"]).select(*names, "ca", "cb", "reach")
    slim = named.select(*keys, "_b", "_id", "_o", "_p", "_own", "_c")
    return slim.groupBy(*keys, "_b").cogroup(pairs.groupBy(*[f"_k{i}" for i in range(len(names))])).applyInPandas(_piece, f"a {kind}, b {kind}")
