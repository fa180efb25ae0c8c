"""Equi joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keys with more rows than one in this many never meet in one task: there can be no more of them
HEAVY_SHARE = 2000
#: group rows of heavy keys are broadcast up to this many bytes, beyond it their rows are salted
BROADCAST_BYTES, SALTS = 32 << 20, 64


def join_on_key(rows: DataFrame, groups: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Joins ``rows`` with ``groups``, which has one row for each key and, in ``weight``,
    the number of rows of that key.

    Keys with over 1 / HEAVY_SHARE of all rows number at most HEAVY_SHARE.  Their group rows
    are broadcast where their measured size is below BROADCAST_BYTES; otherwise each is sent
    SALTS times and the rows of the key are dealt to these copies.
    """
    total, most = groups.agg(F.sum(weight), F.max(weight)).first()
    fields = [c for c in groups.columns if c != key and c not in rows.columns]
    limit = max(1000, (total or 0) // HEAVY_SHARE)
    if (most or 0) <= limit:
        return rows.join(groups.select(key, *fields), key, how).select(*rows.columns, *fields)
    heavy, light = groups.filter(F.col(weight) > limit), groups.filter(F.col(weight) <= limit)
    packed = heavy.select(key, F.struct(*fields).alias("_heavy"))
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in groups.select(*fields).dtypes if kind in ("string", "binary")]
    size = heavy.agg(F.sum(sum(wide, F.lit(64)))).first()[0] if wide else 0
    # which keys are heavy is always small; what they carry may not be
    marked = rows.join(F.broadcast(packed if size <= BROADCAST_BYTES else heavy.select(key, F.lit(True).alias("_heavy"))), key, "left")
    by_shuffle = marked.filter("_heavy IS NULL").drop("_heavy").join(light.select(key, *fields), key, how)
    held = marked.filter("_heavy IS NOT NULL")
    if size <= BROADCAST_BYTES:
        held = held.select(*rows.columns, "_heavy.*")
    else:
        salted = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = held.drop("_heavy").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).select(*rows.columns, "_heavy.*")
    return held.unionByName(by_shuffle.select(*rows.columns, *fields))
