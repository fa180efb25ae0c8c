"""Set-based merges: one primitive for every upsert, with a rule for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("new", "old", "new_or_old", "old_or_new", "least", "greatest", "new_unless_empty", "union", "sum")


def _rule(rule: str, old: Column, new: Column) -> Column:
    """The value of a column where both sides have the key."""
    if rule == "new":
        return new
    if rule == "old":
        return old
    if rule == "new_or_old":
        return F.coalesce(new, old)
    if rule == "old_or_new":
        return F.coalesce(old, new)
    if rule == "least":
        return F.least(old, new)
    if rule == "greatest":
        return F.greatest(old, new)
    if rule == "new_unless_empty":
        return F.when(new.isNull() | new.cast("string").isin("", "{}", "[]"), old).otherwise(new)
    if rule == "union":
        return F.array_union(F.coalesce(old, F.array()), F.coalesce(new, F.array()))
    if rule == "sum":
        return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
    raise ValueError(f"unknown rule {rule}; one of {RULES}")


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, str] | None = None, default: str = "new", when: Column | None = None) -> DataFrame:
    """The rows of ``target`` after an upsert of ``source``, and what happened to each.

    One full outer join on the keys.  Each other column follows its rule where both sides
    have the key; a column that one side lacks counts as null there.  ``when``, over
    ``old.*`` and ``new.*`` columns, limits which matched rows are updated.  The result has an
    ``_action`` column: inserted, updated or kept.  ``source`` must have each key once.
    """
    rules = rules or {}
    columns = list(dict.fromkeys([*target.columns, *source.columns]))
    pad = lambda df, other: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in columns])
    old, new = pad(target, source), pad(source, target)
    old, new = old.withColumn("_in", F.lit(True)).alias("old"), new.withColumn("_in", F.lit(True)).alias("new")
    joined = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full")
    has_old, has_new = F.col("old._in").isNotNull(), F.col("new._in").isNotNull()
    change = has_old & has_new & (F.coalesce(when, F.lit(False)) if when is not None else F.lit(True))
    out = [F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in keys]
    for c in columns:
        if c not in keys:
            o, n = F.col(f"old.{c}"), F.col(f"new.{c}")
            out.append(F.when(change, _rule(rules.get(c, default), o, n)).when(has_old, o).otherwise(n).alias(c))
    action = F.when(~has_old, "inserted").when(change, "updated").otherwise("kept").alias("_action")
    return joined.select(*out, action)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows and those source rows whose key it lacks, each key once."""
    fresh = source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def replace_slice(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The slices that the source names are replaced by its rows."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def write_slices(df: DataFrame, path: str, keys: list[str]) -> None:
    """The same as a write: only the partitions of the rows' keys are overwritten."""
    df.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def append_changed(history: DataFrame, latest: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """Rows whose digest differs from the newest one kept for their key."""
    newest = history.groupBy(key).agg(F.max_by(digest, order).alias("_digest"))
    return latest.join(newest, key, "left").filter(~F.col(digest).eqNullSafe(F.col("_digest"))).drop("_digest")


def upsert_by_id_or_hash(target: DataFrame, source: DataFrame, ident: str, source_key: str, digest: str) -> DataFrame:
    """Documents matched by id or by (source, digest); the id that is there survives."""
    by_id = target.select(F.col(ident).alias("_i"), F.col(ident))
    by_hash = target.groupBy(source_key, digest).agg(F.min(ident).alias("_h"))
    named = source.join(by_id.select("_i"), F.col(ident) == F.col("_i"), "left").join(by_hash, [source_key, digest], "left")
    named = named.withColumn(ident, F.coalesce("_i", "_h", F.col(ident))).select(*source.columns)
    return merge_upsert(target, named.dropDuplicates([ident]), [ident])


def purge(target: DataFrame, condition: Column) -> DataFrame:
    """Rows that a condition does not hold for; an unknown condition keeps."""
    return target.filter(~F.coalesce(condition, F.lit(False)))
