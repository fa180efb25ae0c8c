"""Exact deduplication by a 128-bit content hash with a byte comparison.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; null counts as
empty.  Of equal texts the row with the most code points in its original text stays,
then the smallest ``doc_id``.

1. The scan hashes each text; only hashes go through the aggregate that forms the groups
   (combined before the shuffle, so a group of any size costs one row a task).
2. The texts of rows whose hash has several rows move once, by the hash; rows of the few
   largest groups meet their group by broadcast and don't move at all.
3. Bytes are compared by an aggregate: a group whose smallest and largest text are the
   same holds one text.  It is combined before the shuffle too, so each task sends at most
   two texts a group.  Groups that differ (a collision) are grouped by the text itself.

A null ``doc_id`` stays null; its row is kept only where no row of the group has an id.  Repeated rows each give a result row; an empty table gives an empty
result; extra columns are dropped from the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.skew import join_on_key
from tidewire.operators.graph import written

WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def _winner() -> list[Column]:
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), (-F.col("n")).alias("n"), F.col("doc_id").alias("keep_id"))).alias("best")
    return [best, F.count(F.lit(1)).alias("group_size")]


def _hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, h, text_sha256) for each row; no text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    norm = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length(text).alias("n"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "n", _hash(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"))


def collided(docs: DataFrame, many: DataFrame) -> DataFrame:
    """(doc_id, n, h, norm) of the rows whose hash stands for texts that differ; ``many`` has
    (h, group_size) of the hashes of several rows."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("n"), normalised(F.col("text")).alias("norm"))
    texts = texts.withColumn("h", _hash(F.col("norm")))
    members = join_on_key(texts.select("h", "norm"), many, "h", weight="group_size")
    differ = members.groupBy("h").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("h")
    found = written(differ)
    return texts.limit(0) if found.isEmpty() else texts.join(found, "h", "left_semi")


def assign_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _assigned(docs).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def _assigned(docs: DataFrame) -> DataFrame:
    hashed = written(_hashed(docs))
    many = written(hashed.groupBy("h").agg(*_winner()).filter("group_size > 1").select("h", F.col("best.keep_id").alias("keep_id"), "group_size"))
    grouped = join_on_key(hashed, many.withColumn("grouped", F.lit(True)), "h", weight="group_size", how="left")
    plain = grouped.select("doc_id", F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256", "h", "n")
    differ = collided(docs, many.select("h", "group_size"))
    return plain if differ.isEmpty() else _split_collisions(plain, differ)


def _split_collisions(plain: DataFrame, differ: DataFrame) -> DataFrame:
    """Regroups, by the text itself, all rows of a hash that stands for several texts."""
    own = differ.groupBy("h", "norm").agg(*_winner()).select("h", F.sha2("norm", 256).alias("text_sha256"), F.struct(F.col("best.keep_id").alias("keep_id"), "group_size").alias("own"))
    # texts of one hash differ in their SHA-256, by which their rows are told apart
    joined = plain.join(own, ["h", "text_sha256"], "left")
    return joined.select("doc_id", *(F.when(F.col("own").isNotNull(), F.col("own")[c]).otherwise(F.col(c)).alias(c) for c in ("keep_id", "group_size")), "text_sha256", "h", "n")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group of equal texts.

    Ids of dropped rows are a table of their own, so the documents move only where that
    table is too large for Spark to broadcast.  Of rows that repeat an id one stays; rows
    with a null id are told apart by their text.
    """
    assigned = written(_assigned(docs).select("doc_id", "keep_id", "h"))
    named = assigned.filter("doc_id IS NOT NULL")
    dropped = written(named.filter("doc_id <> keep_id").select("doc_id").distinct())
    repeated = written(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"))
    with_id = docs.filter("doc_id IS NOT NULL").join(dropped, "doc_id", "left_anti")
    once, twice = with_id.join(repeated, "doc_id", "left_anti"), with_id.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    bare = docs.filter("doc_id IS NULL").withColumn("_h", _hash(normalised(F.col("text"))))
    bare = bare.join(named.select(F.col("h").alias("_h")).distinct(), "_h", "left_anti").dropDuplicates(["_h"]).drop("_h")
    return once.unionByName(twice).unionByName(bare).select(*docs.columns)
