"""Greedy first-fit groups, in parallel.

The greedy pass takes rows in order; a row joins the first group that has a row related to it, or
founds one.  Groups are ordered by their founders, so the group of a row is the smallest founder
among the groups of its earlier neighbours, or the row itself where it has none: the smallest row
that a path reaches on which every step goes to an earlier related row.  That is a minimum over
directed links, which doubling finds in about log2(longest path) rounds; no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.graph import use_checkpoints, written


def first_fit(rows: DataFrame, key: str, order: list[str], links: DataFrame) -> DataFrame:
    """``rows`` with ``group``, the key of the founder of their group.

    ``links`` (a, b) are the related pairs, in either direction; rows come in the order of the
    columns ``order``, ties by key.  Each round writes its labels, so a lost executor costs one round.
    """
    use_checkpoints(rows.sparkSession)
    names = rows.select(F.col(key).alias("id"), F.struct(*order, F.col(key)).alias("at"))
    side = lambda s: names.select(F.col("id").alias(s), F.col("at").alias(f"at_{s}"))
    met = links.select("a", "b").filter("a <> b").join(side("a"), "a").join(side("b"), "b")
    turned = F.col("at_a") > F.col("at_b")
    pick = lambda c, d: F.when(turned, F.col(c)).otherwise(F.col(d))
    edges = written(met.select(pick("a", "b").alias("late"), pick("b", "a").alias("early"), pick("at_b", "at_a").alias("at")).distinct())
    labels = written(edges.groupBy(F.col("late").alias("id")).agg(F.min("at").alias("first")))
    while True:
        # founders have no earlier neighbour and no label: their place stands in the links themselves
        near = edges.join(labels.withColumnRenamed("id", "early"), "early").groupBy(F.col("late").alias("id")).agg(F.min("first").alias("near"))
        jump = labels.select(F.struct(F.col("id").alias("to")).alias("to"), F.col("first").alias("jump"))
        step = labels.join(near, "id", "left").withColumn("next", F.least("first", "near"))
        moved = written(step.join(jump, F.col("next")[key] == F.col("to")["to"], "left").select("id", F.least("next", "jump").alias("first"), F.col("first").alias("before")))
        labels = moved.select("id", "first")
        if moved.filter("first < before").isEmpty():
            break
    found = labels.select(F.col("id").alias(key), F.col("first")[key].alias("group"))
    return rows.join(found, key, "left").withColumn("group", F.coalesce("group", F.col(key)))
