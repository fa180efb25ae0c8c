"""Connected components and pair blocking for clustering."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoints(spark: SparkSession) -> None:
    """The shared folder that the cluster names; one of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder.  Unlike a checkpoint's, the new plan keeps
    neither the constraints nor the statistics of the old one, which grow without end in loops."""
    use_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (columns a, b); the label is the smallest id.

    Each round takes the smallest label among neighbours (an aggregate, combined before
    the shuffle, so an id of any degree is fine), then the label of that label.  Labels
    are written to the checkpoint folder each round, so a lost executor costs one round.
    """
    use_checkpoints(links.sparkSession)
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(around, "id").select("id", F.least("component", "near").alias("next"), "component")
        up = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        moved = written(step.join(up, "next", "left").select("id", F.least("next", F.coalesce("jump", "next")).alias("component"), F.col("component").alias("before")))
        labels = moved.select("id", "component")
        if moved.filter("component <> before").isEmpty():
            return labels


def assign(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """Rows with the component of their key; a key without links is its own."""
    labels = components(links).withColumnRenamed("id", key)
    return rows.join(labels, key, "left").withColumn("component", F.coalesce("component", F.col(key)))


def bucket_pairs(rows: DataFrame, keys: list[str], time: str, days: float, columns: list[str]) -> DataFrame:
    """Ordered pairs (a.id < b.id) that share the keys and lie within ``days`` of each other.

    Rows meet on a time bucket as wide as the gap; each row is also sent to the bucket after
    its own, so a pair is met once: in the bucket of its later row.
    """
    width = int(days * 86400)
    bucket = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / width)
    at = F.unix_seconds(F.col(time).cast("timestamp")).alias("_s")
    early = rows.select(*keys, at, *[F.col(c).alias(f"{c}_a") for c in columns], F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    late = rows.select(*keys, at.alias("_t"), *[F.col(c).alias(f"{c}_b") for c in columns], bucket.alias("_b"))
    gap = F.col("_t") - F.col("_s")
    pairs = early.join(late, [*keys, "_b"]).filter((gap >= 0) & (gap <= width))
    return pairs.withColumn("gap_days", gap / 86400.0).drop("_b", "_s", "_t")
