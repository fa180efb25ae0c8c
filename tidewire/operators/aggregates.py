"""Aggregations over mentions, articles, claims and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.indices import recency


def since(as_of: str, interval: str) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {interval}")


def entity_spikes(mentions: DataFrame, as_of: str, recent: int = 2, baseline: int = 7, threshold: float = 1.5, common: list[str] | None = None, common_threshold: float = 3.0, limit: int | None = 20) -> DataFrame:
    """Recent against baseline mentions; one pass, counts combined before the shuffle.

    The baseline is days ``recent`` to ``baseline``; an entity without it is NEW at twice
    its recent count.  The smallest type stands for an entity's types.
    """
    new = F.col("mentioned_at") > since(as_of, f"{recent} DAYS")
    rows = mentions.filter(F.col("mentioned_at") > since(as_of, f"{baseline} DAYS"))
    by = rows.groupBy("entity").agg(F.min(F.when(new, F.col("entity_type"))).alias("entity_type"), F.count_if(new).alias("recent_mentions"), F.count_if(~new).alias("baseline_mentions")).filter("recent_mentions > 0")
    ratio = F.when(F.col("baseline_mentions") == 0, F.col("recent_mentions") * 2.0).otherwise(F.col("recent_mentions") / (F.col("baseline_mentions") / F.lit(baseline / recent)))
    label = F.when(F.col("baseline_mentions") == 0, "NEW").when(F.col("spike_ratio") > 1.5, "RISING").when(F.col("spike_ratio") < 0.5, "FALLING").otherwise("STABLE")
    least = F.when(F.lower("entity").isin(*(common or [""])), common_threshold).otherwise(threshold)
    out = by.withColumn("spike_ratio", ratio).withColumn("trend", label).filter(F.col("spike_ratio") >= least)
    return out if limit is None else out.orderBy(F.desc("spike_ratio"), "entity").limit(limit)


def top_entities(mentions: DataFrame, as_of: str, days: int = 7, limit: int = 10) -> DataFrame:
    """A8."""
    rows = mentions.filter(F.col("mentioned_at") > since(as_of, f"{days} DAYS"))
    return rows.groupBy("entity").agg(F.min("entity_type").alias("entity_type"), F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "entity").limit(limit)


def cooccurrences(mentions: DataFrame) -> DataFrame:
    """Ordered entity pairs of each article, each once.

    Both sides are the distinct (article, entity) rows; an article names few entities, so
    the pairs of one key are bounded by its length.
    """
    one = mentions.groupBy("topic", "article_url", "entity").agg(F.min("mentioned_at").alias("mentioned_at"))
    other = one.select("topic", "article_url", F.col("entity").alias("entity_b"))
    return one.withColumnRenamed("entity", "entity_a").join(other, ["topic", "article_url"]).filter("entity_a < entity_b").select("topic", "article_url", "entity_a", "entity_b", "mentioned_at")


def co_mentions(pairs: DataFrame, entity: str, limit: int = 10) -> DataFrame:
    """Entities named with one entity."""
    rows = pairs.filter((F.col("entity_a") == entity) | (F.col("entity_b") == entity))
    other = F.when(F.col("entity_a") == entity, F.col("entity_b")).otherwise(F.col("entity_a"))
    return rows.groupBy(other.alias("entity")).agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "entity").limit(limit)


def graph_edges(pairs: DataFrame, least: int = 2) -> DataFrame:
    """A10: pairs with at least ``least`` articles."""
    return pairs.groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("entity_a").alias("entity")).union(edges.select("entity_b")).distinct()


def region_attention(articles: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    """Attention by region; shares and sizes are over the regions other than 'global'."""
    rows = articles.filter(F.col("published_at") >= since(as_of, f"{hours} HOURS"))
    by = rows.groupBy("region").agg(F.sum(F.lit(1.0) + recency(F.col("published_at"), as_of, hours) * 1.75).alias("weight"), F.count(F.lit(1)).alias("articles"), F.countDistinct("source_domain").alias("sources"), F.max("published_at").alias("latest"))
    local = F.when(F.col("region") != "global", F.col("weight"))
    all_rows = Window.partitionBy()  # one row for each region
    return by.withColumn("share", F.col("weight") / F.sum(local).over(all_rows)).withColumn("size", F.col("weight") / F.max(local).over(all_rows))


def source_rows(claims: DataFrame, *keys: str) -> DataFrame:
    """Claim outcomes of each source as an empirical score and a weight multiplier."""
    n = lambda s: F.count_if(F.col("resolution_status") == s)
    by = claims.groupBy(*(keys or ("source_name",))).agg(n("corroborated").alias("corroborated"), n("vindicated_later").alias("vindicated"), n("contradicted").alias("contradicted"), n("unresolved").alias("unresolved"), n("mixed").alias("mixed"), F.count(F.lit(1)).alias("claims"))
    score = (F.col("corroborated") + F.col("vindicated") * 1.15 + F.col("mixed") * 0.5 + F.col("unresolved") * 0.3 + 1) / (F.col("claims") + 2)
    return by.withColumn("score", F.least(F.lit(1.0), score)).withColumn("multiplier", F.lit(0.65) + F.col("score") * 0.9)


def weighted_median(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The smallest value at which the running weight reaches half of the total.

    Weights are first summed by (key, value), so a window holds the distinct values only.
    """
    by = rows.groupBy(key, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(key)
    running = F.sum("_w").over(w.orderBy(value))
    return by.withColumn("_at", running).withColumn("_all", F.sum("_w").over(w)).filter("_at * 2 >= _all").groupBy(key).agg(F.min(value).alias("median"))


def vote(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The value with most weight, the smallest of equal ones."""
    by = rows.groupBy(key, value).agg(F.sum(weight).alias("_w"))
    return by.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_w"), F.col(value))).alias("winner"), F.sum("_w").alias("total_weight"))


def centroid(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """Weighted mean position."""
    return rows.groupBy(key).agg((F.sum(F.col("latitude") * weight) / F.sum(weight)).alias("latitude"), (F.sum(F.col("longitude") * weight) / F.sum(weight)).alias("longitude"), F.sum(weight).alias("weight"))


def grid(rows: DataFrame, places: int = 1) -> DataFrame:
    """Roll-up to grid cells by type and country."""
    return rows.groupBy(F.floor(F.col("latitude") * 10**places).alias("cell_lat"), F.floor(F.col("longitude") * 10**places).alias("cell_lon"), "event_type", "country").agg(
        F.count(F.lit(1)).alias("events"), F.sum("fatalities").alias("fatalities"), F.max("event_date").alias("latest")
    )


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the larger of equal ones."""
    by = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(key).agg(F.max_by(value, F.struct("n", value)).alias("mode"), F.max("n").alias("n"))


def agreement(labels: DataFrame) -> DataFrame:
    """Share of the most frequent of the annotators' last labels of each event."""
    last = labels.groupBy("event_id", "annotator_id").agg(F.max_by("label", F.struct("annotated_at", "label")).alias("label"))
    by = last.groupBy("event_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("event_id").agg((F.max("n") / F.sum("n")).alias("agreement"), F.sum("n").alias("annotators"))


def pairwise_quality(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F1 over pairs, from (item, cluster) rows; empty counts 1.

    Pairs are counted from cluster sizes, not made: with n items in a cluster there are
    n * (n - 1) / 2 of them; common pairs are those of (predicted, expected) cells.
    """
    both = predicted.withColumnRenamed("cluster", "p").join(expected.withColumnRenamed("cluster", "e"), "item", "full")
    pairs = lambda *k: both.filter(" AND ".join(f"{x} IS NOT NULL" for x in k)).groupBy(*k).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("v"))
    out = pairs("p", "e").select(F.col("v").alias("tp")).join(pairs("p").select(F.col("v").alias("pp"))).join(pairs("e").select(F.col("v").alias("ep")))
    ratio = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b))
    out = out.withColumn("precision", ratio("tp", "pp")).withColumn("recall", ratio("tp", "ep"))
    s = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(s == 0, 0.0).otherwise(F.col("precision") * F.col("recall") * 2 / s)).select("precision", "recall", "f1")


def frame_shares(signals: DataFrame, *keys: str) -> DataFrame:
    """Share of each dominant frame within the keys."""
    by = signals.groupBy(*keys, "dominant_frame").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
