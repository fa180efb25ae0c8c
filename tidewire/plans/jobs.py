"""Queries of end-to-end jobs (C15-C30): compositions of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.functions import texts as X
from tidewire.operators import aggregates as A
from tidewire.operators import cluster as C
from tidewire.operators import merge as M
from tidewire.operators import reads as R
from tidewire.plans.aggregates import RELIABLE
from tidewire.plans.clusters import located
from tidewire.plans.indices import rounded
from tidewire.plans.registry import query
from tidewire.plans.windows import diversified


def canonical_rows(clusters):
    """One canonical row for each cluster of events."""
    by = clusters.groupBy("component").agg(
        F.min("country").alias("country"), F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("article_count"), F.sum("fatalities").alias("fatalities"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
        F.min_by(F.struct("latitude", "longitude"), F.struct(F.when(F.col("dataset") == "acled", 0).otherwise(1), F.col("event_id"))).alias("point"),
    )
    anchor = S.stable_hash("event_type", F.lower("country"), S.week_floor("first_date"), "component")
    return by.select(F.concat(F.lit("evt-"), F.substring(anchor, 1, 16)).alias("event_id"), "country", "event_type", "article_count", "fatalities", "first_date", "last_date", "point.latitude", "point.longitude")


@query("C15_canonical_events", "structured_v")
def c15(structured):
    """Structured events to canonical events: C5, A20, A36, then K8 on what the first half of the time left."""
    rows = located(structured)
    early = canonical_rows(C.structured_clusters(rows.filter("event_date < DATE '2024-01-15'")))
    return M.merge_upsert(early, canonical_rows(C.structured_clusters(rows)), ["event_id"], {"first_date": "old", "latitude": "new_or_old", "longitude": "new_or_old"}).drop("_action")


@query("C20_narrative_drift", "framing_v", sql="SELECT subject_key, count(*) AS signals, count(DISTINCT source) AS sources, arg_max(dominant_frame, (n, dominant_frame)) AS frame FROM (SELECT *, count(*) OVER (PARTITION BY subject_key, dominant_frame) AS n FROM framing_v) GROUP BY subject_key")
def c20(framing):
    shares = A.modal(framing, "subject_key", "dominant_frame").select("subject_key", F.col("mode").alias("frame"))
    by = framing.groupBy("subject_key").agg(F.count(F.lit(1)).alias("signals"), F.countDistinct("source").alias("sources"))
    return by.join(shares, "subject_key")


@query("C21_reliability_refresh", "claims_v", sql=f"SELECT source_name, topic, count(*) AS claims, round({RELIABLE}, 6) AS score FROM claims_v GROUP BY GROUPING SETS ((source_name, topic), (source_name))")
def c21(claims):
    """Every topic and all together in one pass."""
    n = lambda s: F.count_if(F.col("resolution_status") == s)
    score = F.least(F.lit(1.0), (n("corroborated") + n("unresolved") * 0.3 + 1) / (F.count(F.lit(1)) + 2))
    return rounded(claims.groupingSets([["source_name", "topic"], ["source_name"]], "source_name", "topic").agg(F.count(F.lit(1)).alias("claims"), score.alias("score")), "score", places=6)


@query("C22_hotspot_map", "structured_v", "articles_v", sql="""WITH h AS (SELECT concat('incident-', country, '-', CAST(event_date AS VARCHAR)) AS hotspot, CAST(sum(1 + fatalities) AS DOUBLE) AS weight FROM structured_v GROUP BY country, event_date UNION ALL SELECT concat('story-', source, '-', topic), CAST(count(*) AS DOUBLE) FROM articles_v GROUP BY source, topic),
 t AS (SELECT * FROM h ORDER BY weight DESC, hotspot LIMIT 260) SELECT hotspot, weight, round(weight / sum(weight) OVER (), 6) AS share FROM t""")
def c22(structured, articles):
    from pyspark.sql import Window

    incidents = structured.groupBy(F.concat(F.lit("incident-"), "country", F.lit("-"), F.col("event_date").cast("string")).alias("hotspot")).agg(F.sum(F.col("fatalities") + 1).cast("double").alias("weight"))
    stories = articles.groupBy(F.concat(F.lit("story-"), "source", F.lit("-"), "topic").alias("hotspot")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    top = R.newest(incidents.unionByName(stories), 260, F.desc("weight"), F.col("hotspot"))
    return rounded(top.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy())), "share", places=6)


QUALITY = """CASE WHEN active THEN 3 ELSE 0 END + CASE WHEN region NOT IN ('global', 'united-states', 'europe') THEN 2 ELSE 0 END + CASE WHEN trust_tier = 'tier_2' THEN 1 ELSE 0 END + CASE WHEN length(t) BETWEEN 24 AND 180 THEN 2 ELSE 0 END + CASE WHEN d <> '' AND d <> t AND length(d) >= 48 THEN 2 ELSE 0 END + 2
 - CASE WHEN len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r]+'), lambda x: x <> '')) < 5 THEN 2 ELSE 0 END - CASE WHEN d = t AND length(d) < 80 THEN 2 ELSE 0 END"""
BATCH = f"b AS (SELECT *, quality >= 7 OR (active AND quality >= 5) OR (region NOT IN ('global', 'united-states', 'europe') AND quality >= 4) OR (language <> 'en' AND quality >= 5) AS promoted FROM (SELECT *, {QUALITY} AS quality FROM (SELECT *, trim(title) AS t, trim(description) AS d FROM articles_v) JOIN registry_v USING (source_domain)))"


def scored(articles, registry):
    rows = articles.join(registry.select("source_domain", "active", "region", "trust_tier"), "source_domain", "left")
    q = X.quality_score(F.col("title"), F.col("description"), F.col("published_at"), F.col("language"), F.col("source_domain"), F.coalesce("active", F.lit(False)), F.col("region"), F.col("trust_tier"), F.lit(0))
    rows = rows.withColumn("quality", q)
    return rows.withColumn("promoted", R.promoted(F.col("quality"), F.coalesce("active", F.lit(False)), F.col("region"), S.is_english("language")))


@query("C24_promote_reject", "articles_v", "registry_v", sql=f"WITH {BATCH} SELECT topic, promoted, count(*) AS n, CAST(min(quality) AS INT) AS low, CAST(max(quality) AS INT) AS high FROM b GROUP BY 1, 2")
def c24(articles, registry):
    """One scored table; the promoted rows go to K1, the rest to K3."""
    return scored(articles, registry).groupBy("topic", "promoted").agg(F.count(F.lit(1)).alias("n"), F.min("quality").alias("low"), F.max("quality").alias("high"))


@query("C25_global_batch", "articles_v", "registry_v", sql=f"WITH {BATCH} SELECT url, CASE WHEN language <> 'en' OR NOT promoted THEN 'summary' ELSE topic END AS route FROM b")
def c25(articles, registry):
    route = F.when(~S.is_english("language") | ~F.col("promoted"), "summary").otherwise(F.col("topic"))
    return scored(articles, registry).select("url", route.alias("route"))


@query("C27_headlines", "articles_v", "registry_v", sql=f"WITH {BATCH}, n AS (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY quality DESC, url) > 2 AS refill FROM b WHERE promoted) SELECT url, title, source, CAST(quality AS INT) AS score FROM n ORDER BY refill, quality DESC, url LIMIT 8")
def c27(articles, registry):
    return diversified(scored(articles, registry).filter("promoted").withColumn("score", F.col("quality")), 8, best_first=True).select("url", "title", "source", "score")


@query("C28_topic_briefing", "articles_v", "mentions_v", sql="WITH a AS (SELECT topic, title, row_number() OVER (PARTITION BY topic ORDER BY published_at DESC, url) AS n FROM articles_v), m AS (SELECT topic, entity, c, row_number() OVER (PARTITION BY topic ORDER BY c DESC, entity) AS n FROM (SELECT topic, entity, count(*) AS c FROM mentions_v GROUP BY 1, 2)) SELECT topic, concat('* ', title) AS line FROM a WHERE n <= 5 UNION ALL SELECT topic, concat('- ', entity, ' (', c, ')') FROM m WHERE n <= 6")
def c28(articles, mentions):
    """Headlines of a topic and its most named entities, as lines."""
    top = R.top_per(articles, ["topic"], 5, F.desc("published_at"), F.col("url")).select("topic", F.concat(F.lit("* "), "title").alias("line"))
    named = mentions.groupBy("topic", "entity").agg(F.count(F.lit(1)).alias("n"))
    named = R.top_per(named, ["topic"], 6, F.desc("n"), F.col("entity")).select("topic", F.format_string("- %s (%d)", "entity", "n").alias("line"))
    return top.unionByName(named)
