"""Queries of aggregations (A1-A10, A20-A50) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.operators import aggregates as A
from tidewire.operators import reads as R
from tidewire.plans.indices import MENTIONS_AS_OF, SPIKE, TM, rounded
from tidewire.plans.registry import query

PAIRS = "m AS (SELECT DISTINCT topic, article_url, entity FROM mentions_v), p AS (SELECT a.entity AS entity_a, b.entity AS entity_b, a.article_url FROM m a JOIN m b ON a.topic = b.topic AND a.article_url = b.article_url AND a.entity < b.entity)"


@query("A1_article_count", "articles_v", sql="SELECT topic, count(DISTINCT url) AS articles FROM articles_v WHERE published_at >= TIMESTAMP '2024-01-08 00:00:00' GROUP BY topic")
def a1(articles):
    return articles.filter("published_at >= TIMESTAMP '2024-01-08 00:00:00'").groupBy("topic").agg(F.countDistinct("url").alias("articles"))


@query("A2_time_bounds", "articles_v", sql="SELECT topic, min(published_at) AS first_at, max(published_at) AS last_at FROM articles_v GROUP BY topic")
def a2(articles):
    return articles.groupBy("topic").agg(F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


@query("A3_source_leaderboard", "articles_v", sql="SELECT source, source_domain, count(*) AS articles, max(published_at) AS latest FROM articles_v GROUP BY 1, 2 ORDER BY articles DESC, source LIMIT 12")
def a3(articles):
    rows = articles.groupBy("source", "source_domain").agg(F.count(F.lit(1)).alias("articles"), F.max("published_at").alias("latest"))
    return R.newest(rows, 12, F.desc("articles"), F.col("source"))


@query("A4_warehouse_counts", "documents", "events", "orders", "lineitem", "conversations", sql=" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "events", "orders", "lineitem", "conversations")))
def a4(*tables):
    out = None
    for name, t in zip(("documents", "events", "orders", "lineitem", "conversations"), tables, strict=True):
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("A5_latest_run", "orders", sql="SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS runs FROM orders GROUP BY o_custkey")
def a5(orders):
    return orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.count(F.lit(1)).alias("runs"))


@query("A6_latest_reliability", "lineitem", sql="SELECT l_suppkey, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS score, max(l_shipdate) AS at FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY l_suppkey")
def a6(lineitem):
    rows = lineitem.filter("l_shipdate >= TIMESTAMP '1995-01-01'")
    return rows.groupBy("l_suppkey").agg(F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("score"), F.max("l_shipdate").alias("at"))


@query("A7_entity_spikes", "mentions_v", sql=f"WITH {SPIKE} SELECT entity, entity_type, recent AS recent_mentions, base AS baseline_mentions, round(spike_ratio, 4) AS spike_ratio, CASE WHEN base = 0 THEN 'NEW' WHEN spike_ratio > 1.5 THEN 'RISING' WHEN spike_ratio < 0.5 THEN 'FALLING' ELSE 'STABLE' END AS trend FROM spikes WHERE spike_ratio >= CASE WHEN entity IN ('E1', 'E2') THEN 3.0 ELSE 1.0 END ORDER BY spikes.spike_ratio DESC, entity LIMIT 20")
def a7(mentions):
    return rounded(A.entity_spikes(mentions, MENTIONS_AS_OF, threshold=1.0, common=["e1", "e2"]), "spike_ratio")


@query("A8_top_entities", "mentions_v", sql=f"SELECT entity, min(entity_type) AS entity_type, count(*) AS mentions FROM mentions_v WHERE mentioned_at > {TM} - INTERVAL 7 DAY GROUP BY entity ORDER BY mentions DESC, entity LIMIT 10")
def a8(mentions):
    return A.top_entities(mentions, MENTIONS_AS_OF)


@query("A9_co_mentions", "mentions_v", sql=f"WITH {PAIRS} SELECT CASE WHEN entity_a = 'E7' THEN entity_b ELSE entity_a END AS entity, count(*) AS weight FROM p WHERE entity_a = 'E7' OR entity_b = 'E7' GROUP BY 1 ORDER BY weight DESC, entity LIMIT 10")
def a9(mentions):
    return A.co_mentions(A.cooccurrences(mentions), "E7")


@query("A10_graph_edges", "mentions_v", sql=f"WITH {PAIRS} SELECT entity_a, entity_b, count(*) AS weight FROM p GROUP BY 1, 2 HAVING count(*) >= 2")
def a10(mentions):
    return A.graph_edges(A.cooccurrences(mentions))


@query("A20_cluster_rollup", "structured_v", sql="SELECT country, event_type, count(*) AS events, CAST(sum(fatalities) AS BIGINT) AS fatalities, min(event_date) AS first_date, max(event_date) AS last_date, count(DISTINCT actor_primary) AS actors FROM structured_v GROUP BY 1, 2")
def a20(structured):
    return structured.groupBy("country", "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("fatalities").alias("fatalities"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"), F.countDistinct("actor_primary").alias("actors"))


@query("A21_article_rollup", "articles_v", "registry_v", sql="SELECT topic, language, count(*) AS articles, count(DISTINCT source) AS sources, count(*) FILTER (WHERE trust_tier = 'tier_1') AS tier_1, count(*) FILTER (WHERE source_type = 'wire') AS wires, max(published_at) AS latest FROM articles_v JOIN registry_v USING (source_domain) GROUP BY 1, 2")
def a21(articles, registry):
    rows = articles.join(registry.select("source_domain", "trust_tier", "source_type"), "source_domain")
    return rows.groupBy("topic", "language").agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"), F.count_if(F.col("trust_tier") == "tier_1").alias("tier_1"), F.count_if(F.col("source_type") == "wire").alias("wires"), F.max("published_at").alias("latest"))


@query("A22_cohesion", "lineitem", sql="SELECT l_orderkey, round(avg(l_discount), 6) AS mean, median(l_discount) AS median, min(l_discount) AS low, max(l_discount) AS high, count(*) FILTER (WHERE l_discount < 0.038) / count(*) AS outlier_ratio FROM lineitem GROUP BY l_orderkey")
def a22(lineitem):
    """Mean, median, extremes and share of low scores over the scored pairs of each cluster."""
    d = F.col("l_discount")
    return rounded(lineitem.groupBy("l_orderkey").agg(F.avg(d).alias("mean"), F.median(d).alias("median"), F.min(d).alias("low"), F.max(d).alias("high"), (F.count_if(d < 0.038) / F.count(F.lit(1))).alias("outlier_ratio")), "mean", places=6)


RELIABLE = "least(1.0, (count(*) FILTER (WHERE resolution_status = 'corroborated') + 0.3 * count(*) FILTER (WHERE resolution_status = 'unresolved') + 1) / (count(*) + 2))"


@query("A23_source_reliability", "claims_v", sql=f"SELECT source_name, count(*) FILTER (WHERE resolution_status = 'corroborated') AS corroborated, count(*) FILTER (WHERE resolution_status = 'contradicted') AS contradicted, count(*) AS claims, round({RELIABLE}, 6) AS score, round(0.65 + 0.9 * {RELIABLE}, 6) AS multiplier FROM claims_v GROUP BY source_name")
def a23(claims):
    return rounded(A.source_rows(claims), "score", "multiplier", places=6).select("source_name", "corroborated", "contradicted", "claims", "score", "multiplier")


@query("A24_claim_breakdowns", "claims_v", sql="SELECT topic, claim_type, resolution_status, count(*) AS n FROM claims_v GROUP BY GROUPING SETS ((topic, resolution_status), (claim_type, resolution_status))")
def a24(claims):
    return claims.groupingSets([["topic", "resolution_status"], ["claim_type", "resolution_status"]], "topic", "claim_type", "resolution_status").agg(F.count(F.lit(1)).alias("n"))


@query("A25_merged_breakdowns", "claims_v", sql="SELECT source_name, topic, resolution_status AS status, count(*) AS n FROM claims_v GROUP BY 1, 2, 3")
def a25(claims):
    """Stored per-source maps of status to count, exploded and merged."""
    by = claims.groupBy("source_name", "topic", "resolution_status").agg(F.count(F.lit(1)).alias("n"))
    stored = by.groupBy("source_name", "topic").agg(F.map_from_entries(F.collect_list(F.struct("resolution_status", "n"))).alias("counts"))
    return stored.select("source_name", "topic", F.explode("counts").alias("status", "n")).groupBy("source_name", "topic", "status").agg(F.sum("n").alias("n"))


@query("A26_weighted_median", "claims_v", sql="WITH v AS (SELECT event_key, claim_value, sum(l_linenumber) AS w FROM claims_v GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY event_key ORDER BY claim_value) AS upto, sum(w) OVER (PARTITION BY event_key) AS total FROM v) SELECT event_key, min(claim_value) AS median FROM r WHERE upto * 2 >= total GROUP BY event_key")
def a26(claims):
    return A.weighted_median(claims, "event_key", "claim_value", "l_linenumber")


@query("A26_weighted_vote", "claims_v", sql="WITH v AS (SELECT event_key, claim_type, sum(l_linenumber) AS w FROM claims_v GROUP BY 1, 2) SELECT event_key, arg_min(claim_type, (-w, claim_type)) AS winner, CAST(sum(w) AS BIGINT) AS total_weight FROM v GROUP BY event_key")
def a26b(claims):
    return A.vote(claims, "event_key", "claim_type", "l_linenumber")


@query("A27_frame_shares", "framing_v", sql="SELECT subject_key, dominant_frame, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY subject_key), 6) AS share FROM framing_v GROUP BY 1, 2")
def a27(framing):
    return rounded(A.frame_shares(framing, "subject_key"), "share", places=6)


@query("A28_weekly_frames", "framing_v", sql="SELECT concat(isoyear(published_at), '-W', lpad(CAST(week(published_at) AS VARCHAR), 2, '0')) AS week, dominant_frame, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY concat(isoyear(published_at), '-W', lpad(CAST(week(published_at) AS VARCHAR), 2, '0'))), 6) AS share FROM framing_v GROUP BY 1, 2")
def a28(framing):
    return rounded(A.frame_shares(framing.withColumn("week", S.week_label("published_at")), "week"), "share", places=6)


@query("A29_source_frames", "framing_v", sql="SELECT source, count(*) AS n, count(*) FILTER (WHERE dominant_frame = 'security') AS security, count(DISTINCT subject_key) AS subjects FROM framing_v GROUP BY source ORDER BY n DESC, source LIMIT 12")
def a29(framing):
    rows = framing.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dominant_frame") == "security").alias("security"), F.countDistinct("subject_key").alias("subjects"))
    return R.newest(rows, 12, F.desc("n"), F.col("source"))


@query("A30_ledger_counts", "orders", sql="SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a30(orders):
    return orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("A31_first_seen", "claims_v", sql="SELECT event_key, min(published_at) AS first_at, arg_min(source_name, (published_at, source_name)) AS first_source, min(published_at) FILTER (WHERE topic = 'geopolitics') AS first_major_at, count(DISTINCT source_name) AS sources FROM claims_v GROUP BY event_key")
def a31(claims):
    return claims.groupBy("event_key").agg(F.min("published_at").alias("first_at"), F.min_by("source_name", F.struct("published_at", "source_name")).alias("first_source"), F.min(F.when(F.col("topic") == "geopolitics", F.col("published_at"))).alias("first_major_at"), F.countDistinct("source_name").alias("sources"))


@query("A32_weighted_centroid", "structured_v", sql="SELECT country, round(sum(latitude * (1 + fatalities)) / sum(1 + fatalities), 6) AS latitude, round(sum(longitude * (1 + fatalities)) / sum(1 + fatalities), 6) AS longitude, CAST(sum(1 + fatalities) AS BIGINT) AS weight FROM structured_v GROUP BY country")
def a32(structured):
    return rounded(A.centroid(structured, "country", F.lit(1) + F.col("fatalities")), "latitude", "longitude", places=6)


@query("A33_grid_rollup", "structured_v", sql="SELECT CAST(floor(latitude * 10) AS BIGINT) AS cell_lat, CAST(floor(longitude * 10) AS BIGINT) AS cell_lon, event_type, country, count(*) AS events, CAST(sum(fatalities) AS BIGINT) AS fatalities, max(event_date) AS latest FROM structured_v GROUP BY 1, 2, 3, 4")
def a33(structured):
    return A.grid(structured)


@query("A34_hotspot_shares", "structured_v", sql="WITH g AS (SELECT country, CAST(sum(fatalities) AS BIGINT) AS weight FROM structured_v GROUP BY 1) SELECT country, weight, round(weight / sum(weight) OVER (), 6) AS share, round((weight - min(weight) OVER ()) / nullif(max(weight) OVER () - min(weight) OVER (), 0), 6) AS scaled FROM g")
def a34(structured):
    from pyspark.sql import Window

    g = structured.groupBy("country").agg(F.sum("fatalities").alias("weight"))
    w = Window.partitionBy()  # one row for each country
    low, high = F.min("weight").over(w), F.max("weight").over(w)
    return rounded(g.select("country", "weight", (F.col("weight") / F.sum("weight").over(w)).alias("share"), F.try_divide(F.col("weight") - low, high - low).alias("scaled")), "share", "scaled", places=6)


@query("A35_modal_type", "structured_v", sql="WITH g AS (SELECT country, event_type, count(*) AS n FROM structured_v GROUP BY 1, 2) SELECT country, arg_max(event_type, (n, event_type)) AS mode, max(n) AS n FROM g GROUP BY country")
def a35(structured):
    return A.modal(structured, "country", "event_type")


@query("A36_best_point", "structured_v", sql="SELECT country, event_date, arg_min(latitude, (CASE dataset WHEN 'acled' THEN 0 ELSE 1 END, event_id)) AS latitude, arg_min(longitude, (CASE dataset WHEN 'acled' THEN 0 ELSE 1 END, event_id)) AS longitude FROM structured_v GROUP BY 1, 2")
def a36(structured):
    order = F.struct(F.when(F.col("dataset") == "acled", 0).otherwise(1), F.col("event_id"))
    best = structured.groupBy("country", "event_date").agg(F.min_by(F.struct("latitude", "longitude"), order).alias("p"))
    return best.select("country", "event_date", "p.latitude", "p.longitude")


LABELLED = "SELECT CAST(doc_id % 50 AS BIGINT) AS event_id, CAST(doc_id % 3 AS BIGINT) AS annotator_id, quality AS label, doc_id AS annotated_at FROM labels"


def labelled(labels):
    return labels.select((F.col("doc_id") % 50).alias("event_id"), (F.col("doc_id") % 3).alias("annotator_id"), F.col("quality").alias("label"), F.col("doc_id").alias("annotated_at"))


@query("A37_annotator_agreement", "labels", sql=f"WITH l AS (SELECT event_id, annotator_id, arg_max(label, (annotated_at, label)) AS label FROM ({LABELLED}) GROUP BY 1, 2), n AS (SELECT event_id, label, count(*) AS n FROM l GROUP BY 1, 2) SELECT event_id, round(max(n) / sum(n), 6) AS agreement, CAST(sum(n) AS BIGINT) AS annotators FROM n GROUP BY event_id")
def a37(labels):
    return rounded(A.agreement(labelled(labels)), "agreement", places=6)


@query("A38_label_summary", "labels", sql="SELECT quality, count(*) AS n, count(DISTINCT doc_id) AS documents, round(avg(toxic), 6) AS toxic_rate FROM labels GROUP BY quality")
def a38(labels):
    return rounded(labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"), F.avg("toxic").alias("toxic_rate")), "toxic_rate", places=6)


@query("A39_cohesion_metrics", "lineitem", sql="SELECT l_returnflag AS topic, count(*) AS n, round(avg(l_quantity), 4) AS mean, median(l_quantity) AS median, quantile_cont(l_quantity, 0.75) AS p75, quantile_cont(l_quantity, 0.9) AS p90, round(count(*) FILTER (WHERE l_discount >= 0.08) / count(*), 6) AS high_rate FROM lineitem GROUP BY 1")
def a39(lineitem):
    q = F.col("l_quantity")
    by = lineitem.groupBy(F.col("l_returnflag").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.avg(q).alias("mean"), F.median(q).alias("median"), F.percentile(q, F.lit(0.75)).alias("p75"), F.percentile(q, F.lit(0.9)).alias("p90"), (F.count_if(F.col("l_discount") >= 0.08) / F.count(F.lit(1))).alias("high_rate"))
    return rounded(rounded(by, "mean"), "high_rate", places=6)


@query("A40_pairwise_quality", "orders", sql="""WITH b AS (SELECT o_custkey AS p, o_orderdate AS e FROM orders), f AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM b GROUP BY p, e)) AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM b GROUP BY p)) AS pp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM b GROUP BY e)) AS ep)
 SELECT round(tp / pp, 8) AS "precision", round(tp / ep, 8) AS recall, round(2 * (tp / pp) * (tp / ep) / (tp / pp + tp / ep), 8) AS f1 FROM f""")
def a40(orders):
    item = F.col("o_orderkey").alias("item")
    return rounded(A.pairwise_quality(orders.select(item, F.col("o_custkey").alias("cluster")), orders.select(item, F.col("o_orderdate").alias("cluster"))), "precision", "recall", "f1", places=8)


@query("A41_frame_distribution", "framing_v", sql="SELECT subject_key, arg_max(dominant_frame, (n, dominant_frame)) AS frame, max(n) AS agreeing, CAST(sum(n) - max(n) AS BIGINT) AS dissenting FROM (SELECT subject_key, dominant_frame, count(*) AS n FROM framing_v GROUP BY 1, 2) GROUP BY subject_key")
def a41(framing):
    by = framing.groupBy("subject_key", "dominant_frame").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("subject_key").agg(F.max_by("dominant_frame", F.struct("n", "dominant_frame")).alias("frame"), F.max("n").alias("agreeing"), (F.sum("n") - F.max("n")).alias("dissenting"))


@query("A42_language_telemetry", "articles_v", sql="SELECT language, topic, count(*) AS n FROM articles_v GROUP BY ROLLUP (language, topic)")
def a42(articles):
    return articles.rollup("language", "topic").agg(F.count(F.lit(1)).alias("n"))


@query("A43_topic_summary", "articles_v", sql="SELECT topic, count(*) FILTER (WHERE published_at >= TIMESTAMP '2024-01-20') AS recent, arg_max(url, (published_at, url)) AS newest FROM articles_v GROUP BY topic")
def a43(articles):
    return articles.groupBy("topic").agg(F.count_if(F.col("published_at") >= F.lit("2024-01-20").cast("timestamp")).alias("recent"), F.max_by("url", F.struct("published_at", "url")).alias("newest"))


@query("A44_consensus_counters", "articles_v", sql="SELECT source, word, count(*) AS n FROM (SELECT source, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z]{4,}'))) AS word FROM articles_v) GROUP BY 1, 2")
def a44(articles):
    return articles.select("source", F.explode(S.words("title")).alias("word")).groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))


@query("A45_briefing_headlines", "articles_v", sql="SELECT topic, url, title FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY length(description) DESC, published_at DESC, url) AS n FROM articles_v) WHERE n <= 12")
def a45(articles):
    return R.top_per(articles, ["topic"], 12, F.desc(F.length("description")), F.desc("published_at"), F.col("url")).select("topic", "url", "title")


@query("A46_latest_telemetry", "orders", sql="SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS at FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def a46(orders):
    return orders.filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("at"))
