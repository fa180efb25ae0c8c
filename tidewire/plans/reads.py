"""Queries of filters and point reads (P1-P25, S3-S6 parts) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.operators import reads as R
from tidewire.plans.registry import query
from tidewire.plans.views import AS_OF

T = f"TIMESTAMP '{AS_OF}'"
#: a fetch queue made of the customers: state by segment, age by key
QUEUE = "SELECT concat('https://c.example/', c_custkey) AS url, CASE c_mktsegment WHEN 'BUILDING' THEN 'pending' WHEN 'MACHINERY' THEN 'retry' WHEN 'AUTOMOBILE' THEN 'failed' ELSE 'fetched' END AS fetch_status, CAST(c_acctbal AS DOUBLE) AS created_at, CAST(c_nationkey % 5 AS INT) AS attempt_count, CASE c_nationkey % 4 WHEN 0 THEN 'HTTP 503 from host' WHEN 1 THEN 'read timed out' WHEN 2 THEN 'HTTP 404' ELSE 'no parser' END AS error FROM customer"
#: translations of the German and French articles that came before the 15th
TRANSLATED = "SELECT url AS article_url, concat('T: ', title) AS translated_title, CAST(NULL AS VARCHAR) AS translated_description FROM articles_v WHERE language IN ('de', 'fr') AND published_at < TIMESTAMP '2024-01-15 00:00:00'"


def queue(customer):
    state = F.when(F.col("c_mktsegment") == "BUILDING", "pending").when(F.col("c_mktsegment") == "MACHINERY", "retry").when(F.col("c_mktsegment") == "AUTOMOBILE", "failed").otherwise("fetched")
    k = F.col("c_nationkey") % 4
    error = F.when(k == 0, "HTTP 503 from host").when(k == 1, "read timed out").when(k == 2, "HTTP 404").otherwise("no parser")
    return customer.select(F.concat(F.lit("https://c.example/"), "c_custkey").alias("url"), state.alias("fetch_status"), F.col("c_acctbal").alias("created_at"), (F.col("c_nationkey") % 5).cast("int").alias("attempt_count"), error.alias("error"))


def translated(articles):
    rows = articles.filter("language IN ('de', 'fr') AND published_at < TIMESTAMP '2024-01-15 00:00:00'")
    return rows.select(F.col("url").alias("article_url"), F.concat(F.lit("T: "), "title").alias("translated_title"), F.lit(None).cast("string").alias("translated_description"))


@query("P1_recent_articles", "articles_v", sql=f"WITH tr AS ({TRANSLATED}), a AS (SELECT * FROM articles_v WHERE published_at >= {T} - INTERVAL 720 HOUR AND topic = 'economics' ORDER BY published_at DESC, url LIMIT 60) SELECT a.url, coalesce(translated_title, title) AS title, description, source, source_domain, language, published_at, topic FROM a LEFT JOIN tr ON tr.article_url = a.url")
def p1(articles):
    return R.recent_articles(articles, translated(articles), AS_OF, 720, "economics")


@query("P2_headline_tier", "events", sql="SELECT event_id, coalesce(json_extract_string(props, '$.analytic_tier'), '') IN ('', 'headline') AS headline FROM events")
def p2(events):
    return events.select("event_id", R.headline_tier("props").alias("headline"))


@query("P3_recent_events", "structured_v", sql="WITH e AS (SELECT * FROM structured_v WHERE dataset = 'acled'), w AS (SELECT CASE WHEN count(*) FILTER (WHERE event_date >= DATE '2024-05-25') > 0 THEN DATE '2024-05-25' ELSE max(event_date) - 6 END AS s FROM e) SELECT event_id, event_date, country, event_type, fatalities FROM e, w WHERE event_date >= s ORDER BY event_date DESC, fatalities DESC, event_id LIMIT 3000")
def p3(structured):
    """The window is empty, so it is anchored at the newest event."""
    return R.recent_events(structured, "2024-06-01 00:00:00", 7, dataset="acled").select("event_id", "event_date", "country", "event_type", "fatalities")


@query("P4_ids_in_range", "structured_v", sql="SELECT event_id FROM structured_v WHERE event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' ORDER BY event_date DESC, event_id LIMIT 300")
def p4(structured):
    return R.between(structured, "2024-01-10", "2024-01-12")


@query("P5_by_ids", "structured_v", "lineitem", sql="SELECT event_id, latitude, longitude FROM structured_v WHERE event_id IN (SELECT l_orderkey FROM lineitem)")
def p5(structured, lineitem):
    return R.by_ids(structured, lineitem.select(F.col("l_orderkey").alias("event_id")), "event_id").select("event_id", "latitude", "longitude")


@query("P6_by_urls", "articles_v", sql="SELECT u AS asked, hit, url, title FROM (SELECT CASE WHEN language = 'en' THEN url ELSE concat(url, '/?utm=1') END AS u, CASE WHEN language = 'en' THEN 0 ELSE 1 END AS hit, url, title FROM articles_v)")
def p6(articles):
    asked = F.when(F.col("language") == "en", F.col("url")).otherwise(F.concat("url", F.lit("/?utm=1")))
    return R.by_urls(articles, articles.select(asked.alias("url"))).select("asked", "hit", "url", "title")


@query("P7_top_events", "structured_v", sql="SELECT event_id, country, fatalities, event_date FROM structured_v WHERE event_type = 'Battles' ORDER BY fatalities DESC, event_date DESC, event_id LIMIT 40")
def p7(structured):
    rows = structured.filter("event_type = 'Battles'").select("event_id", "country", "fatalities", "event_date")
    return R.newest(rows, 40, F.desc("fatalities"), F.desc("event_date"), F.col("event_id"))


@query("P8_best_reliability_first", "supplier", sql="SELECT s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS place FROM supplier")
def p8(supplier):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey")
    return supplier.select("s_suppkey", "s_acctbal", F.row_number().over(w).alias("place"))


@query("P9_queue_batch", "customer", sql=f"SELECT url, fetch_status, created_at, attempt_count, error FROM ({QUEUE}) WHERE fetch_status IN ('retry', 'pending') ORDER BY CASE fetch_status WHEN 'retry' THEN 0 ELSE 1 END, created_at, url LIMIT 50")
def p9(customer):
    return R.queue_batch(queue(customer), 50, {"retry": 0, "pending": 1})


@query("P10_retryable", "customer", sql=f"SELECT url, CASE WHEN regexp_extract(error, '\\b([1-5]\\d\\d)\\b', 1) <> '' THEN regexp_extract(error, '\\b([1-5]\\d\\d)\\b', 1) IN ('408','425','429','500','502','503','504') ELSE regexp_matches(lower(error), 'timeout|timed out|temporarily') END AS retryable FROM ({QUEUE})")
def p10(customer):
    return queue(customer).select("url", R.retryable("error").alias("retryable"))


@query("P11_promotion", "articles_v", "registry_v", sql="SELECT url, (length(title) % 10 >= 7) OR (active AND length(title) % 10 >= 5) OR (region NOT IN ('global', 'united-states', 'europe') AND length(title) % 10 >= 4) OR (language <> 'en' AND length(title) % 10 >= 5) AS promoted FROM articles_v JOIN registry_v USING (source_domain)")
def p11(articles, registry):
    rows = articles.join(registry.select("source_domain", "region", "active"), "source_domain")
    return rows.select("url", R.promoted(F.length("title") % 10, F.col("active"), F.col("region"), S.is_english("language")).alias("promoted"))


@query("P13_clusters_by_topic", "claims_v", sql="SELECT event_key, topic, count(*) AS members, max(published_at) AS latest FROM claims_v WHERE topic = 'economics' GROUP BY event_key, topic ORDER BY members DESC, event_key LIMIT 40")
def p13(claims):
    rows = claims.filter("topic = 'economics'").groupBy("event_key", "topic").agg(F.count(F.lit(1)).alias("members"), F.max("published_at").alias("latest"))
    return R.newest(rows, 40, F.desc("members"), F.col("event_key"))


@query("P14_newest_per_key", "orders", sql="SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def p14(orders):
    return R.latest(orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("P15_registry_listing", "registry_v", sql="SELECT source_name, trust_tier, source_type, region FROM registry_v WHERE active AND source_type = 'news'")
def p15(registry):
    return registry.filter("active AND source_type = 'news'").select("source_name", "trust_tier", "source_type", "region").orderBy("trust_tier", "source_name")


@query("P16_recent_disputes", "disputes_v", sql="SELECT event_key, contradiction_count FROM disputes_v WHERE generated_on >= DATE '2024-01-20' AND contradiction_count > 0")
def p16(disputes):
    return disputes.filter("generated_on >= DATE '2024-01-20' AND contradiction_count > 0").select("event_key", "contradiction_count")


@query("P17_subject_mentions", "articles_v", sql="SELECT url, contains(lower(concat(title, ' ', description)), 'that with') OR CAST(contains(lower(concat(title, ' ', description)), 'that') AS INT) + CAST(contains(lower(concat(title, ' ', description)), 'with') AS INT) >= 2 AS about FROM articles_v")
def p17(articles):
    return articles.select("url", R.mentions_subject(F.concat_ws(" ", "title", "description"), "that with").alias("about"))


@query("P18_inside_window", "articles_v", sql="SELECT url FROM articles_v WHERE published_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00'")
def p18(articles):
    return articles.filter("published_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00'").select("url")


@query("P19_translation_backlog", "articles_v", sql=f"WITH tr AS ({TRANSLATED}) SELECT url, length(title) % 12 AS priority FROM articles_v WHERE language <> 'en' AND url NOT IN (SELECT article_url FROM tr) AND length(title) % 12 >= 7 ORDER BY priority DESC, published_at DESC, url LIMIT 24")
def p19(articles):
    return R.translation_backlog(articles, translated(articles), F.length("title") % 12).select("url", "priority")


@query("P20_story_regions", "articles_v", "registry_v", sql="SELECT DISTINCT region FROM articles_v JOIN registry_v USING (source_domain)")
def p20(articles, registry):
    return articles.join(registry.select("source_domain", "region"), "source_domain").select("region").distinct()


@query("P21_subject_signals", "framing_v", sql="SELECT article_url, dominant_frame, published_at FROM framing_v WHERE subject_key = 'NATION_7' ORDER BY published_at, article_url LIMIT 500")
def p21(framing):
    rows = framing.filter("subject_key = 'NATION_7'").select("article_url", "dominant_frame", "published_at")
    return R.newest(rows, 500, F.col("published_at"), F.col("article_url"))


@query("P22_queue_mix", "customer", sql=f"SELECT * FROM (SELECT url, fetch_status FROM ({QUEUE}) WHERE fetch_status = 'pending' ORDER BY created_at, url LIMIT 80) UNION ALL SELECT * FROM (SELECT url, fetch_status FROM ({QUEUE}) WHERE fetch_status = 'retry' ORDER BY created_at, url LIMIT 100 - least(80, (SELECT count(*) FROM ({QUEUE}) WHERE fetch_status = 'pending')))")
def p22(customer):
    return R.queue_mix(queue(customer), 100).select("url", "fetch_status")


@query("P25_next_status", "customer", sql=f"SELECT url, CASE WHEN attempt_count < 3 AND (contains(error, '503') OR contains(error, 'timed out')) THEN 'retry' ELSE 'failed' END AS next_status FROM ({QUEUE})")
def p25(customer):
    q = queue(customer)
    return q.select("url", R.next_status(F.lit(0), F.col("attempt_count"), F.col("error"), F.lit(0)).alias("next_status"))
