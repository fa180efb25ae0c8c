"""Queries of windows, sorts and top-k (W1-W16) with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import reads as R
from tidewire.plans.registry import query


@query("W1_top_evidence", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 3")
def w1(lineitem):
    return R.top_per(lineitem, ["l_orderkey"], 3, F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_extendedprice")


HALVES = "h AS (SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY published_at, article_url) <= greatest(1, count(*) OVER (PARTITION BY subject_key) // 2) AS early FROM framing_v)"


def halves(framing):
    """Early and recent halves of each subject's signals."""
    w = Window.partitionBy("subject_key")
    place = F.row_number().over(w.orderBy("published_at", "article_url"))
    return framing.withColumn("early", place <= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 2)))


@query("W2_halves", "framing_v", sql=f"WITH {HALVES} SELECT article_url, subject_key, early FROM h")
def w2(framing):
    return halves(framing).select("article_url", "subject_key", "early")


@query("W3_share_shifts", "framing_v", sql=f"WITH {HALVES}, n AS (SELECT subject_key, dominant_frame, count(*) FILTER (WHERE early) AS a, count(*) FILTER (WHERE NOT early) AS b FROM h GROUP BY 1, 2), s AS (SELECT subject_key, dominant_frame, coalesce(a / nullif(sum(a) OVER w, 0), 0) AS x, coalesce(b / nullif(sum(b) OVER w, 0), 0) AS y FROM n WINDOW w AS (PARTITION BY subject_key)) SELECT subject_key, dominant_frame, round(y - x, 6) AS shift FROM s WHERE abs(round(y - x, 9)) >= 0.12")
def w3(framing):
    by = halves(framing).groupBy("subject_key", "dominant_frame").agg(F.count_if("early").alias("a"), F.count_if(~F.col("early")).alias("b"))
    w = Window.partitionBy("subject_key")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(w)), F.lit(0.0))
    shift = by.withColumn("shift", share("b") - share("a")).filter(F.abs(F.round("shift", 9)) >= 0.12)
    return shift.select("subject_key", "dominant_frame", F.round("shift", 6).alias("shift"))


@query("W5_growth", "structured_v", sql="WITH d AS (SELECT country, event_date, count(*) AS n FROM structured_v GROUP BY 1, 2) SELECT country, event_date, n, n - lag(n) OVER (PARTITION BY country ORDER BY event_date) AS growth FROM d")
def w5(structured):
    daily = structured.groupBy("country", "event_date").agg(F.count(F.lit(1)).alias("n"))
    return daily.withColumn("growth", F.col("n") - F.lag("n").over(Window.partitionBy("country").orderBy("event_date")))


@query("W6_best_window_row", "orders", sql="SELECT o_custkey, arg_min(o_orderkey, (abs(o_totalprice - 150000), -epoch_us(o_orderdate), o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def w6(orders):
    order = F.struct(F.abs(F.col("o_totalprice") - 150000), -F.unix_micros("o_orderdate"), F.col("o_orderkey"))
    return orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("o_orderkey"))


def diversified(articles, page: int, cap: int = 2, best_first: bool = False):
    """At most ``cap`` rows of a domain first, the rest as refill, ``page`` rows in all.

    The reference's order, worst first, is the default; ``best_first`` turns it.
    """
    score = F.col("score") if not best_first else -F.col("score")
    per = Window.partitionBy("source_domain").orderBy(score, "url")
    return R.newest(articles.withColumn("refill", F.row_number().over(per) > cap), page, F.col("refill"), score, F.col("url"))


@query("W7_domain_cap", "articles_v", sql="SELECT url, refill FROM (SELECT url, length(title) AS score, row_number() OVER (PARTITION BY source_domain ORDER BY length(title), url) > 2 AS refill FROM articles_v) ORDER BY refill, score, url LIMIT 60")
def w7(articles):
    return diversified(articles.withColumn("score", F.length("title")), 60).select("url", "refill")


@query("W8_event_order", "structured_v", sql="SELECT country, row_number() OVER (ORDER BY count(*) DESC, sum(fatalities) DESC, country) AS place FROM structured_v GROUP BY country")
def w8(structured):
    by = structured.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum("fatalities").alias("f"))
    return by.select("country", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("f"), "country")).alias("place"))  # one row for each country


@query("W9_analysis_priority", "claims_v", sql="SELECT event_key, count(*) AS sources, count(*) FILTER (WHERE resolution_status = 'contradicted') * 3 + count(DISTINCT source_name) * 2 + count(*) AS priority FROM claims_v GROUP BY event_key ORDER BY priority DESC, event_key LIMIT 100")
def w9(claims):
    by = claims.groupBy("event_key").agg(F.count(F.lit(1)).alias("sources"), (F.count_if(F.col("resolution_status") == "contradicted") * 3 + F.countDistinct("source_name") * 2 + F.count(F.lit(1))).alias("priority"))
    return R.newest(by, 100, F.desc("priority"), F.col("event_key"))


@query("W10_recent_block_first", "articles_v", sql="SELECT url, published_at >= TIMESTAMP '2024-01-15' AS recent FROM articles_v ORDER BY recent DESC, length(title) DESC, published_at DESC, url LIMIT 12")
def w10(articles):
    rows = articles.withColumn("recent", F.col("published_at") >= F.lit("2024-01-15").cast("timestamp"))
    return R.newest(rows, 12, F.desc("recent"), F.desc(F.length("title")), F.desc("published_at"), F.col("url")).select("url", "recent")


@query("W11_hotspot_merge", "structured_v", "articles_v", sql="SELECT kind, id FROM (SELECT 'incident' AS kind, CAST(event_id AS VARCHAR) AS id, CAST(fatalities AS BIGINT) AS w FROM structured_v UNION ALL SELECT 'story', url, length(title) FROM articles_v) ORDER BY w DESC, id LIMIT 180")
def w11(structured, articles):
    a = structured.select(F.lit("incident").alias("kind"), F.col("event_id").cast("string").alias("id"), F.col("fatalities").cast("bigint").alias("w"))
    b = articles.select(F.lit("story").alias("kind"), F.col("url").alias("id"), F.length("title").cast("bigint").alias("w"))
    return R.newest(a.unionByName(b), 180, F.desc("w"), F.col("id")).select("kind", "id")


@query("W12_lead_time", "claims_v", sql="WITH f AS (SELECT event_key, min(published_at) AS first_at, min(published_at) FILTER (WHERE topic = 'geopolitics') AS major_at FROM claims_v GROUP BY 1) SELECT event_key, (epoch_us(major_at) - epoch_us(first_at)) // 3600000000 AS lead_hours FROM f WHERE epoch_us(major_at) - epoch_us(first_at) >= 4 * 3600000000 ORDER BY lead_hours DESC, event_key LIMIT 100")
def w12(claims):
    f = claims.groupBy("event_key").agg(F.min("published_at").alias("a"), F.min(F.when(F.col("topic") == "geopolitics", F.col("published_at"))).alias("b"))
    gap = F.unix_micros("b") - F.unix_micros("a")
    return R.newest(f.filter(gap >= 4 * 3_600_000_000).select("event_key", F.expr("(unix_micros(b) - unix_micros(a)) div 3600000000").alias("lead_hours")), 100, F.desc("lead_hours"), F.col("event_key"))


@query("W13_keyword_search", "articles_v", sql="SELECT url, CAST(contains(lower(concat(title, ' ', description)), 'tion') AS INT) + CAST(contains(lower(concat(title, ' ', description)), 'with') AS INT) AS hits FROM articles_v WHERE hits > 0 ORDER BY hits DESC, published_at DESC, url LIMIT 12")
def w13(articles):
    text = F.lower(F.concat_ws(" ", "title", "description"))
    hits = sum((F.contains(text, F.lit(t)).cast("int") for t in ("tion", "with")), F.lit(0))
    return R.newest(articles.withColumn("hits", hits).filter("hits > 0"), 12, F.desc("hits"), F.desc("published_at"), F.col("url")).select("url", "hits")


@query("W14_timeline", "articles_v", sql="SELECT url, published_at FROM articles_v WHERE topic = 'economics' ORDER BY published_at, url LIMIT 10")
def w14(articles):
    return R.newest(articles.filter("topic = 'economics'").select("url", "published_at"), 10, F.col("published_at"), F.col("url"))


@query("W15_seeded_sample", "labels", sql="SELECT doc_id, quality, toxic FROM labels ORDER BY md5(concat(doc_id, '-7')), doc_id LIMIT 50")
def w15(labels):
    """A sample that any partitioning repeats: the smallest hashes of id and seed."""
    return R.newest(labels, 50, F.md5(F.concat_ws("-", "doc_id", F.lit("7"))), F.col("doc_id"))


@query("W16_stratified_pairs", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_discount, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5(concat(l_orderkey, '-', l_linenumber)), l_orderkey, l_linenumber) AS n FROM (SELECT *, CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'middle' ELSE 'high' END AS band FROM lineitem)) WHERE n <= CASE band WHEN 'low' THEN 80 WHEN 'middle' THEN 70 ELSE 50 END")
def w16(lineitem):
    """40, 35 and 25 % of a sample of 200 pairs by bands of their score."""
    band = F.when(F.col("l_discount") < 0.03, "low").when(F.col("l_discount") < 0.07, "middle").otherwise("high")
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_discount", band.alias("band"))
    w = Window.partitionBy("band").orderBy(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")), "l_orderkey", "l_linenumber")
    share = F.when(F.col("band") == "low", 80).when(F.col("band") == "middle", 70).otherwise(50)
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= share).drop("n")
