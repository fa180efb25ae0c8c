"""Queries of set operations (U1-U8) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import reads as R
from tidewire.plans.registry import query


@query("U1_first_per_url", "pages", sql="SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def u1(pages):
    return pages.groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("U2_provider_union", "articles_v", sql="SELECT url, min(stage) AS stage FROM (SELECT url, 0 AS stage FROM articles_v WHERE language = 'en' UNION ALL SELECT url, 1 FROM articles_v) GROUP BY url ORDER BY stage, url LIMIT 500")
def u2(articles):
    both = articles.filter("language = 'en'").select("url", F.lit(0).alias("stage")).unionByName(articles.select("url", F.lit(1).alias("stage")))
    return R.newest(both.groupBy("url").agg(F.min("stage").alias("stage")), 500, F.col("stage"), F.col("url"))


@query("U3_last_claim_wins", "claims_v", sql="SELECT event_key, source_name, arg_max(resolution_status, (published_at, l_orderkey, l_linenumber)) AS resolution_status FROM claims_v GROUP BY 1, 2")
def u3(claims):
    return claims.groupBy("event_key", "source_name").agg(F.max_by("resolution_status", F.struct("published_at", "l_orderkey", "l_linenumber")).alias("resolution_status"))


@query("U4_dispute_dedupe", "mentions_v", sql="SELECT least(entity, topic) AS a, greatest(entity, topic) AS b, count(*) AS n FROM mentions_v GROUP BY 1, 2")
def u4(mentions):
    """Duplicates under an order-free key: the sorted pair of sources."""
    pair = F.sort_array(F.array("entity", "topic"))
    return mentions.groupBy(pair[0].alias("a"), pair[1].alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("U6_number_differences", "articles_v", sql="SELECT url, list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))) AS differing FROM (SELECT url, list_distinct(regexp_extract_all(title, '[0-9]+')) AS a, list_distinct(regexp_extract_all(description, '[0-9]+')) AS b FROM articles_v)")
def u6(articles):
    n = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("([0-9]+)"), F.lit(1)))
    a, b = n("title"), n("description")
    return articles.select("url", F.sort_array(F.concat(F.array_except(a, b), F.array_except(b, a))).alias("differing"))


@query("U7_shared_sources", "articles_v", sql="SELECT source FROM articles_v WHERE published_at < TIMESTAMP '2024-01-10' INTERSECT SELECT source FROM articles_v WHERE published_at >= TIMESTAMP '2024-01-10'")
def u7(articles):
    cut = F.lit("2024-01-10").cast("timestamp")
    return articles.filter(F.col("published_at") < cut).select("source").intersect(articles.filter(F.col("published_at") >= cut).select("source"))


@query("U8_clean_urls", "pages", sql="SELECT regexp_extract(url, '://([^/]*)', 1) AS host, list_sort(list_distinct(list(trim(url)))) AS urls FROM pages WHERE regexp_matches(trim(url), '^https?://') GROUP BY 1")
def u8(pages):
    host = F.regexp_extract("url", "://([^/]*)", 1).alias("host")
    # each URL goes through the shuffle once; the list of a host is the result itself
    clean = pages.select(host, F.trim("url").alias("url")).filter(F.col("url").rlike("^https?://")).distinct()
    return clean.groupBy("host").agg(F.sort_array(F.collect_list("url")).alias("urls"))
