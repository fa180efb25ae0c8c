"""Further queries: outcomes, regions, adjudication, similarity, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.functions import texts as X
from tidewire.operators import joins as J
from tidewire.operators import reads as R
from tidewire.plans.joins import WORDS
from tidewire.plans.registry import query
from tidewire.plans.views import AS_OF


def outcomes(predictions, matches, articles, now, grace: int = 3):
    """Pending before the horizon; hit by two sources or more, weak by one; where nothing matches, miss if one of
    the first three subjects is in an article of the search time before now (the subject stayed active), else expired.

    The search goes back from ``now`` as long as the prediction's window and a day, three days at least.
    """
    by = matches.groupBy("prediction_key").agg(F.countDistinct("source").alias("sources"))
    rows = predictions.join(by, "prediction_key", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    hours = F.greatest(F.lit(72), ((F.unix_seconds("horizon_at") + grace * 86400 - F.unix_seconds("created_at")) / 3600 + 24).cast("int"))
    asked = rows.filter("sources = 0").select("prediction_key", (F.unix_seconds(now) - hours * 3600).alias("since"), F.explode(F.slice("subjects", 1, 3)).alias("word"))
    # the last time of each word is enough
    last = articles.filter(F.col("published_at") <= now).select(F.explode("words").alias("word"), F.unix_seconds("published_at").alias("at")).groupBy("word").agg(F.max("at").alias("at"))
    active = asked.join(last, "word").filter("at >= since").select("prediction_key", F.lit(True).alias("active")).distinct()
    n = F.col("sources")
    status = F.when(F.col("horizon_at") > now, "pending").when(n >= 2, "hit").when(n == 1, "weak").when(F.col("active"), "miss").otherwise("expired")
    return rows.join(active, "prediction_key", "left").select("prediction_key", "sources", status.alias("status"))


C19_WORDS = "list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z]{{4,}}'), lambda x, i: CASE WHEN list_position(regexp_extract_all(lower({0}), '[a-z]{{4,}}'), x) = i THEN x END), lambda x: x IS NOT NULL)"
C19_SQL = f"""WITH p AS (SELECT concat(conv_id, '-', turn) AS prediction_key, TIMESTAMP '2024-01-01 00:00:00' + (conv_id % 30) * INTERVAL 1 DAY AS created_at, {C19_WORDS.format('text')} AS subjects FROM conversations WHERE role = 'assistant'),
 a AS (SELECT url, source, published_at, {WORDS} AS words FROM reports_v),
 m AS (SELECT prediction_key, count(DISTINCT source) AS n FROM p JOIN a ON published_at >= created_at AND published_at <= created_at + INTERVAL 4 DAY WHERE len(list_intersect(subjects, words)) >= 2 GROUP BY 1),
 w AS (SELECT word, max(published_at) AS seen FROM (SELECT unnest(words) AS word, published_at FROM a WHERE published_at <= TIMESTAMP '{AS_OF}') GROUP BY 1),
 x AS (SELECT DISTINCT prediction_key FROM (SELECT prediction_key, unnest(subjects[:3]) AS word FROM p) JOIN w USING (word) WHERE seen >= TIMESTAMP '{AS_OF}' - INTERVAL 120 HOUR)
 SELECT prediction_key, coalesce(n, 0) AS sources, CASE WHEN created_at + INTERVAL 1 DAY > TIMESTAMP '{AS_OF}' THEN 'pending' WHEN n >= 2 THEN 'hit' WHEN n = 1 THEN 'weak' WHEN x.prediction_key IS NOT NULL THEN 'miss' ELSE 'expired' END AS status FROM p LEFT JOIN m USING (prediction_key) LEFT JOIN x USING (prediction_key)"""


@query("C19_prediction_outcomes", "conversations", "reports_v", sql=C19_SQL)
def c19(conversations, reports):
    """Whole assistant texts as predictions of a day, against the titles of reports."""
    start = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("conv_id") % 30).cast("int"))
    preds = conversations.filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("prediction_key"), start.alias("created_at"), S.words("text").alias("subjects"))
    preds = preds.withColumn("horizon_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    articles = reports.withColumn("words", S.words("title"))
    return outcomes(preds, J.windowed_matches(preds, articles), articles, F.lit(AS_OF).cast("timestamp"))


@query("F36_dominant_region", "articles_v", "registry_v", sql="WITH g AS (SELECT topic, language, region, count(*) AS n FROM articles_v JOIN registry_v USING (source_domain) GROUP BY 1, 2, 3) SELECT topic, language, arg_min(region, (-n, region)) AS region, max(n) AS n FROM g GROUP BY 1, 2")
def f36(articles, registry):
    g = articles.join(registry.select("source_domain", "region"), "source_domain").groupBy("topic", "language", "region").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("topic", "language").agg(F.min_by("region", F.struct(-F.col("n"), F.col("region"))).alias("region"), F.max("n").alias("n"))


@query("F25_credible_source", "articles_v", "registry_v", sql="SELECT topic, language, arg_min(url, (trust_tier, -epoch_us(published_at), url)) AS credible_url FROM articles_v JOIN registry_v USING (source_domain) WHERE trust_tier <> 'tier_4' GROUP BY 1, 2")
def f25(articles, registry):
    """The better tier, then the later time; the fourth tier settles nothing."""
    rows = articles.join(registry.filter("trust_tier <> 'tier_4'").select("source_domain", "trust_tier"), "source_domain")
    order = F.struct(F.col("trust_tier"), -F.unix_micros("published_at"), F.col("url"))
    return rows.groupBy("topic", "language").agg(F.min_by("url", order).alias("credible_url"))


TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z][a-z\\-]{{2,}}')), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in X.CLAIM_STOPWORDS) + "))"


@query("F21_similar_claims", "articles_v", sql=f"SELECT url, len(a) > 0 AND len(b) > 0 AND (len(list_intersect(a, b)) >= 4 OR len(list_intersect(a, b)) >= least(len(a), len(b)) * 0.6) AS similar FROM (SELECT url, {TOKENS.format('title')} AS a, {TOKENS.format('description')} AS b FROM articles_v)")
def f21(articles):
    return articles.select("url", X.similar("title", "description").alias("similar"))


@query("F44_text_routing", "articles_v", sql="SELECT url, CASE WHEN language = 'en' THEN 'original' WHEN length(description) > 60 THEN 'translate' ELSE 'title_only' END AS route FROM articles_v")
def f44(articles):
    route = F.when(S.is_english("language"), "original").when(F.length("description") > 60, "translate").otherwise("title_only")
    return articles.select("url", route.alias("route"))


@query("K18_reliability_append", "claims_v", sql="SELECT 'before' AS snapshot_key, source_name, count(*) AS claims FROM claims_v WHERE published_at < TIMESTAMP '1995-06-01' GROUP BY 2 UNION ALL SELECT 'after', source_name, count(*) FROM claims_v GROUP BY 2")
def k18(claims):
    by = lambda rows, name: rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("claims")).select(F.lit(name).alias("snapshot_key"), "source_name", "claims")
    return by(claims.filter("published_at < TIMESTAMP '1995-06-01'"), "before").unionByName(by(claims, "after"))


@query("C30_correction_queue", "lineitem", sql="SELECT CASE WHEN l_returnflag = 'R' THEN 'split' ELSE 'merge' END AS correction_type, l_orderkey AS event_a_id, l_partkey AS event_b_id, l_shipdate AS created_at FROM lineitem")
def c30(lineitem):
    kind = F.when(F.col("l_returnflag") == "R", "split").otherwise("merge")
    return lineitem.select(kind.alias("correction_type"), F.col("l_orderkey").alias("event_a_id"), F.col("l_partkey").alias("event_b_id"), F.col("l_shipdate").alias("created_at"))


@query("J12_claim_pairs", "claims_v", sql="SELECT DISTINCT a.event_key, a.source_name AS left_source, b.source_name AS right_source FROM claims_v a JOIN claims_v b ON a.event_key = b.event_key AND a.claim_type = b.claim_type AND a.source_name < b.source_name AND a.resolution_status <> b.resolution_status")
def j12(claims):
    """Sources of one event that report the same kind of claim with different outcomes."""
    one = claims.select("event_key", "claim_type", "source_name", "resolution_status").distinct()
    other = one.select("event_key", "claim_type", F.col("source_name").alias("right_source"), F.col("resolution_status").alias("other"))
    rows = one.join(other, ["event_key", "claim_type"]).filter("source_name < right_source AND resolution_status <> other")
    return rows.select("event_key", F.col("source_name").alias("left_source"), "right_source").distinct()


@query("P12_precise_points", "customer", sql="WITH k AS (SELECT c_custkey, trim(regexp_replace(lower(concat(c_name, ', ', c_mktsegment)), '[^a-z0-9]+', ' ', 'g')) AS p, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS c, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS a FROM customer) SELECT c_custkey, (a <> c AND p <> '') OR (p <> '' AND p <> c AND a <> c AND a <> '') AS precise FROM k")
def p12(customer):
    point = R.precise_point(F.concat_ws(", ", "c_name", "c_mktsegment"), F.col("c_mktsegment"), F.col("c_name"))
    return customer.select("c_custkey", point.alias("precise"))


@query("F14_names_in_text", "documents", sql="SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS found FROM documents")
def f14(documents):
    """Names in a text, each once."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    return documents.select("doc_id", F.sort_array(F.array_distinct(found)).alias("found"))
