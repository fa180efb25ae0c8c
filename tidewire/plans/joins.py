"""Queries of joins (J1-J26) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.operators import aggregates as A
from tidewire.operators import indices as I
from tidewire.operators import joins as J
from tidewire.operators import vectors as V
from tidewire.operators import reads as R
from tidewire.plans.reads import TRANSLATED, translated
from tidewire.plans.registry import query
from tidewire.plans.views import AS_OF

KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(a.latitude - b.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(a.longitude - b.longitude) / 2), 2))))"


@query("J1_articles_topics", "articles_v", "registry_v", sql="SELECT url, topic, trust_tier FROM articles_v JOIN registry_v USING (source_domain)")
def j1(articles, registry):
    return articles.join(registry, "source_domain").select("url", "topic", "trust_tier")


@query("J2_translations_overlay", "articles_v", sql=f"WITH tr AS ({TRANSLATED}) SELECT url, coalesce(translated_title, title) AS title FROM articles_v LEFT JOIN tr ON article_url = url")
def j2(articles):
    return R.recent_articles(articles, translated(articles), AS_OF, 24 * 400, limit=None).select("url", "title")


@query("J3_untranslated", "articles_v", sql=f"WITH tr AS ({TRANSLATED}) SELECT url FROM articles_v WHERE language <> 'en' AND url NOT IN (SELECT article_url FROM tr)")
def j3(articles):
    return articles.filter(~S.is_english("language")).join(translated(articles).select(F.col("article_url").alias("url")), "url", "left_anti").select("url")


@query("J4_article_regions", "articles_v", "registry_v", sql="SELECT url, coalesce(d.region, n.region, 'global') AS region FROM articles_v a LEFT JOIN registry_v d ON d.source_domain = a.source_domain AND d.active LEFT JOIN registry_v n ON n.source_name = a.source AND n.active")
def j4(articles, registry):
    return J.with_regions(articles, registry.filter("active")).select("url", "region")


@query("J5_registry_resolution", "articles_v", "registry_v", sql="SELECT url, r.trust_tier, r.region FROM articles_v a LEFT JOIN registry_v r USING (source_domain)")
def j5(articles, registry):
    return J.resolve_sources(articles, registry, "source_name").select("url", "registry.trust_tier", "registry.region")


def sided(structured, dataset: str):
    return structured.filter(F.col("dataset") == dataset).select(F.col("event_id").alias("id"), "ts", "country", "latitude", "longitude")


@query("J6_superseded", "structured_v", sql=f"SELECT b.event_id AS id, arg_min(a.event_id, (round({KM}, 9), a.event_id)) AS superseded_by, round(min({KM}), 6) AS km FROM structured_v b JOIN structured_v a ON a.country = b.country AND a.dataset = 'acled' AND b.dataset = 'gdelt_gkg' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000 AND abs(a.latitude - b.latitude) < 0.46 WHERE {KM} <= 50 GROUP BY b.event_id")
def j6(structured):
    return J.nearest_within(sided(structured, "gdelt_gkg"), sided(structured, "acled")).withColumn("km", F.round("km", 6))


@query("J7_story_events", "disputes_v", "structured_v", "nation", sql="""WITH st AS (SELECT event_key AS story_id, n_name AS country, generated_on FROM disputes_v JOIN nation ON contains(event_label, lower(n_name)) AND event_key = concat(n_name, '-', CAST(generated_on AS VARCHAR))),
 r AS (SELECT story_id, event_id, event_date, s.country, st.country = s.country AS own, row_number() OVER (PARTITION BY story_id ORDER BY event_date DESC, fatalities DESC, event_id) AS n FROM st JOIN structured_v s ON event_date BETWEEN generated_on - 2 AND generated_on + 2)
 SELECT story_id, event_id, event_date, country FROM (SELECT *, max(own) OVER (PARTITION BY story_id) AS has_own FROM r WHERE n <= 80) WHERE own OR NOT has_own""")
def j7(disputes, structured, nation):
    n = nation.select(F.col("n_name"))
    stories = disputes.join(F.broadcast(n), F.col("event_key") == F.concat("n_name", F.lit("-"), F.col("generated_on").cast("string")))
    stories = stories.select(F.col("event_key").alias("story_id"), F.array("n_name").alias("countries"), F.col("generated_on").alias("first_date"), F.col("generated_on").alias("last_date"))
    return J.events_in_range(stories, structured)


@query("J10_label_country", "disputes_v", "nation", sql="SELECT event_key, arg_min(lower(n_name), n_nationkey) AS country FROM disputes_v JOIN nation ON contains(event_label, lower(n_name)) GROUP BY event_key")
def j10(disputes, nation):
    return I.label_country(disputes, nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))).select("event_key", "country")


@query("J13_entity_pairs", "mentions_v", sql="WITH m AS (SELECT DISTINCT topic, article_url, entity FROM mentions_v) SELECT a.topic, a.article_url, a.entity AS entity_a, b.entity AS entity_b FROM m a JOIN m b ON a.topic = b.topic AND a.article_url = b.article_url AND a.entity < b.entity")
def j13(mentions):
    return A.cooccurrences(mentions).drop("mentioned_at")


@query("J14_causal_edges", "structured_v", sql="""WITH n AS (SELECT event_id AS id, country, ts, actor_primary AS actor, event_type AS kind FROM structured_v),
 p AS (SELECT a.id AS cause, b.id AS effect, floor(epoch_us(b.ts) / 1000000) - floor(epoch_us(a.ts) / 1000000) AS lag, a.actor = b.actor AS x, a.kind = b.kind AS y FROM n a JOIN n b ON a.country = b.country AND floor(epoch_us(b.ts) / 1000000) > floor(epoch_us(a.ts) / 1000000) AND floor(epoch_us(b.ts) / 1000000) - floor(epoch_us(a.ts) / 1000000) <= 1209600)
 SELECT cause, effect, round((1.0 - lag / 1209600.0) * 0.3 + CASE WHEN x THEN 0.35 ELSE 0.0 END + CASE WHEN y THEN 0.15 ELSE 0.0 END + 0.1 + 1e-10, 8) AS score FROM p WHERE (1.0 - lag / 1209600.0) * 0.3 + CASE WHEN x THEN 0.35 ELSE 0.0 END + CASE WHEN y THEN 0.15 ELSE 0.0 END + 0.1 >= 0.35""")
def j14(structured):
    nodes = structured.select(F.col("event_id").alias("id"), "country", "ts", F.col("actor_primary").alias("actor"), F.col("event_type").alias("kind"))
    return J.causal_edges(nodes, lag_days=14).select("cause", "effect", F.round(F.col("score") + 1e-10, 8).alias("score"))


@query("J15_perspectives", "articles_v", "framing_v", "registry_v", sql="SELECT url, f.subject_key, f.dominant_frame, r.trust_tier, r.region FROM articles_v a LEFT JOIN framing_v f ON f.article_url = a.url LEFT JOIN registry_v r USING (source_domain)")
def j15(articles, framing, registry):
    rows = articles.select("url", "source_domain").join(framing.select(F.col("article_url").alias("url"), "subject_key", "dominant_frame"), "url", "left")
    return rows.join(registry.select("source_domain", "trust_tier", "region"), "source_domain", "left").drop("source_domain")


WORDS = "list_distinct(regexp_extract_all(lower(title), '[a-z]{4,}'))"


@query("J16_prediction_articles", "conversations", "articles_v", sql=f"""WITH p AS (SELECT concat(conv_id, '-', turn) AS prediction_key, TIMESTAMP '2024-01-01 00:00:00' + (conv_id % 25) * INTERVAL 1 DAY AS created_at, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS subjects FROM conversations WHERE role = 'assistant'),
 a AS (SELECT url, source, published_at, {WORDS} AS words FROM articles_v)
 SELECT prediction_key, url, source, len(list_intersect(subjects, words)) AS shared FROM p JOIN a ON published_at >= created_at AND published_at <= created_at + INTERVAL 4 DAY WHERE len(list_intersect(subjects, words)) >= 2""")
def j16(conversations, articles):
    start = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("conv_id") % 25).cast("int"))
    preds = conversations.filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("prediction_key"), start.alias("created_at"), S.words("text").alias("subjects"))
    preds = preds.withColumn("horizon_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    return J.windowed_matches(preds, articles.withColumn("words", S.words("title")))


@query("J17_vector_top_k", "embeddings", sql="""WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS score FROM embeddings e JOIN q ON vec_id <> query_id)
 SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 8""")
def j17(embeddings):
    queries = embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return J.top_k_cosine(queries, embeddings, 8).withColumn("score", F.round("score", 5))


def indexed(embeddings, k=8):
    queries = embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = V.build(embeddings)
    return queries, V.search(index, queries, k, V.probes_for(index, queries, k))


@query("J17_indexed_top_k", "embeddings")
def j17_indexed(embeddings):
    """The same search through the inverted-file index; a test holds its recall, J17_index_recall measures it."""
    return indexed(embeddings)[1]


@query("J17_index_recall", "embeddings", sql="SELECT count(*) AS queries, CAST(8 * count(*) AS BIGINT) AS wanted, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def j17_recall(embeddings):
    """Whether the index finds nine tenths of what the exact search finds."""
    queries, found = indexed(embeddings)
    return V.recall(J.top_k_cosine(queries, embeddings, 8), found).select("queries", "wanted", (F.col("hits") >= F.col("wanted") * 0.9).alias("reached"))


@query("J18_retrieval_cascade", "articles_v", sql="""WITH s AS (SELECT url, 0 AS stage, row_number() OVER (ORDER BY published_at DESC, url) AS rank FROM articles_v WHERE contains(lower(title), 'tion')
 UNION ALL SELECT url, 1, row_number() OVER (ORDER BY published_at DESC, url) FROM articles_v WHERE topic = 'economics' UNION ALL SELECT url, 2, row_number() OVER (ORDER BY published_at DESC, url) FROM articles_v),
 f AS (SELECT url, min(stage) AS stage, arg_min(rank, stage) AS rank FROM s GROUP BY url) SELECT url, stage, CAST(rank AS INT) AS rank FROM f ORDER BY stage, rank, url LIMIT 200""")
def j18(articles):
    from pyspark.sql import Window

    newest = lambda df: R.newest(df, 200, F.desc("published_at"), F.col("url")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("published_at"), "url")))  # noqa: E731  at most 200 rows reach the window
    return J.cascade([newest(articles.filter("contains(lower(title), 'tion')")), newest(articles.filter("topic = 'economics'")), newest(articles)], 200)


@query("J19_cluster_headline", "articles_v", sql="SELECT concat(source, '-', topic) AS cluster_key, arg_min(title, (published_at, url)) AS headline, count(*) AS matched FROM articles_v WHERE length(trim(title)) > 0 GROUP BY 1")
def j19(articles):
    urls = F.transform(F.sort_array(F.collect_list(F.struct("published_at", "url"))), lambda x: x["url"])
    clusters = articles.groupBy(F.concat_ws("-", "source", "topic").alias("cluster_key")).agg(urls.alias("urls"))
    return J.first_titled(clusters, articles)


@query("J20_observation_event", "claims_v", "orders", sql="SELECT l_orderkey, l_linenumber, o_custkey AS event_id FROM claims_v LEFT JOIN orders ON o_orderkey = l_orderkey")
def j20(claims, orders):
    return claims.select("l_orderkey", "l_linenumber").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("event_id")), "l_orderkey", "left")


@query("J21_overlapping_events", "claims_v", sql="""WITH m AS (SELECT DISTINCT source_name AS event, event_key AS url FROM claims_v), z AS (SELECT event, count(*) AS n FROM m GROUP BY event),
 p AS (SELECT a.event, b.event AS other, count(*) AS shared FROM m a JOIN m b ON a.url = b.url AND a.event < b.event GROUP BY 1, 2)
 SELECT p.event, other, shared FROM p JOIN z ON z.event = p.event JOIN z y ON y.event = other WHERE least(z.n, y.n) = 1 OR shared >= greatest(2, ceil(least(z.n, y.n) / 2.0))""")
def j21(claims):
    return J.overlapping_events(claims.select(F.col("source_name").alias("event"), F.col("event_key").alias("url")))


@query("J22_best_article", "claims_v", sql="SELECT event_key, arg_max(source_name, (published_at, source_name, l_orderkey, l_linenumber)) AS best_source, count(*) AS n_rows, count(DISTINCT source_name) AS sources FROM claims_v GROUP BY event_key")
def j22(claims):
    return claims.groupBy("event_key").agg(F.max_by("source_name", F.struct("published_at", "source_name", "l_orderkey", "l_linenumber")).alias("best_source"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source_name").alias("sources"))


@query("J23_event_bundle", "orders", "claims_v", sql="""WITH c AS (SELECT l_orderkey, count(*) AS claims, count(DISTINCT source_name) AS sources, count(*) FILTER (WHERE resolution_status = 'contradicted') AS contradictions FROM claims_v GROUP BY 1)
 SELECT o_orderkey, o_totalprice, coalesce(claims, 0) AS claims, coalesce(sources, 0) AS sources, coalesce(contradictions, 0) AS contradictions FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def j23(orders, claims):
    by = claims.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("source_name").alias("sources"), F.count_if(F.col("resolution_status") == "contradicted").alias("contradictions"))
    return orders.select("o_orderkey", "o_totalprice").join(by, "o_orderkey", "left").fillna(0, ["claims", "sources", "contradictions"])


@query("J24_entity_links", "customer", "supplier", sql="SELECT s_suppkey, c_name AS label, c_custkey AS qid FROM (SELECT s_suppkey, c_name, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE n <= 5")
def j24(customer, supplier):
    """The five best links of each nation are ranked first, so each supplier meets five rows."""
    best = R.top_per(customer.select("c_nationkey", "c_name", "c_custkey", "c_acctbal"), ["c_nationkey"], 5, F.desc("c_acctbal"), F.col("c_custkey"))
    return supplier.join(best, F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", F.col("c_name").alias("label"), F.col("c_custkey").alias("qid"))


@query("J25_feed_state", "registry_v", "articles_v", sql="SELECT r.source_name, r.trust_tier, max(published_at) AS latest, count(url) AS articles FROM registry_v r LEFT JOIN articles_v a USING (source_domain) GROUP BY 1, 2")
def j25(registry, articles):
    state = articles.groupBy("source_domain").agg(F.max("published_at").alias("latest"), F.count("url").alias("articles"))
    return registry.join(state, "source_domain", "left").select("source_name", "trust_tier", "latest", F.coalesce("articles", F.lit(0)).alias("articles"))
