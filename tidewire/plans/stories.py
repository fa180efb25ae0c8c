"""Queries of signatures, groups, matches, end-to-end jobs and case scoring, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import news as N
from tidewire.functions import scalars as S
from tidewire.functions import texts as X
from tidewire.operators import cluster as C
from tidewire.operators import graph as G
from tidewire.operators import matching, ordered
from tidewire.operators import stories as O
from tidewire.operators.merge import merge_upsert
from tidewire.plans import more
from tidewire.plans.news import TYPES, WORDS, groups, some, text
from tidewire.plans.registry import query, stored
from tidewire.plans.views import view
from tidewire.sources import records as R
from tidewire.streaming import streams as T

TITLE_KEYS = WORDS("lower(title)")
TITLE_ANCHORS = groups("lower(title)", N.EVENT_ANCHORS)


@query("C1_signatures", "reports_v", "embeddings", sql=f"SELECT doc_id, len({WORDS('t')}) AS n_keywords, {groups('t', N.EVENT_ANCHORS)} AS anchors, len(embedding) AS dims FROM (SELECT doc_id, lower(concat(title, '. ', coalesce(description, ''))) AS t FROM reports_v) LEFT JOIN embeddings ON vec_id = doc_id")
def c1(reports, embeddings):
    rows = O.signatures(reports.select("doc_id", "title", "description"), text()).join(embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return rows.select("doc_id", F.size("keywords").alias("n_keywords"), "anchors", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


@query("C8_entity_tags", "reports_v", sql="""WITH d AS (SELECT DISTINCT lower(place) AS name, 'GPE' AS type FROM reports_v UNION SELECT DISTINCT lower(actor), 'ORG' FROM reports_v),
 t AS (SELECT doc_id, concat(' ', array_to_string(regexp_extract_all(lower(concat(title, ' ', actor, ' ', description)), '[a-z0-9.]+'), ' '), ' ') AS t FROM reports_v)
 SELECT doc_id, name AS entity, type FROM t JOIN d ON contains(t, concat(' ', name, ' '))""")
def c8(reports):
    """Names of the places and groups of all reports, in the text of each."""
    names = reports.select(F.lower("place").alias("name"), F.lit("GPE").alias("type")).union(reports.select(F.lower("actor"), F.lit("ORG"))).distinct()
    return matching.tag_names(reports, "doc_id", F.concat_ws(" ", "title", "actor", "description"), names)


def signed(reports):
    rows = reports.select(F.col("doc_id").alias("id"), "actor", "topic", "published_at", "source", "title", F.array("actor", "place").alias("entities"))
    return rows.withColumns({"keywords": N.keywords("title"), "anchors": N.anchors("title")})


JACCARD = lambda x, y: f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) ELSE 0.0 END"
CONFLICT = "(" + " OR ".join(f"(list_contains(aa, '{p}') AND list_contains(ab, '{q}')) OR (list_contains(aa, '{q}') AND list_contains(ab, '{p}'))" for p, q in N.ANCHOR_CONFLICTS) + ")"
PAIRS = f"""s AS (SELECT doc_id AS id, actor, topic, published_at, epoch_us(published_at) // 1000000 AS sec, source, title, [actor, place] AS ents, {TITLE_KEYS} AS k, {TITLE_ANCHORS} AS anc FROM reports_v),
 q AS (SELECT a.id AS a, b.id AS b, abs(a.sec - b.sec) / 3600.0 AS hours, a.ents AS ea, b.ents AS eb, a.k AS ka, b.k AS kb, a.anc AS aa, b.anc AS ab FROM s a JOIN s b ON a.actor = b.actor AND a.topic = b.topic AND a.id < b.id AND abs(a.sec - b.sec) <= 259200),
 m AS (SELECT *, len(list_intersect(ea, eb)) AS e, len(list_intersect(ka, kb)) AS k, len(list_intersect(aa, ab)) AS n, {CONFLICT} AS c FROM q),
 z AS (SELECT *, round((e * 1.9 + k * 0.42 + n * 1.65 + {JACCARD('ea', 'eb')} * 2.0 + {JACCARD('ka', 'kb')} * 1.4 + {JACCARD('aa', 'ab')} * 1.5) * CASE WHEN hours <= 12 THEN 1.0 WHEN hours <= 36 THEN 0.92 ELSE 0.82 END
  - CASE WHEN c AND hours > 6 THEN 2.6 ELSE 0 END - CASE WHEN e = 0 AND n = 0 THEN 0.8 ELSE 0 END, 3) AS score FROM m),
 r AS (SELECT *, (n >= 1 AND e >= 1) OR (e >= 2 AND k >= 2) OR (k >= 6 AND n >= 1 AND hours <= 48) OR (NOT (c AND e < 3) AND score >= 4.1) AS related FROM z)"""


@query("C3_lexical_pairs", "reports_v", sql=f"WITH {PAIRS} SELECT a, b, score, related FROM r")
def c3(reports):
    """Reports of one group and topic within three days of each other."""
    return O.lexical_pairs(signed(reports), ["actor", "topic"], 3.0).select("a", "b", "score", "related")


SEEDS = "g AS (SELECT *, CASE WHEN coalesce(epoch_us(published_at) - lag(epoch_us(published_at)) OVER w > {gap}, true) THEN doc_id END AS start FROM {rows} WINDOW w AS (PARTITION BY place ORDER BY published_at, doc_id)), h AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY place ORDER BY published_at, doc_id ROWS UNBOUNDED PRECEDING) AS seed FROM g)"
DAY = 86_400_000_000


@query("C6_seed_groups", "reports_v", sql=f"WITH {SEEDS.format(gap=DAY // 4, rows='reports_v')} SELECT doc_id, seed FROM h")
def c6(reports):
    """Groups of a place; a gap of a quarter of a day ends one."""
    return ordered.sessions(reports, ["place"], "published_at", "doc_id", 0.25).select("doc_id", "seed")


@query("C7_hotspot_zones", "structured_v", sql="""WITH RECURSIVE p AS (SELECT DISTINCT floor(latitude) AS lat, floor(longitude) AS lon FROM structured_v WHERE event_type = 'Battles'), d AS (SELECT concat(CAST(lat AS INT) + 1000, ':', CAST(lon AS INT) + 1000) AS id, lat, lon FROM p),
 e AS (SELECT a.id AS x, b.id AS y FROM d a JOIN d b ON abs(a.lat - b.lat) <= 4 AND 12742 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 350),
 c AS (SELECT id AS x, id AS y FROM d UNION SELECT c.x, e.y FROM c JOIN e ON e.x = c.y) SELECT x AS id, min(y) AS zone FROM c GROUP BY x""")
def c7(structured):
    """Zones of the whole degrees in which battles were."""
    points = structured.filter("event_type = 'Battles'").select(F.floor("latitude").alias("lat"), F.floor("longitude").alias("lon")).distinct()
    named = points.select(F.concat_ws(":", (F.col("lat") + 1000).cast("string"), (F.col("lon") + 1000).cast("string")).alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return O.zones(named)


PHRASE = "coalesce(" + ", ".join(f"CASE WHEN contains(l, '{p}') THEN '{p}' END" for p in N.CAUSAL_PHRASES) + ")"


@query("C14_causal_graph", "reports_v", sql=f"""WITH n AS (SELECT doc_id AS id, published_at AS ts, place, actor, lower(title) AS l, {WORDS('lower(title)')} AS w FROM reports_v),
 p AS (SELECT a.id AS cause, b.id AS effect, a.actor = b.actor AS e, a.place = b.place AS c, b.l, len(list_intersect(a.w, b.w)) / greatest(1, least(len(a.w), len(b.w))) AS f FROM n a JOIN n b ON (a.actor = b.actor OR a.place = b.place) AND b.ts > a.ts AND b.ts < a.ts + INTERVAL 2 DAY),
 s AS (SELECT cause, effect, least(1.0, CASE WHEN e THEN 0.4 ELSE 0 END + CASE WHEN c THEN 0.2 ELSE 0 END + CASE WHEN {PHRASE} IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN f > 0.1 THEN least(0.3, f * 0.6) ELSE 0 END) AS score,
  list_filter([CASE WHEN e THEN 'shared_entity' END, CASE WHEN c THEN 'same_country' END, CASE WHEN {PHRASE} IS NOT NULL THEN concat('phrase:', {PHRASE}) END, CASE WHEN f > 0.1 THEN 'token_overlap' END], lambda x: x IS NOT NULL) AS reasons FROM p)
 SELECT cause, effect, round(score, 3) AS score, reasons FROM s WHERE score >= 0.35""")
def c14(reports):
    nodes = reports.select(F.col("doc_id").alias("id"), F.col("published_at").alias("ts"), F.col("place").alias("country"), F.array("actor").alias("entities"), F.col("title").alias("text"))
    return O.causal_graph(nodes, 1)


def quality(rows, registry):
    """F16 of each report of a registered source."""
    joined = rows.join(registry.select("source_domain", "active", "region", "trust_tier"), "source_domain")
    return joined.withColumn("quality", X.quality_score(*[F.col(c) for c in ("title", "description", "published_at", "language", "source_domain", "active", "region", "trust_tier")], N.hits(N.lower("title"), ["ceasefire", "sanctions", "election"])))


QUALITY = """CASE WHEN active THEN 3 ELSE 0 END + CASE WHEN region NOT IN ('global', 'united-states', 'europe') THEN 2 ELSE 0 END + CASE WHEN trust_tier = 'tier_2' THEN 1 ELSE 0 END + CASE WHEN length(t) BETWEEN 24 AND 180 THEN 2 ELSE 0 END + CASE WHEN length(trim(description)) >= 48 THEN 2 ELSE 0 END + 2
 - CASE WHEN len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r]+'), lambda x: x <> '')) < 5 THEN 2 ELSE 0 END + len(list_filter(['ceasefire', 'sanctions', 'election'], lambda w: contains(lower(t), w)))"""
SCORED = f"SELECT *, {QUALITY} AS quality FROM (SELECT *, trim(title) AS t FROM reports_v) JOIN registry_v USING (source_domain)"


@query("C16_article_events", "reports_v", "registry_v", sql=f"""WITH v AS ({SCORED.replace('SELECT *, CASE', 'SELECT doc_id, place, r_title AS title, published_at, source_domain, actor, lower(concat(r_title, chr(32), description)) AS txt, CASE').replace('SELECT *, trim(title) AS t FROM', 'SELECT *, title AS r_title, trim(title) AS t FROM')}), {SEEDS.format(gap=DAY // 4, rows='v')},
 e AS (SELECT place, seed, count(*) AS articles, count(DISTINCT source_domain) AS sources, arg_max(title, (quality, published_at, title)) AS title, max(quality) AS quality, min(published_at) AS first_at,
  arg_min(actor, (-an, actor)) AS entity, count(*) FILTER (WHERE {some('txt', N.STRONG_CONFLICT)}) AS strong, count(*) FILTER (WHERE NOT ({some('txt', N.STRONG_CONFLICT)}) AND {some('txt', N.WEAK_CONFLICT)}) AS weak FROM (SELECT *, count(*) OVER (PARTITION BY place, seed, actor) AS an FROM h) GROUP BY 1, 2)
 SELECT concat('art-', substr(sha256(concat(lower(place), '|', lower(entity), '|', CAST(CAST(date_trunc('week', first_at) AS DATE) AS VARCHAR))), 1, 24)) AS event_id, seed, articles, sources, CASE WHEN seed % 2 = 0 AND quality <= 9 THEN 'Stored title' ELSE title END AS title, CASE WHEN strong >= 1 OR weak >= 2 THEN 'Conflict' ELSE 'Political' END AS event_type FROM e""")
def c16(reports, registry):
    """Reports grouped by place, put into stored events; a stored title (quality 9) gives way only to a better one."""
    rows = quality(reports, registry).withColumn("strength", N.conflict_strength(F.concat_ws(" ", "title", "description")))
    rows = ordered.sessions(rows, ["place"], "published_at", "doc_id", 0.25)
    common = rows.groupBy("place", "seed", "actor").agg(F.count(F.lit(1)).alias("n")).groupBy("place", "seed").agg(F.min_by("actor", F.struct(-F.col("n"), F.col("actor"))).alias("entity"))
    best = F.struct("quality", "published_at", "title")
    events = rows.groupBy("place", "seed").agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct("source_domain").alias("sources"), F.max_by("title", best).alias("title"), F.max("quality").alias("quality"), F.min("published_at").alias("first_at"),
        F.count_if(F.col("strength") == 2).alias("strong"), F.count_if(F.col("strength") == 1).alias("weak"),
    ).join(common, ["place", "seed"])
    anchor = F.concat(F.lit("art-"), F.substring(F.sha2(F.concat_ws("|", F.lower("place"), F.lower("entity"), S.week_floor("first_at").cast("string")), 256), 1, 24))
    new = events.select("seed", anchor.alias("event_id"), "articles", "sources", "title", "quality", F.when((F.col("strong") >= 1) | (F.col("weak") >= 2), "Conflict").otherwise("Political").alias("event_type"))
    old = new.filter("seed % 2 = 0").select("seed", F.lit("Stored title").alias("old_title"), F.lit(9).alias("old_quality"))
    return new.join(old, "seed", "left").select("event_id", "seed", "articles", "sources", F.when(F.col("quality") <= F.col("old_quality"), F.col("old_title")).otherwise(F.col("title")).alias("title"), "event_type")


@query("C17_materialized_stories", "reports_v", sql=f"""WITH RECURSIVE {PAIRS}, l AS (SELECT a AS x, b AS y FROM r WHERE related UNION ALL SELECT b, a FROM r WHERE related), c AS (SELECT id AS x, id AS y FROM s UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y), k AS (SELECT x AS id, min(y) AS story FROM c GROUP BY x),
 e AS (SELECT story, topic, count(*) AS articles, count(DISTINCT source) AS sources, arg_max(title, (published_at, id)) AS label, max(published_at) AS latest FROM k JOIN s USING (id) GROUP BY story, topic)
 SELECT story, topic, articles, sources, label, CASE {TYPES.replace('lower(title)', 'lower(label)')} ELSE 'political' END AS story_type FROM (SELECT *, {groups('lower(label)', N.EVENT_ANCHORS)} AS a FROM e)""")
def c17(reports):
    """Reports → related pairs → components → stories with label, counts and type."""
    rows = signed(reports)
    links = O.lexical_links(rows, ["actor", "topic"], 3.0)
    grouped = G.assign(rows, "id", links).withColumnRenamed("component", "story")
    stories = grouped.groupBy("story", "topic").agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"), F.max_by("title", F.struct("published_at", "id")).alias("label"))
    return stories.select("story", "topic", "articles", "sources", "label", N.story_type("label", N.anchors("label")).alias("story_type"))


FIRST_TOPIC = f"CASE WHEN len(list_filter({list(N.TOPIC_KEYWORDS['geopolitics'])}, lambda w: contains(l, w))) >= len(list_filter({list(N.TOPIC_KEYWORDS['economics'])}, lambda w: contains(l, w))) THEN CASE WHEN len(list_filter({list(N.TOPIC_KEYWORDS['geopolitics'])}, lambda w: contains(l, w))) > 0 THEN 'geopolitics' END ELSE 'economics' END"


@query("C23_headline_events", "reports_v", sql=f"""WITH f AS (SELECT * FROM (SELECT *, lower(concat_ws(' ', title, source)) AS l FROM reports_v) WHERE coalesce({FIRST_TOPIC}, topic) = topic),
 e AS (SELECT topic, place, CAST(published_at AS DATE) AS day, count(*) AS articles, count(DISTINCT source) AS sources, max(published_at) AS latest, arg_max(title, (published_at, doc_id)) AS label FROM f GROUP BY 1, 2, 3),
 m AS (SELECT max(published_at) AS now FROM reports_v), s AS (SELECT *, epoch(now - latest) / 3600.0 AS age FROM e, m),
 k AS (SELECT *, least(articles, 10) * 2 + least(sources, 8) * 3 + CASE WHEN age <= 6 THEN 12 WHEN age <= 24 THEN 8 WHEN age <= 72 THEN 4 ELSE 0 END AS score FROM s)
 SELECT topic, place, day, label, CAST(score AS INT) AS score FROM k ORDER BY age <= 24 DESC, score DESC, latest DESC, topic, place LIMIT 12""")
def c23(reports):
    """Reports whose inferred topic is their own, as events of place and day; the last 24 hours first, each block by rank."""
    primary = F.try_element_at(N.topics(F.concat_ws(" ", "title", "source")), F.lit(1))
    kept = reports.filter(F.coalesce(primary, F.col("topic")) == F.col("topic"))
    events = kept.groupBy("topic", "place", F.to_date("published_at").alias("day")).agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"), F.max("published_at").alias("latest"), F.max_by("title", F.struct("published_at", "doc_id")).alias("label"))
    now = reports.agg(F.max("published_at").alias("now"))
    age = (F.unix_micros("now") - F.unix_micros("latest")) / 3_600_000_000
    ranked = events.join(F.broadcast(now)).withColumn("age", age).withColumn("score", X.event_rank(F.col("articles"), F.col("sources"), F.col("age")))
    return ranked.orderBy(F.desc(F.col("age") <= 24), F.desc("score"), F.desc("latest"), "topic", "place").limit(12).select("topic", "place", "day", "label", F.col("score").cast("int").alias("score"))


def payloads(reports):
    item = F.to_json(F.struct("url", "title", F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), "language"))
    return reports.select("topic", F.to_date("published_at").alias("day"), F.concat(F.lit('{"articles": ['), item, F.lit("]}")).alias("json"))


@query("C29_topic_backfill", "reports_v", sql="SELECT url, title, doc_id % 2 = 0 AS known FROM reports_v WHERE doc_id % 2 = 0 OR (topic = 'economics' AND CAST(published_at AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-09')")
def c29(reports):
    """Stored payloads of a topic's days put into the stored articles (every second one)."""
    wanted = payloads(reports).filter("topic = 'economics' AND day BETWEEN DATE '2024-01-02' AND DATE '2024-01-09'")
    new = R.index_articles(wanted).select("url", "title")
    old = reports.filter("doc_id % 2 = 0").select("url", "title")
    return merge_upsert(old, new.dropDuplicates(["url"]), ["url"]).join(old.select("url", F.lit(True).alias("known")), "url", "left").select("url", "title", F.coalesce("known", F.lit(False)).alias("known"))


@query("J9_canonical_match", "reports_v", "structured_v", sql=f"""WITH s AS (SELECT doc_id AS story, place AS country, CASE WHEN doc_id % 3 > 0 THEN actor END AS admin1, CAST(published_at AS DATE) AS day, {TITLE_KEYS} AS w FROM reports_v WHERE doc_id % 10 < 5),
 e AS (SELECT doc_id AS event, place AS country, CASE WHEN doc_id % 4 > 0 THEN actor END AS admin1, CAST(published_at AS DATE) AS day, (doc_id * 7) % 101 AS importance, {TITLE_KEYS} AS w FROM reports_v),
 c AS (SELECT story, event, s.w AS sw, e.w AS ew, coalesce(s.admin1 = e.admin1, true) AS fits, row_number() OVER (PARTITION BY story ORDER BY importance DESC, event) AS n FROM s JOIN e ON s.country = e.country AND e.day BETWEEN s.day - 3 AND s.day + 3),
 f AS (SELECT *, bool_or(fits) OVER (PARTITION BY story) AS any_fits FROM c WHERE n <= 8), j AS (SELECT story, event, {JACCARD('sw', 'ew')} AS score FROM f WHERE fits OR NOT any_fits)
 SELECT story, arg_min(event, (-score, event)) AS event, round(max(score), 6) AS score FROM j WHERE score >= 0.25 GROUP BY story""")
def j9(reports, structured):
    row = lambda name, k: reports.select(F.col("doc_id").alias(name), F.col("place").alias("country"), F.when(F.col("doc_id") % k > 0, F.col("actor")).alias("admin1"), F.to_date("published_at").alias("day"), N.keywords("title").alias("words"), ((F.col("doc_id") * 7) % 101).alias("importance"))
    stories = row("story", 3).join(reports.filter("doc_id % 10 < 5").select(F.col("doc_id").alias("story")), "story", "left_semi")
    return O.canonical_match(stories, row("event", 4), cap=8).withColumn("score", F.round("score", 6))


@query("J8_candidate_scores", "reports_v", sql=f"""WITH x AS (SELECT doc_id, topic, [actor, place] AS ents, {TITLE_KEYS} AS w, url FROM reports_v), o AS (SELECT * FROM x WHERE doc_id % 10 = 0), c AS (SELECT * FROM x WHERE doc_id % 10 > 0),
 p AS (SELECT o.doc_id AS o, c.doc_id AS c, {JACCARD('o.ents', 'c.ents')} AS e, {JACCARD('o.w', 'c.w')} AS l, len(list_intersect(o.ents, c.ents)) AS n FROM o JOIN c ON o.topic = c.topic AND (len(list_intersect(o.ents, c.ents)) > 0 OR len(list_intersect(o.w, c.w)) > 0)),
 s AS (SELECT o, c, round(greatest(e * 0.4 + l * 0.2, CASE WHEN n >= 4 AND l >= 0.2 THEN 0.74 WHEN n >= 3 AND l >= 0.28 THEN 0.68 WHEN n >= 2 AND l >= 0.4 THEN 0.64 ELSE 0.0 END), 4) AS score FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY score DESC, CAST(c AS VARCHAR)) AS r FROM s)
 SELECT CAST(doc_id AS VARCHAR) AS observation_key, max(CASE WHEN r = 1 THEN score END) AS score, max(CASE WHEN r = 2 THEN score END) AS runner_up, CASE WHEN coalesce(max(CASE WHEN r = 1 THEN score END), 0) >= 0.62 THEN 'mapped' ELSE 'created' END AS action FROM o LEFT JOIN k ON k.o = o.doc_id GROUP BY doc_id""")
def j8(reports):
    """Every tenth report as an observation, all others of its topic as candidates: best and second score."""
    rows = reports.select("doc_id", F.col("doc_id").cast("string").alias("key"), "topic", F.array("actor", "place").alias("entities"), N.keywords("title").alias("tokens"), F.array("url").alias("urls"))
    none = F.array().cast("array<string>")
    side = lambda df, p, key: df.select("topic", F.col("key").alias(key), *[F.col(k).alias(f"{p}_{k}") for k in ("entities", "tokens", "urls")], none.alias(f"{p}_ids"))
    out = C.resolve_identity(side(rows.filter("doc_id % 10 = 0"), "o", "observation_key"), side(rows.filter("doc_id % 10 > 0"), "c", "event_id"))
    return out.select("observation_key", "score", "runner_up", "action")


@query("P24_source_urls", "reports_v", sql="""WITH s AS (SELECT topic, place, list(CASE WHEN doc_id % 6 = 0 THEN ' none ' ELSE concat(' ', url, ' ') END ORDER BY published_at, doc_id) || list(url ORDER BY published_at, doc_id) AS u FROM reports_v GROUP BY 1, 2),
 e AS (SELECT topic, place, unnest(list_transform(u, lambda x: trim(x))) AS url, generate_subscripts(u, 1) AS i FROM s), d AS (SELECT topic, place, url, min(i) AS i FROM e WHERE starts_with(url, 'http') GROUP BY 1, 2, 3)
 SELECT topic, place, (list(url ORDER BY i))[:12] AS urls FROM d GROUP BY 1, 2""")
def p24(reports):
    """Distinct links of the reports of each story in order, at most 12; blanks and other schemes go."""
    w = Window.partitionBy("topic", "place").orderBy("published_at", "doc_id")
    rows = reports.withColumn("n", F.row_number().over(w))
    said = F.when(F.col("doc_id") % 6 == 0, " none ").otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    both = rows.select("topic", "place", F.lit(0).alias("part"), "n", F.trim(said).alias("url")).unionByName(rows.select("topic", "place", F.lit(1).alias("part"), "n", "url"))
    first = both.filter("startswith(url, 'http')").groupBy("topic", "place", "url").agg(F.min(F.struct("part", "n")).alias("at"))
    capped = first.withColumn("k", F.row_number().over(Window.partitionBy("topic", "place").orderBy("at"))).filter("k <= 12")
    return capped.groupBy("topic", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "url"))), lambda e: e["url"]).alias("urls"))


@query("C26_foresight", "conversations", "reports_v", sql=f"""WITH f AS (SELECT place, topic, min(published_at) AS seen, min(CASE WHEN CAST(substr(source, 4) AS INT) % 4 = 0 THEN published_at END) AS major FROM reports_v GROUP BY 1, 2)
 SELECT concat('early:', topic, ':', place) AS key, CASE WHEN major IS NULL THEN 'waiting' WHEN epoch(major - seen) / 3600.0 >= 4 THEN 'early' ELSE 'late' END AS status, 1 AS n FROM f
 UNION ALL SELECT 'prediction', status, CAST(count(*) AS INT) FROM ({{C19}}) GROUP BY status""".replace("{C19}", more.C19_SQL))
def c26(conversations, reports):
    """The ledger's outcomes by status, and the lead of each story's first report over the first major source (four hours or more)."""
    ledger = more.c19(conversations, reports).groupBy("status").agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit("prediction").alias("key"), "status", "n")
    major = F.substring("source", 4, 9).cast("int") % 4 == 0
    first = reports.groupBy("place", "topic").agg(F.min("published_at").alias("seen"), F.min(F.when(major, F.col("published_at"))).alias("major"))
    lead = (F.unix_micros("major") - F.unix_micros("seen")) / 3_600_000_000
    status = F.when(F.col("major").isNull(), "waiting").when(lead >= 4, "early").otherwise("late")
    return first.select(F.concat_ws(":", F.lit("early"), "topic", "place").alias("key"), status.alias("status"), F.lit(1).alias("n")).unionByName(ledger)


IMPORTANCE = "least(greatest(ln(1 + {f}) * 3.5, 0), 25) + least(greatest({t} * 5.0, 0), 25) + least({s} * 2.0, 20)"


@query("A47_importance_cases", "structured_v", sql=f"""WITH c AS (SELECT country, event_type, CAST(sum(fatalities) AS DOUBLE) AS f, CAST(count(DISTINCT actor_primary) AS DOUBLE) AS s, CAST(count(DISTINCT dataset) AS DOUBLE) AS t FROM structured_v GROUP BY 1, 2),
 s AS (SELECT *, {IMPORTANCE.format(f='f', t='t', s='s')} AS score FROM c), p AS (SELECT a.country, a.event_type AS a, b.event_type AS b, a.score AS x, b.score AS y, CASE WHEN a.f >= b.f THEN 'a' ELSE 'b' END AS expected FROM s a JOIN s b ON a.country = b.country AND a.event_type < b.event_type)
 SELECT country, a, b, expected, CASE WHEN x > y THEN 'a' WHEN y > x THEN 'b' ELSE 'tie' END AS actual, round(abs(x - y), 2) AS margin, expected = CASE WHEN x > y THEN 'a' WHEN y > x THEN 'b' ELSE 'tie' END AS passed FROM p""")
def a47(structured):
    """Cases: the event types of a country in pairs; the one with more deaths should score higher."""
    c = structured.groupBy("country", "event_type").agg(F.sum("fatalities").alias("f"), F.countDistinct("actor_primary").alias("s"), F.countDistinct("dataset").alias("t"))
    scored = c.withColumn("score", X.importance(F.col("f"), F.col("t"), F.col("s"), F.lit(0), F.lit(0.0)))
    side = lambda k: scored.select("country", F.col("event_type").alias(k), F.col("score").alias(f"{k}_score"), F.col("f").alias(f"{k}_f"))
    pairs = side("a").join(side("b"), "country").filter("a < b")
    actual = F.when(F.col("a_score") > F.col("b_score"), "a").when(F.col("b_score") > F.col("a_score"), "b").otherwise("tie")
    expected = F.when(F.col("a_f") >= F.col("b_f"), "a").otherwise("b")
    return pairs.select("country", "a", "b", expected.alias("expected"), actual.alias("actual"), F.round(F.abs(F.col("a_score") - F.col("b_score")), 2).alias("margin"), (actual == expected).alias("passed"))


RANK = "CASE {}trust_tier WHEN 'tier_1' THEN 3 WHEN 'tier_2' THEN 2 WHEN 'tier_3' THEN 1 ELSE 0 END"


@query("A48_adjudication_cases", "reports_v", "registry_v", sql=f"""WITH p AS (SELECT doc_id // 2 AS case_id, doc_id % 2 AS side, source, published_at, {RANK.format('')} AS r FROM reports_v JOIN registry_v ON source_name = source),
 c AS (SELECT a.case_id, CASE WHEN a.r > b.r THEN a.source WHEN b.r > a.r THEN b.source WHEN a.published_at > b.published_at THEN a.source WHEN b.published_at > a.published_at THEN b.source ELSE 'unresolved' END AS actual, CASE WHEN a.case_id % 3 = 0 THEN 'unresolved' ELSE b.source END AS expected FROM p a JOIN p b ON a.case_id = b.case_id AND a.side = 0 AND b.side = 1)
 SELECT case_id, expected, actual, expected = actual AS passed FROM c""")
def a48(reports, registry):
    """Cases of two reports each: the better tier, then the later one."""
    tier = F.when(F.col("trust_tier") == "tier_1", 3).when(F.col("trust_tier") == "tier_2", 2).when(F.col("trust_tier") == "tier_3", 1).otherwise(0)
    rows = reports.join(registry.select(F.col("source_name").alias("source"), tier.alias("r")), "source").select(F.floor(F.col("doc_id") / 2).alias("case_id"), (F.col("doc_id") % 2).alias("side"), F.struct("r", "published_at", "source").alias("m"))
    both = rows.groupBy("case_id").agg(F.max(F.when(F.col("side") == 0, F.col("m"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("m"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    actual = O.adjudicated(F.col("a"), F.col("b"))
    expected = F.when(F.col("case_id") % 3 == 0, "unresolved").otherwise(F.col("b.source"))
    return both.select("case_id", expected.alias("expected"), actual.alias("actual"), (expected == actual).alias("passed"))


@query("A49_clustering_cases", "reports_v", sql="""WITH m AS (SELECT concat('case', doc_id // 8) AS case_id, doc_id AS i, CASE WHEN doc_id // 8 % 4 = 0 THEN actor ELSE place END AS p, place AS e, doc_id // 8 AS n FROM reports_v),
 x AS (SELECT a.case_id, any_value(a.n) AS n, count(*) FILTER (WHERE a.p = b.p) AS predicted, count(*) FILTER (WHERE a.e = b.e) AS expected, count(*) FILTER (WHERE a.p = b.p AND a.e = b.e) AS tp FROM m a JOIN m b ON a.case_id = b.case_id AND a.i <= b.i GROUP BY 1),
 s AS (SELECT m.case_id, m.n, predicted - c AS predicted, expected - c AS expected, tp - c AS tp FROM x JOIN (SELECT case_id, any_value(n) AS n, count(*) AS c FROM m GROUP BY 1) m USING (case_id)),
 r AS (SELECT case_id, CASE WHEN n % 5 = 0 THEN 'known_architectural_limit' END AS reason, n % 7 = 0 AS generated, CASE WHEN predicted > 0 THEN tp / predicted ELSE 1.0 END AS p, CASE WHEN expected > 0 THEN tp / expected ELSE 1.0 END AS r FROM s), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM r)
 SELECT case_id, round(p, 3) AS precision, round(r, 3) AS recall, round(f1, 3) AS f1, generated AND reason IS NOT NULL AS invalid, CASE WHEN generated AND reason IS NOT NULL THEN false WHEN reason IS NOT NULL THEN f1 <> 1 ELSE f1 = 1 END AS passed FROM f""")
def a49(reports):
    """Cases of eight reports: groups by place expected; every fourth case was grouped by actor."""
    n = F.floor(F.col("doc_id") / 8)
    rows = reports.select(F.concat(F.lit("case"), n.cast("string")).alias("case_id"), n.alias("n"), F.col("doc_id").alias("item"), "actor", "place")
    predicted = rows.select("case_id", "item", F.when(F.col("n") % 4 == 0, F.col("actor")).otherwise(F.col("place")).alias("cluster"))
    counts = O.pair_quality(predicted, rows.select("case_id", "item", F.col("place").alias("cluster")))
    cases = rows.select("case_id", F.when(F.col("n") % 5 == 0, "known_architectural_limit").alias("reason"), (F.col("n") % 7 == 0).alias("generated")).distinct()
    return O.case_outcome(counts.join(cases, "case_id"))


# fixed values: kinds of label records and their decisions
DECISIONS = {
    "clustering": ["correct_cluster", "false_merge", "false_split", "duplicate", "unsure"], "importance": ["should_be_top_n", "ranked_too_high", "ranked_too_low", "unsure"],
    "contradiction": ["true_contradiction", "framing_difference", "noise", "unclear"], "summary": ["faithful", "missing_critical_facts", "hallucinated", "mixed"],
}
LABEL = "schema_version string, kind string, event_id string, label_decision string, annotator_id string, annotated_at string, observation_key string, expected_rank_bucket string, citation_adequate boolean, overall_quality int"


def label_errors(r):
    """Messages for what a parsed label record (a struct) lacks."""
    blank = lambda k: F.coalesce(F.trim(r[k]) == "", F.lit(True))
    told = [F.when(blank(k), F.lit(f"{k} must be a non-empty string")) for k in ("schema_version", "event_id", "annotator_id")]
    told.append(F.when(S.timestamp(r["annotated_at"]).isNull(), "annotated_at must be an ISO-8601 timestamp"))
    allowed = F.create_map(*[x for k, v in DECISIONS.items() for x in (F.lit(k), N.strings(v))])
    told += [
        F.when(~F.coalesce(F.array_contains(allowed[r["kind"]], r["label_decision"]), F.lit(False)), "label_decision is not one of its kind"),
        F.when((r["kind"] == "clustering") & blank("observation_key"), "clustering labels require observation_key"),
        F.when((r["kind"] == "importance") & ~F.coalesce(r["expected_rank_bucket"].isin("top_5", "top_10", "top_20", "not_top_20"), F.lit(False)), "importance labels require expected_rank_bucket"),
        F.when((r["kind"] == "contradiction") & r["citation_adequate"].isNull(), "contradiction labels require citation_adequate"),
        F.when((r["kind"] == "summary") & ~F.coalesce(r["overall_quality"].between(1, 5), F.lit(False)), "summary labels require overall_quality in 1 to 5"),
    ]
    known = F.coalesce(r["kind"].isin(*DECISIONS), F.lit(False))
    return F.when(~known, F.array(F.lit("kind is not known"))).otherwise(F.array_compact(F.array(*told)))


@query("A50_label_files", "labels", sql="""WITH l AS (SELECT doc_id % 6 AS f, doc_id, quality FROM labels)
 SELECT concat('f', CAST(f AS VARCHAR)) AS file, count(*) AS lines, CAST(sum(CASE WHEN doc_id % 11 = 0 THEN 0 WHEN f = 5 THEN 0 WHEN f = 0 AND quality = 0 THEN 0 WHEN f = 1 AND doc_id % 4 = 3 THEN 0 WHEN f = 3 AND doc_id % 5 = 0 THEN 0 WHEN f = 4 THEN 0 ELSE 1 END) AS BIGINT) AS valid,
 CAST(sum(CASE WHEN doc_id % 11 = 0 THEN 1 WHEN f = 5 THEN 1 WHEN f = 0 THEN CASE WHEN quality = 0 THEN 1 ELSE 0 END WHEN f = 1 THEN CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END WHEN f = 3 THEN CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END WHEN f = 4 THEN 2 ELSE 0 END) AS BIGINT) AS errors FROM l GROUP BY f""")
def a50(labels):
    """Files of label lines of all kinds, some cut short, some without what their kind requires."""
    i, f = F.col("doc_id"), F.col("doc_id") % 6
    kind = F.when(f == 0, "clustering").when(f == 1, "importance").when(f == 2, "contradiction").when((f == 3) | (f == 4), "summary").otherwise("other")
    decision = F.when(f == 0, "false_merge").when(f == 1, "unsure").when(f == 2, "noise").when(f == 3, "mixed").otherwise("none")
    line = F.to_json(F.struct(
        F.lit("1").alias("schema_version"), kind.alias("kind"), i.cast("string").alias("event_id"), decision.alias("label_decision"), F.lit("a").alias("annotator_id"), F.lit("2024-01-01T00:00:00Z").alias("annotated_at"),
        F.when(F.col("quality") == 1, "key").alias("observation_key"), F.when(i % 4 < 3, "top_5").otherwise("top_7").alias("expected_rank_bucket"), F.lit(True).alias("citation_adequate"), F.when(f == 4, 9).otherwise(i % 5).alias("overall_quality"),
    ))
    rows = labels.select(F.concat(F.lit("f"), f.cast("string")).alias("file"), F.when(i % 11 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("line"))
    parsed = F.from_json("line", f"{LABEL}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("r", parsed).withColumn("told", F.when(F.col("r")["_bad"].isNotNull(), F.array(F.lit("invalid json"))).otherwise(label_errors(F.col("r"))))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.size("told") == 0).alias("valid"), F.sum(F.size("told")).alias("errors"))


@stored("T2_backfill_cursor", sql="WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT start, event_type, n FROM w WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 90 MINUTE FROM events)")
def t2(spark, sf_dir):
    """Windows that the cursor has passed: it lags 90 minutes behind the newest row, and the checkpoint keeps it."""
    stream = T.file_stream(spark, f"{sf_dir}/events.parquet*")
    counts = T.windowed_counts(stream, "ts", "6 hours", None, "event_type", late="90 minutes")
    return T.run_available(counts, "t2").select("start", "event_type", "n")


@stored("T5_late_rows", sql="SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def t5(spark, sf_dir):
    """Rows of one file after the other, the newest file first, so that most rows are late: no row is dropped, and an older one never replaces a newer one."""
    parts = T.shared_folder(spark, "t5-files")
    events = view(spark, sf_dir, "events")
    for k in (1, 0):
        events.filter(F.col("event_id") % 2 == k).orderBy(F.desc("ts")).coalesce(1).write.mode("append").parquet(parts)

    def step(batch):
        return batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("r"))

    return T.upsert_stream(T.file_stream(spark, parts, 1), "t5", step, ["user_id"], {"r": "greatest"}).select("user_id", "r.event_type", "r.value", "r.ts")


@stored("T9_interval_job", sql="SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t9(spark, sf_dir):
    """A job on an interval (one second here), stopped when nothing is left to do."""
    stream = T.file_stream(spark, f"{sf_dir}/events.parquet*")

    def step(batch):
        return batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    return T.upsert_stream(stream, "t9", step, ["event_type"], {"n": "sum"}, every="1 second")
