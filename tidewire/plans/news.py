"""Queries of the rules over news texts (F7 to F51) and of the joins that use them, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import news as N
from tidewire.functions import scalars as S
from tidewire.operators import matching
from tidewire.plans.registry import query

TEXT = "lower(concat(title, '. ', coalesce(description, '')))"


def text():
    return F.concat(F.col("title"), F.lit(". "), F.coalesce("description", F.lit("")))


quoted = lambda x: "'" + x.replace("'", "''") + "'"
listed = lambda xs: "[" + ", ".join(map(quoted, xs)) + "]"
some = lambda c, xs: f"len(list_filter({listed(xs)}, lambda w: contains({c}, w))) > 0"
count = lambda c, xs: f"len(list_filter({listed(xs)}, lambda w: contains({c}, w)))"
groups = lambda c, g: "list_filter([" + ", ".join(f"CASE WHEN {some(c, v)} THEN '{k}' END" for k, v in g.items()) + "], lambda x: x IS NOT NULL)"
WORDS = lambda c: f"list_filter(list_distinct(regexp_extract_all({c}, '[a-z][a-z\\-]{{3,}}')), lambda x: NOT list_contains({listed(N.STOPWORDS)}, x))"


@query("F7_event_anchors", "reports_v", sql=f"SELECT doc_id, {groups(TEXT, N.EVENT_ANCHORS)} AS anchors FROM reports_v")
def f7(reports):
    return reports.select("doc_id", N.anchors(text()).alias("anchors"))


@query("F8_anchor_conflict", "reports_v", sql=f"""WITH a AS (SELECT doc_id, {groups('lower(title)', N.EVENT_ANCHORS)} AS a, {groups('lower(description)', N.EVENT_ANCHORS)} AS b FROM reports_v),
 p AS (SELECT unnest({listed(x for x, _ in N.ANCHOR_CONFLICTS)}) AS x, unnest({listed(y for _, y in N.ANCHOR_CONFLICTS)}) AS y)
 SELECT doc_id, EXISTS (SELECT 1 FROM p WHERE (list_contains(a, x) AND list_contains(b, y)) OR (list_contains(a, y) AND list_contains(b, x))) AS conflict FROM a""")
def f8(reports):
    return reports.select("doc_id", N.anchor_conflict(N.anchors("title"), N.anchors("description")).alias("conflict"))


POLES = ", ".join(f"CASE WHEN {some('t', p)} AND NOT {some('t', n)} THEN '{k}:positive' WHEN {some('t', n)} AND NOT {some('t', p)} THEN '{k}:negative' END" for k, (p, n) in N.STATUS.items())


@query("F11_labels_and_status", "reports_v", sql=f"SELECT doc_id, {groups('t', N.FRAMING_LABELS)} AS labels, list_sort(list_filter([{POLES}], lambda x: x IS NOT NULL)) AS status FROM (SELECT doc_id, {TEXT} AS t FROM reports_v)")
def f11(reports):
    status = F.transform(F.map_entries(N.status_markers(text())), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return reports.select("doc_id", N.framing_labels(text()).alias("labels"), F.sort_array(status).alias("status"))


@query("F12_numbers_and_snippet", "reports_v", sql=f"""SELECT doc_id, list_transform(regexp_extract_all(title, '\\b\\d[\\d,]*(?:\\.\\d+)?\\b'), lambda x: replace(x, ',', '')) AS numbers,
 array_to_string(list_filter(regexp_extract_all({TEXT}, '[a-z0-9][a-z0-9\\-'']*'), lambda w: NOT list_contains({listed(N.STOPWORDS)}, w))[:18], ' ') AS snippet FROM reports_v""")
def f12(reports):
    return reports.select("doc_id", S.numbers("title").alias("numbers"), N.snippet(text()).alias("snippet"))


NAMES = sorted({*N.COUNTRY_ALIASES, *N.COUNTRY_ALIASES.values()}, key=lambda n: (-len(n), n))
ALIAS = "CASE c " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in N.COUNTRY_ALIASES.items()) + " ELSE c END"


@query("F14_countries_in_text", "reports_v", sql=f"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all({TEXT}, '\\b(?:{'|'.join(n.replace('.', chr(92) + '.').replace("'", "''") for n in NAMES)})\\b')) AS c,
 generate_subscripts(regexp_extract_all({TEXT}, '\\b(?:{'|'.join(n.replace('.', chr(92) + '.').replace("'", "''") for n in NAMES)})\\b'), 1) AS i FROM reports_v),
 g AS (SELECT doc_id, {ALIAS} AS c, min(i) AS i FROM f GROUP BY 1, 2)
 SELECT doc_id, list(c ORDER BY i) AS countries FROM g GROUP BY doc_id""")
def f14(reports):
    found = matching.with_matches(reports.select("doc_id", N.lower(text()).alias("t")), F.col("t"), NAMES, words=True)
    return found.select("doc_id", N.countries_found(matching.names_of("matches")).alias("countries")).filter(F.size("countries") > 0)


TWO = f"{count('t', N.TOPIC_KEYWORDS['geopolitics'])} AS g, {count('t', N.TOPIC_KEYWORDS['economics'])} AS e"
#: centroids of the two topics where no keyword occurs: two opposite directions of the stored vectors
CENTROIDS = {"geopolitics": [1.0, -1.0] * 32, "economics": [-1.0, 1.0] * 32}
NEAR = "round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) * 64), 9)"


@query("F15_topics", "reports_v", "embeddings", sql=f"""WITH r AS (SELECT doc_id, {TWO}, {NEAR} AS c FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 10 THEN '' ELSE lower(concat_ws(' ', title, description, source)) END AS t, embedding FROM reports_v LEFT JOIN embeddings ON vec_id = doc_id))
 SELECT doc_id, CASE WHEN g = 0 AND e = 0 THEN CASE WHEN c >= 0.1 THEN ['geopolitics'] WHEN c <= -0.1 THEN ['economics'] ELSE [] END
  WHEN g >= e THEN CASE WHEN e >= g - 1 AND e >= 3 THEN ['geopolitics', 'economics'] ELSE ['geopolitics'] END
  ELSE CASE WHEN g >= e - 1 AND g >= 3 THEN ['economics', 'geopolitics'] ELSE ['economics'] END END AS topics FROM r""")
def f15(reports, embeddings):
    """One report in eleven has no words here, so that its stored vector decides."""
    rows = reports.join(embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    words = F.when(F.col("doc_id") % 11 == 10, "").otherwise(F.concat_ws(" ", "title", "description", "source"))
    keywords = [w for v in N.TOPIC_KEYWORDS.values() for w in v]
    rows = matching.with_matches(rows.select("doc_id", "embedding", N.lower(words).alias("t")), F.col("t"), keywords)
    return rows.select("doc_id", N.topic_or_nearest(N.topics_found(matching.names_of("matches")), F.transform("embedding", lambda x: x.cast("double")), CENTROIDS, 0.1).alias("topics"))


REGISTERED = "CASE trust_tier WHEN 'tier_1' THEN 1.45 WHEN 'tier_2' THEN 1.1 WHEN 'tier_3' THEN 0.45 ELSE 1.0 END * CASE kind WHEN 'official_update' THEN 1.4 WHEN 'article' THEN 1.0 ELSE 1.25 END"
MULTIPLIER = "0.65 + 0.9 * (CAST(substr(source_name, 4) AS INT) % 8) / 8.0"
PROFILES = f"SELECT source_name, region, round({REGISTERED} * CASE WHEN CAST(substr(source_name, 4) AS INT) % 3 = 0 THEN 1.0 ELSE {MULTIPLIER} END, 2) AS weight FROM (SELECT *, CASE source_type WHEN 'official' THEN 'official_update' WHEN 'news' THEN 'article' ELSE 'structured_event' END AS kind FROM registry_v)"


def profiles(registry):
    """Weight of each registered source; a third of them has no measured reliability yet."""
    kind = F.when(F.col("source_type") == "official", "official_update").when(F.col("source_type") == "news", "article").otherwise("structured_event")
    number = F.substring("source_name", 4, 9).cast("int")
    measured = F.when(number % 3 != 0, F.lit(0.65) + F.lit(0.9) * (number % 8) / 8.0)
    return registry.select("source_name", "region", N.quality_weight(F.col("trust_tier"), kind, measured).alias("weight"))


@query("F24_source_profiles", "registry_v", sql=PROFILES)
def f24(registry):
    return profiles(registry)


LOUD = " + ".join(f"CAST(regexp_matches(lower(title), '\\b{w}\\b') AS INT)" for w in N.SENSATIONAL)
SHARED = "len(list_filter({own}, lambda w: list_contains({all}, w)))"


@query("F23_consensus_title", "reports_v", "registry_v", sql=f"""WITH p AS ({PROFILES}), r AS (SELECT doc_id, place, source, title, {WORDS('lower(title)')} AS k, {groups('lower(title)', N.EVENT_ANCHORS)} AS a FROM reports_v),
 kc AS (SELECT place, w, count(*) - 1 AS n FROM (SELECT place, unnest(k) AS w FROM r) GROUP BY 1, 2), ac AS (SELECT place, w, count(*) - 1 AS n FROM (SELECT place, unnest(a) AS w FROM r) GROUP BY 1, 2),
 ks AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, place, unnest(k) AS w FROM r) JOIN kc USING (place, w) GROUP BY 1), az AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, place, unnest(a) AS w FROM r) JOIN ac USING (place, w) GROUP BY 1),
 s AS (SELECT place, doc_id, title, round(coalesce(weight, 0.95) * 4.0 + coalesce(ks.n, 0) * 0.32 + coalesce(az.n, 0) * 1.25
  + CASE WHEN length(title) BETWEEN 28 AND 110 THEN 3.0 WHEN length(title) < 18 THEN -3.0 WHEN length(title) > 130 THEN -least((length(title) - 130) / 10.0, 6.0) ELSE 0 END
  - (len({groups('lower(title)', N.FRAMING_LABELS)}) * 2.8 + ({LOUD}) * 1.2 + CASE WHEN regexp_matches(title, '[?!]') THEN 1.5 ELSE 0 END), 3) AS score FROM r LEFT JOIN p ON source = source_name LEFT JOIN ks USING (doc_id) LEFT JOIN az USING (doc_id))
 SELECT place, arg_min(title, (-score, doc_id)) AS title, max(score) AS score FROM s GROUP BY place""")
def f23(reports, registry):
    """The title that best stands for all reports of a place; the first of equal ones."""
    rows = reports.select("doc_id", "place", "source", "title", N.keywords("title").alias("k"), N.anchors("title").alias("a"))
    scored = rows.join(profiles(registry).withColumnRenamed("source_name", "source"), "source", "left")
    for name in ("k", "a"):
        words = rows.select("doc_id", "place", F.explode(name).alias("w"))
        shared = words.groupBy("place", "w").agg((F.count(F.lit(1)) - 1).alias("n"))
        scored = scored.join(words.join(shared, ["place", "w"]).groupBy("doc_id").agg(F.sum("n").alias(f"{name}_n")), "doc_id", "left")
    score = N.title_score("title", F.coalesce("weight", F.lit(0.95)), F.coalesce("k_n", F.lit(0)), F.coalesce("a_n", F.lit(0)))
    return scored.withColumn("score", score).groupBy("place").agg(F.min_by("title", F.struct(-F.col("score"), F.col("doc_id"))).alias("title"), F.max("score").alias("score"))


TYPES = " ".join(f"WHEN len(list_intersect(a, {listed(a)})) > 0 OR {some('lower(title)', w)} THEN '{k}'" for k, (a, w) in N.STORY_TYPES.items())


@query("F28_event_types", "reports_v", sql=f"""SELECT doc_id, CASE {TYPES} ELSE 'political' END AS story_type, CASE WHEN {some('t', N.STRONG_CONFLICT)} THEN 2 WHEN {some('t', N.WEAK_CONFLICT)} THEN 1 ELSE 0 END AS strength
 FROM (SELECT doc_id, title, {TEXT} AS t, {groups(TEXT, N.EVENT_ANCHORS)} AS a FROM reports_v)""")
def f28(reports):
    return reports.select("doc_id", N.story_type("title", N.anchors(text())).alias("story_type"), N.conflict_strength(text()).alias("strength"))


#: stories of places: a row for each place and day with its reports
KEY = "regexp_replace(lower(place), '[^a-z0-9]+', ' ', 'g')"
INDEX = {"washington dc": (38.9072, -77.0369), "washington state": (47.7511, -120.7401), "iran": (32.4, 53.7), "moscow": (55.75, 37.6), "kyiv": (50.45, 30.5), "china": (35.9, 104.2), "damascus": (33.5, 36.3), "ankara": (39.9, 32.9), "south korea": (36.5, 127.8)}
INDEX_SQL = "(VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in INDEX.items()) + ") i(key, lat, lon)"
WASHINGTON = f"CASE WHEN k <> 'washington' THEN k WHEN {some('t', N.CAPITAL)} THEN 'washington dc' WHEN {some('t', N.STATE)} THEN 'washington state' END"


def place_index(df):
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(a).alias("lat"), F.lit(b).alias("lon")) for k, (a, b) in INDEX.items()])
    return df.sparkSession.range(1).select(F.explode(rows).alias("i")).select("i.*")


@query("F32_resolved_places", "reports_v", sql=f"SELECT doc_id, key, lat, lon FROM (SELECT doc_id, {WASHINGTON} AS key FROM (SELECT doc_id, trim({KEY}) AS k, {TEXT} AS t FROM reports_v)) JOIN {INDEX_SQL} USING (key)")
def f32(reports):
    key = N.washington(N.place_key("place"), text())
    return reports.select("doc_id", key.alias("key")).join(place_index(reports), "key")


@query("J26_place_vote", "reports_v", sql=f"""WITH e AS (SELECT doc_id, topic, CAST(published_at AS DATE) AS day, title, {TEXT} AS t, trim({KEY}) AS k, row_number() OVER (PARTITION BY topic, CAST(published_at AS DATE) ORDER BY published_at, doc_id) AS pos FROM reports_v),
 f AS (SELECT topic, day, any_value(label) OVER (PARTITION BY topic, day) AS label, k, t, title FROM (SELECT *, first_value(title) OVER (PARTITION BY topic, day ORDER BY pos) AS label FROM e) WHERE pos <= 12),
 s AS (SELECT topic, day, {WASHINGTON} AS key, k, label, title FROM f WHERE k NOT IN ('us', 'usa', 'nato', 'united states')),
 v AS (SELECT topic, day, key, bool_or(contains(lower(label), k)) AS named, sum(CASE WHEN contains(lower(label), k) THEN 2 WHEN contains(lower(title), k) THEN 1 ELSE 0.5 END) AS score FROM s JOIN {INDEX_SQL} USING (key) GROUP BY 1, 2, 3)
 SELECT topic, day, arg_min(key, (NOT named, -score, key)) AS key, arg_min(CAST(score AS DOUBLE), (NOT named, -score, key)) AS score FROM v GROUP BY 1, 2""")
def j26(reports):
    """Places of the first 12 reports of each story (topic and day): 2 in the label, 1 in the headline, else a half; places of the label first."""
    order = Window.partitionBy("topic", "day").orderBy("published_at", "doc_id")
    rows = reports.withColumn("day", F.to_date("published_at")).withColumns({"pos": F.row_number().over(order), "label": F.lower(F.first("title").over(order))}).filter("pos <= 12")
    name = N.place_key("place")
    rows = rows.withColumn("k", name).filter(~F.col("k").isin("us", "usa", "nato", "united states")).withColumn("key", N.washington(F.col("k"), text())).join(place_index(reports), "key")
    points = F.when(F.contains("label", "k"), 2.0).when(F.contains(F.lower("title"), "k"), 1.0).otherwise(0.5)
    votes = rows.groupBy("topic", "day", "key").agg(F.bool_or(F.contains("label", "k")).alias("named"), F.sum(points).alias("score"))
    best = F.struct(~F.col("named"), -F.col("score"), F.col("key"))
    return votes.groupBy("topic", "day").agg(F.min_by("key", best).alias("key"), F.min_by("score", best).alias("score"))


@query("J11_article_country", "reports_v", sql=f"""WITH g AS ({"SELECT * FROM (VALUES " + ", ".join(f"({quoted(n)})" for n in NAMES) + ") n(name)"}),
 r AS (SELECT doc_id, {TEXT} AS t, lower(place) AS gpe, doc_id % 3 = 0 AS tagged FROM reports_v),
 m AS (SELECT doc_id, arg_min(name, (-length(name), name)) AS name FROM r JOIN g ON contains(t, name) GROUP BY 1)
 SELECT doc_id, {ALIAS.replace('CASE c', 'CASE n').replace('ELSE c', 'ELSE n')} AS country FROM (SELECT doc_id, coalesce(CASE WHEN tagged AND gpe IN (SELECT name FROM g) THEN gpe END, name) AS n FROM r LEFT JOIN m USING (doc_id)) WHERE n IS NOT NULL""")
def j11(reports):
    """The tagged place if it is in the gazetteer, else the longest gazetteer name in the text."""
    found = matching.with_matches(reports.select("doc_id", "place", N.lower(text()).alias("t")), F.col("t"), NAMES)
    tagged = F.when((F.col("doc_id") % 3 == 0) & F.lower("place").isin(*NAMES), F.lower("place"))
    name = F.coalesce(tagged, matching.longest_name("matches"))
    table = F.create_map(*[F.lit(x) for kv in N.COUNTRY_ALIASES.items() for x in kv])
    return found.select("doc_id", name.alias("name")).filter("name IS NOT NULL").select("doc_id", F.coalesce(F.try_element_at(table, "name"), "name").alias("country"))


@query("F35_story_summary", "reports_v", sql="""WITH r AS (SELECT doc_id, place, title, unnest([substr(description, 1, 200), title, regexp_extract(description, '^[^.]*[.]', 0)]) AS s FROM reports_v),
 c AS (SELECT *, least(length(s), 220) - CASE WHEN length(s) < 28 THEN 120 ELSE 0 END - CASE WHEN lower(s) = lower(title) THEN 400 ELSE 0 END - greatest(length(s) - 210, 0) + CASE WHEN regexp_matches(s, '[.!?;] ') THEN 16 ELSE 0 END AS score FROM r WHERE length(s) > 0)
 SELECT place, arg_min(s, (-score, doc_id, s)) AS summary, max(score) AS score FROM c GROUP BY place""")
def f35(reports):
    """The best candidate of each place: the lead cut at 200, the title, the first sentence."""
    candidates = F.explode(F.array(F.substring("description", 1, 200), F.col("title"), F.regexp_extract("description", r"^[^.]*[.]", 0)))
    rows = reports.select("doc_id", "place", "title", candidates.alias("s")).filter("length(s) > 0").withColumn("score", N.summary_score(F.col("s"), F.col("title")))
    return rows.groupBy("place").agg(F.min_by("s", F.struct(-F.col("score"), F.col("doc_id"), F.col("s"))).alias("summary"), F.max("score").alias("score"))


TOKENS = lambda c: f"list_filter(list_distinct(regexp_extract_all({c}, '[a-z0-9][a-z0-9_-]+')), lambda x: length(x) > 2 AND NOT list_contains({listed(N.ASSIGNMENT_STOPWORDS)}, x))"


@query("F38_assignment_evidence", "reports_v", sql=f"""WITH e AS (SELECT place, max(published_at) AS latest, arg_max(title, (published_at, doc_id)) AS label FROM reports_v GROUP BY place),
 r AS (SELECT doc_id, lower(concat_ws(' ', title, description)) AS t, label, lower(place) AS ent, {groups('lower(label)', N.EVENT_ANCHORS)} AS anc, epoch(latest - published_at) / 3600.0 AS gap FROM reports_v JOIN e USING (place)),
 o AS (SELECT doc_id, gap, CAST(contains(t, ent) AS INT) AS ents, len(list_filter(anc, lambda a: contains(t, a))) AS ancs, len(list_intersect({TOKENS('t')}, list_distinct(list_concat({TOKENS('lower(label)')}, {TOKENS('ent')}, list_filter(anc, lambda a: length(a) > 2))))) AS words FROM r),
 s AS (SELECT *, round(ents * 1.9 + ancs * 2.1 + words * 0.7 + greatest(0.0, 2.8 - gap / 30.0), 3) AS score FROM o)
 SELECT doc_id, ents AS entity_overlap, ancs AS anchor_overlap, words AS keyword_overlap, score AS final_score, CASE WHEN ancs >= 1 AND ents >= 1 AND gap <= 120 THEN 'anchor_entity_temporal' WHEN ents >= 2 AND words >= 2 AND gap <= 120 THEN 'entity_keyword_temporal'
  WHEN ancs >= 1 AND words >= 3 AND gap <= 72 THEN 'anchor_keyword_compact' WHEN score >= 4.1 THEN 'score_threshold' ELSE 'fallback_in_cluster' END AS rule FROM s""")
def f38(reports):
    """Each report against the newest report of its place as the event."""
    event = reports.groupBy("place").agg(F.max("published_at").alias("latest"), F.max_by("title", F.struct("published_at", "doc_id")).alias("label"))
    rows = reports.join(event, "place").withColumns({"t": F.lower(F.concat_ws(" ", "title", "description")), "anc": N.anchors("label"), "gap": (F.unix_seconds("latest") - F.unix_seconds("published_at")) / 3600.0})
    event_words = F.array_distinct(F.concat(N.assignment_tokens("label"), N.assignment_tokens("place"), F.filter("anc", lambda a: F.length(a) > 2)))
    rows = rows.select(
        "doc_id", "gap", F.contains("t", F.lower("place")).cast("int").alias("entity_overlap"), F.size(F.filter("anc", lambda a: F.contains(F.col("t"), a))).alias("anchor_overlap"),
        F.size(F.array_intersect(N.assignment_tokens("t"), event_words)).alias("keyword_overlap"),
    )
    args = [F.col(c) for c in ("entity_overlap", "anchor_overlap", "keyword_overlap", "gap")]
    rows = rows.withColumn("final_score", N.assignment_score(*args))
    return rows.withColumn("rule", N.assignment_rule(*args, F.col("final_score"))).drop("gap")


@query("F39_analysis_priority", "claims_v", "registry_v", sql="""WITH e AS (SELECT event_key, count(*) AS n, count(DISTINCT source_name) AS sources, count(DISTINCT CASE WHEN claim_type = 'fact' THEN source_name END) AS tier1, count(DISTINCT CASE WHEN claim_type = 'timeline' THEN source_name END) AS official,
  count(*) FILTER (WHERE resolution_status = 'contradicted') AS against, count(*) FILTER (WHERE resolution_status = 'unresolved') AS open, sum(claim_value) AS quality FROM claims_v GROUP BY event_key)
 SELECT event_key, round(quality * 2.0 + tier1 * 1.8 + official * 1.6 + 0 * 1.2 - 0 * 1.4 + sources * 1.2 + n * 1.2 + against * 2.4 + open * 1.7, 2) AS priority FROM e""")
def f39(claims, registry):
    e = claims.groupBy("event_key").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source_name").alias("sources"), F.countDistinct(F.when(F.col("claim_type") == "fact", F.col("source_name"))).alias("tier1"),
        F.countDistinct(F.when(F.col("claim_type") == "timeline", F.col("source_name"))).alias("official"), F.count_if(F.col("resolution_status") == "contradicted").alias("against"),
        F.count_if(F.col("resolution_status") == "unresolved").alias("open"), F.sum("claim_value").alias("quality"),
    )
    return e.select("event_key", analysis_priority(F.col("quality"), F.col("tier1"), F.col("official"), F.lit(0), F.lit(0), F.col("sources"), F.col("n"), F.col("against"), F.col("open")).alias("priority"))


def analysis_priority(quality, tier1, official, structured, channels, sources, articles, contradictions, fractures):
    """weighted counts of an event; monitored channels count against it."""
    return F.round(quality * 2.0 + tier1 * 1.8 + official * 1.6 + structured * 1.2 - channels * 1.4 + sources * 1.2 + articles * 1.2 + contradictions * 2.4 + fractures * 1.7, 2)


BRIEFING = "concat('SITUATION REPORT: ', title, chr(10), 'PREDICTIONS:', chr(10), '1. ', title, '.', chr(10), '- ', regexp_replace(description, '[\\n\\r]+', ' ', 'g'), chr(10), 'Short', chr(10), 'WHAT TO WATCH: Monitor ', place, ' in coming weeks', chr(10), 'DEEPER CONTEXT: none')"
MARKS = lambda c, table: " ".join(f"WHEN {some(c, v)} THEN '{k}'" for k, v in table.items())


def briefings(reports):
    line = F.regexp_replace("description", r"[\n\r]+", " ")
    body = F.concat(F.lit("SITUATION REPORT: "), "title", F.lit("\nPREDICTIONS:\n1. "), "title", F.lit(".\n- "), line, F.lit("\nShort\nWHAT TO WATCH: Monitor "), "place", F.lit(" in coming weeks\nDEEPER CONTEXT: none"))
    return reports.select("doc_id", "topic", body.alias("briefing"))


def predictions(rows):
    """a row for each line of the two sections that look ahead: (…, section, line, horizon_days, confidence, type, subjects)."""
    parts = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(d).alias("days"), N.section("briefing", n).alias("text")) for n, d in (("PREDICTIONS", 30), ("WHAT TO WATCH", 14))])
    rows = rows.withColumn("p", F.explode(parts)).withColumn("line", F.explode(N.prediction_lines(F.col("p")["text"])))
    other = F.when(F.col("p")["section"] == "WHAT TO WATCH", "low").otherwise("medium")
    return rows.withColumns({
        "section": F.col("p")["section"], "horizon_days": N.horizon_days("line", F.col("p")["days"]), "confidence": F.coalesce(N.first_group("line", N.CONFIDENCE), other),
        "type": N.first_group("line", N.PREDICTION_TYPES, "general"), "subjects": N.prediction_subjects(F.col("line")),
    }).drop("p", "briefing")


LINES = f"""SELECT doc_id, 'PREDICTIONS' AS section, 30 AS d, trim(title, ' .') AS line, title FROM reports_v UNION ALL SELECT doc_id, 'PREDICTIONS', 30, trim(regexp_replace(trim(regexp_replace(description, '[\\n\\r]+', ' ', 'g'), ' '), '^[-*]\\s*', ''), ' .'), title FROM reports_v
 UNION ALL SELECT doc_id, 'WHAT TO WATCH', 14, concat('Monitor ', place, ' in coming weeks'), title FROM reports_v"""
HORIZON = "CASE WHEN regexp_matches(l, 'within\\s+(\\d+)\\s+day') THEN greatest(1, least(365, CAST(regexp_extract(l, 'within\\s+(\\d+)\\s+day', 1) AS INT))) WHEN regexp_matches(l, 'within\\s+(\\d+)\\s+week') THEN greatest(7, least(365, CAST(regexp_extract(l, 'within\\s+(\\d+)\\s+week', 1) AS INT) * 7)) WHEN contains(l, 'coming weeks') THEN 21 ELSE d END"


@query("F40_predictions", "reports_v", sql=f"SELECT doc_id, section, sha256(line) AS line_hash, {HORIZON} AS horizon_days, CASE {MARKS('l', N.CONFIDENCE)} WHEN section = 'WHAT TO WATCH' THEN 'low' ELSE 'medium' END AS confidence, CASE {MARKS('l', N.PREDICTION_TYPES)} ELSE 'general' END AS type FROM (SELECT *, lower(line) AS l FROM ({LINES})) WHERE length(line) >= 12 AND NOT ends_with(line, ':')")
def f40(reports):
    """Predictions of briefings made of each report's title and text."""
    return predictions(briefings(reports)).select("doc_id", "section", F.sha2("line", 256).alias("line_hash"), "horizon_days", "confidence", "type")


@query("F41_prediction_query", "reports_v", sql=f"""WITH s AS (SELECT doc_id, title, CASE {MARKS('lower(title)', N.PREDICTION_TYPES)} ELSE 'general' END AS type, list_filter(regexp_extract_all(title, '\\b(?:[A-Z][a-z]+\\s){{0,3}}[A-Z][a-z]+\\b'), lambda x: length(x) >= 4) AS subj FROM reports_v)
 SELECT doc_id, trim(concat_ws(' ', CASE WHEN doc_id % 2 = 0 AND len(subj) > 0 THEN array_to_string(list_slice(subj, 1, 3), ' ') ELSE array_to_string(list_slice(list_filter(regexp_extract_all(title, '[A-Za-z][A-Za-z-]{{3,}}'), lambda w: NOT list_contains({listed(N.QUERY_FILLER)}, lower(w))), 1, 6), ' ') END,
  CASE type {' '.join(f"WHEN '{k}' THEN '{' '.join(sorted(v)[:2])}'" for k, v in N.PREDICTION_TYPES.items())} ELSE '' END)) AS query FROM s""")
def f41(reports):
    """Every second record has no subjects, so that its words are used."""
    subjects = F.when(F.col("doc_id") % 2 == 0, N.prediction_subjects(F.col("title"))).otherwise(F.array().cast("array<string>"))
    return reports.select("doc_id", N.prediction_query(subjects, F.col("title"), N.first_group("title", N.PREDICTION_TYPES, "general")).alias("query"))


ASKED = "CASE WHEN doc_id % 4 = 0 THEN concat('Why is \"', title, '\" in the news?') WHEN doc_id % 4 = 1 THEN 'What of the news?' ELSE concat('What is happening with ', title, ' and oil trade?') END"


@query("F42_search_focus", "reports_v", sql=f"""WITH q AS (SELECT doc_id, {ASKED} AS q FROM reports_v), w AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(q, '[^A-Za-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains({listed(N.QUERY_STOPWORDS)}, lower(w))) AS w, lower(q) AS l FROM q)
 SELECT doc_id, CASE WHEN contains(q, '"') THEN trim(regexp_extract(q, '"([^"]{{4,}})"', 1)) WHEN len(w) > 0 THEN array_to_string(w[:8], ' ') ELSE trim(q) END AS focus,
  CASE WHEN {count('l', N.QUERY_TOPICS['economics'])} > {count('l', N.QUERY_TOPICS['geopolitics'])} THEN 'economics' WHEN {count('l', N.QUERY_TOPICS['geopolitics'])} > 0 THEN 'geopolitics' END AS topic FROM w""")
def f42(reports):
    q = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('Why is "'), "title", F.lit('" in the news?'))).when(F.col("doc_id") % 4 == 1, "What of the news?").otherwise(F.concat(F.lit("What is happening with "), "title", F.lit(" and oil trade?")))
    return reports.select("doc_id", N.search_focus(q).alias("focus"), N.query_topic(q).alias("topic"))


@query("F50_hotspot_facets", "structured_v", "nation", sql=f"""WITH h AS (SELECT event_id, lower(event_type) AS t, CASE event_id % 5 WHEN 0 THEN 'Iran' WHEN 1 THEN 'Ukraine' WHEN 2 THEN 'Sudan' WHEN 3 THEN 'Peru' ELSE country END AS country FROM structured_v)
 SELECT event_id, CASE {MARKS('t', N.HOTSPOT_ASPECTS)} ELSE 'default' END AS aspect, CASE {MARKS('lower(country)', N.CONTINENTS)} END AS continent FROM h WHERE contains(lower(country), 'n')""")
def f50(structured, nation):
    """Aspect and continent of each hotspot whose country has the searched text."""
    k = F.col("event_id") % 5
    country = F.when(k == 0, "Iran").when(k == 1, "Ukraine").when(k == 2, "Sudan").when(k == 3, "Peru").otherwise(F.col("country"))
    rows = structured.select("event_id", "event_type", country.alias("country")).filter(F.contains(F.lower("country"), F.lit("n")))
    return rows.select("event_id", N.first_group("event_type", N.HOTSPOT_ASPECTS, "default").alias("aspect"), N.first_group("country", N.CONTINENTS).alias("continent"))


BARE = f"(lower(et) = 'battles' AND NOT {some('s', ['fight', 'assault', 'attack', 'raid', 'guerrilla', 'artillery', 'air'])})"
ACTION = " ".join(f"WHEN {some('s', v)} THEN '{k}'" if i != 1 else f"WHEN {some('s', v)} THEN '{k}' WHEN {BARE} THEN 'Conflict incident'" for i, (k, v) in enumerate(N.ACTIONS))
SUMMARIES = "CASE event_id % 4 WHEN 0 THEN concat(event_type, ' reported in ', country, ' on ', CAST(event_date AS VARCHAR), '.') WHEN 1 THEN concat('Troops killed two people in ', country, '. (high-intensity conflict event) Covered by 3 sources with 12 mentions.') WHEN 2 THEN concat('Talks on a treaty held in ', country, ' (CAMEO 036, root 03) [036]') ELSE concat('Reported by 2 sources. ', country) END"
CLEAN = "regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(s0, '\\s*\\(CAMEO\\s+\\d+,?\\s*root\\s+\\d+\\)', '', 'g')), '\\s*\\[?\\d{3}\\]?\\s*$', '', 'g')), '(?i)[\\s.]*\\(?(high|medium|low)[- ]intensity\\s+(conflict|escalatory|cooperative)\\s+event\\)?\\.?', '', 'g')), '(?i)[\\s.]*covered by \\d+\\s+sources? with \\d+\\s+mentions?\\.?', '', 'g')), '(?i)[\\s.]*reported by \\d+\\s+sources?\\.?', '', 'g')), '[,. ]+$', '')"


@query("F51_incident_action", "structured_v", sql=f"""WITH e AS (SELECT event_id, event_type AS et, {SUMMARIES} AS s0 FROM structured_v), c AS (SELECT event_id, et, {CLEAN} AS clean, lower(concat_ws(' ', et, s0)) AS s FROM e)
 SELECT event_id, CASE {ACTION} WHEN lower(et) = 'strategic developments' THEN 'Strategic development' ELSE et END AS action, clean AS summary, regexp_full_match(clean, '[\\w/ ]+\\s+reported\\s+in\\s+[\\w,.\\s-]+\\s+on\\s+\\d{{4}}-\\d{{2}}-\\d{{2}}\\.?\\s*') AS template, length(clean) > 30 AND {some('lower(clean)', N.NARRATIVE)} AS narrative FROM c""")
def f51(structured):
    k = F.col("event_id") % 4
    said = (
        F.when(k == 0, F.concat("event_type", F.lit(" reported in "), "country", F.lit(" on "), F.col("event_date").cast("string"), F.lit(".")))
        .when(k == 1, F.concat(F.lit("Troops killed two people in "), "country", F.lit(". (high-intensity conflict event) Covered by 3 sources with 12 mentions.")))
        .when(k == 2, F.concat(F.lit("Talks on a treaty held in "), "country", F.lit(" (CAMEO 036, root 03) [036]"))).otherwise(F.concat(F.lit("Reported by 2 sources. "), "country"))
    )
    rows = structured.select("event_id", "event_type", said.alias("said")).withColumn("summary", N.clean_summary(F.col("said")))
    return rows.select("event_id", N.action_label(F.col("event_type"), F.lit(""), F.col("said")).alias("action"), "summary", N.is_template(F.col("summary")).alias("template"), N.is_narrative(F.col("summary")).alias("narrative"))


@query("F33_labels_and_summaries", "structured_v", sql="""WITH c AS (SELECT country, event_type, count(*) AS n, sum(fatalities) AS dead, min(event_date) AS first, max(event_date) AS last, list_sort(list(DISTINCT actor_primary))[:3] AS actors FROM structured_v GROUP BY 1, 2)
 SELECT country, event_type, CASE WHEN len(actors) >= 2 THEN concat(event_type, ' in ', country, ': ', actors[1], ' and ', actors[2]) ELSE concat(event_type, ' in ', country) END AS label,
  concat(n, CASE WHEN n = 1 THEN ' report of ' ELSE ' reports of ' END, lower(event_type), ' in ', country, ' from ', CAST(first AS VARCHAR), ' to ', CAST(last AS VARCHAR), CASE WHEN dead > 0 THEN concat(', ', dead, ' fatalities') ELSE '' END, '.') AS summary FROM c""")
def f33(structured):
    c = structured.groupBy("country", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fatalities").alias("dead"), F.min("event_date").cast("string").alias("first"), F.max("event_date").cast("string").alias("last"),
        F.slice(F.sort_array(F.collect_set("actor_primary")), 1, 3).alias("actors"),
    )
    where = F.concat("event_type", F.lit(" in "), "country")
    label = F.when(F.size("actors") >= 2, F.concat(where, F.lit(": "), F.col("actors")[0], F.lit(" and "), F.try_element_at("actors", F.lit(2)))).otherwise(where)
    dead = F.when(F.col("dead") > 0, F.concat(F.lit(", "), F.col("dead").cast("string"), F.lit(" fatalities"))).otherwise("")
    text = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " report of ").otherwise(" reports of "), F.lower("event_type"), F.lit(" in "), "country", F.lit(" from "), "first", F.lit(" to "), "last", dead, F.lit("."))
    return c.select("country", "event_type", label.alias("label"), text.alias("summary"))
