"""Queries of the country indices (A11-A19, W4, P23) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import aggregates as A
from tidewire.operators import indices as I
from tidewire.plans.registry import query
from tidewire.plans.views import AS_OF

T = f"TIMESTAMP '{AS_OF}'"
#: the mentions end on the 30th, the articles of small tables before it
MENTIONS_AS_OF = "2024-01-30 00:00:00"
TM = f"TIMESTAMP '{MENTIONS_AS_OF}'"
HOURS = 720
SIG = "CASE WHEN ({v}) <= 0 THEN 0.0 ELSE 100.0 / (1.0 + exp(-4.0 * ((({v}) - {m}) / {m}))) END"
SEV = "CASE event_type WHEN 'Battles' THEN 3.0 WHEN 'Violence against civilians' THEN 4.0 WHEN 'Explosions/Remote violence' THEN 3.5 WHEN 'Protests' THEN 1.0 WHEN 'Riots' THEN 1.5 WHEN 'Strategic developments' THEN 2.0 ELSE 1.0 END"
C = "lower(trim(regexp_extract({}, '^([^(\\-:]*)', 1)))"
RECENCY = f"greatest(0.0, 1.0 - least(greatest(0.0, (epoch_us({T}) - epoch_us(published_at)) / 3.6e9) / {HOURS}.0, 1.0))"
SPIKE = f"""spike AS (SELECT entity, min(entity_type) FILTER (WHERE mentioned_at > {TM} - INTERVAL 2 DAY) AS entity_type,
 count(*) FILTER (WHERE mentioned_at > {TM} - INTERVAL 2 DAY) AS recent, count(*) FILTER (WHERE mentioned_at <= {TM} - INTERVAL 2 DAY AND mentioned_at > {TM} - INTERVAL 7 DAY) AS base FROM mentions_v GROUP BY entity),
spikes AS (SELECT entity, entity_type, recent, base, CASE WHEN base = 0 THEN recent * 2.0 ELSE recent / (base / 3.5) END AS spike_ratio FROM spike WHERE recent > 0)"""

CONFLICT = f"SELECT {C.format('country')} AS country, count(*) AS event_count, CAST(sum(fatalities) AS BIGINT) AS fatalities, sum({SEV}) AS weighted_count FROM structured_v GROUP BY 1"
SEVERE = f"SELECT {C.format('country')} AS country, CAST(sum(fatalities) AS BIGINT) AS total_fatalities, count(*) FILTER (WHERE fatalities >= 10) AS high_fatality_events FROM structured_v GROUP BY 1"
MEDIA = f"SELECT lower(region) AS country, sum(1.0 + 1.5 * {RECENCY}) AS weighted_articles, count(DISTINCT a.source_domain) AS source_count FROM articles_v a JOIN registry_v r USING (source_domain) WHERE published_at >= {T} - INTERVAL {HOURS} HOUR AND region <> 'global' GROUP BY 1"
FOG = f"SELECT {C.format('name')} AS country, CAST(sum(contradiction_count) AS BIGINT) AS contradiction_count, count(*) AS event_count FROM (SELECT event_key, contradiction_count, arg_min(lower(n_name), n_nationkey) AS name FROM disputes_v JOIN nation ON contains(event_label, lower(n_name)) GROUP BY 1, 2) GROUP BY 1"
MOVED = f"SELECT {C.format('n_name')} AS country, avg(spike_ratio) AS avg_ratio, count(*) AS spikes FROM spikes JOIN nation ON entity = concat('E', n_nationkey) WHERE entity_type = 'GPE' AND spike_ratio >= 1.5 GROUP BY 1"
FRAMES = f"SELECT {C.format('subject_key')} AS country, count(DISTINCT dominant_frame) AS frames FROM framing_v GROUP BY 1"
PARTS = f"""{SPIKE}, parts AS (SELECT country, sum(CASE WHEN part = 1 THEN score ELSE 0 END) AS conflict, sum(CASE WHEN part = 2 THEN score ELSE 0 END) AS media_attention, sum(CASE WHEN part = 3 THEN score ELSE 0 END) AS contradiction, sum(CASE WHEN part = 4 THEN score ELSE 0 END) AS event_severity, sum(CASE WHEN part = 5 THEN score ELSE 0 END) AS entity_activity, sum(CASE WHEN part = 6 THEN score ELSE 0 END) AS narrative_volatility FROM (
 SELECT country, 1 AS part, {SIG.format(v="weighted_count + 0.5 * fatalities", m="30.0")} AS score FROM ({CONFLICT})
 UNION ALL SELECT country, 2, {SIG.format(v="weighted_articles", m="30.0")} FROM ({MEDIA})
 UNION ALL SELECT country, 3, {SIG.format(v="contradiction_count", m="3.0")} FROM ({FOG})
 UNION ALL SELECT country, 4, {SIG.format(v="total_fatalities + 10 * high_fatality_events", m="20.0")} FROM ({SEVERE})
 UNION ALL SELECT country, 5, {SIG.format(v="avg_ratio", m="2.0")} FROM ({MOVED})
 UNION ALL SELECT country, 6, {SIG.format(v="frames", m="4.0")} FROM ({FRAMES})) GROUP BY country)"""
ALL = ("structured_v", "articles_v", "registry_v", "disputes_v", "mentions_v", "framing_v", "nation")


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def gazetteer(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))


def places(nation: DataFrame) -> DataFrame:
    return nation.select(F.concat(F.lit("E"), F.col("n_nationkey").cast("string")).alias("entity"), F.col("n_name").alias("country"))


def parts(structured, articles, registry, disputes, mentions, framing, nation) -> DataFrame:
    regional = articles.join(registry.select("source_domain", "region"), "source_domain")
    return I.components(
        I.event_scores(structured), media_attention=I.attention(regional, AS_OF, HOURS), contradiction=I.contradictions(disputes, gazetteer(nation)),
        entity_activity=I.activity(A.entity_spikes(mentions, MENTIONS_AS_OF, limit=None, threshold=0.0), places(nation)), narrative_volatility=I.volatility(framing),
    )


@query("A12_conflict_score", "structured_v", sql=f"SELECT country, event_count, fatalities, round(weighted_count, 4) AS weighted_count, round({SIG.format(v='weighted_count + 0.5 * fatalities', m='30.0')}, 4) AS score FROM ({CONFLICT})")
def a12(structured):
    return rounded(I.conflict(structured), "weighted_count", "score")


@query("A13_media_attention", "articles_v", "registry_v", sql=f"SELECT country, round(weighted_articles, 4) AS weighted_articles, source_count, round({SIG.format(v='weighted_articles', m='30.0')}, 4) AS score FROM ({MEDIA})")
def a13(articles, registry):
    return rounded(I.attention(articles.join(registry.select("source_domain", "region"), "source_domain"), AS_OF, HOURS), "weighted_articles", "score")


@query("A14_contradiction_density", "disputes_v", "nation", sql=f"SELECT country, contradiction_count, event_count, round({SIG.format(v='contradiction_count', m='3.0')}, 4) AS score FROM ({FOG})")
def a14(disputes, nation):
    return rounded(I.contradictions(disputes, gazetteer(nation)), "score")


@query("A15_event_severity", "structured_v", sql=f"SELECT country, total_fatalities, high_fatality_events, round({SIG.format(v='total_fatalities + 10 * high_fatality_events', m='20.0')}, 4) AS score FROM ({SEVERE})")
def a15(structured):
    return rounded(I.severity(structured), "score")


@query("A16_entity_activity", "mentions_v", "nation", sql=f"WITH {SPIKE} SELECT country, round(avg_ratio, 4) AS avg_ratio, spikes, round({SIG.format(v='avg_ratio', m='2.0')}, 4) AS score FROM ({MOVED})")
def a16(mentions, nation):
    return rounded(I.activity(A.entity_spikes(mentions, MENTIONS_AS_OF, limit=None, threshold=0.0), places(nation)), "avg_ratio", "score")


@query("A17_narrative_volatility", "framing_v", sql=f"SELECT country, frames, round({SIG.format(v='frames', m='4.0')}, 4) AS score FROM ({FRAMES})")
def a17(framing):
    return rounded(I.volatility(framing), "score")


SCORE = "0.3 * conflict + 0.2 * media_attention + 0.15 * contradiction + 0.2 * event_severity + 0.1 * entity_activity + 0.05 * narrative_volatility"
LEVEL = "CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'elevated' ELSE 'low' END"
INDEX = f"WITH {PARTS}, scored AS (SELECT *, least(100.0, {SCORE}) AS score FROM parts)"


@query("A18_instability_index", *ALL, sql=f"{INDEX} SELECT country, round(conflict, 4) AS conflict, round(media_attention, 4) AS media_attention, round(contradiction, 4) AS contradiction, round(event_severity, 4) AS event_severity, round(entity_activity, 4) AS entity_activity, round(narrative_volatility, 4) AS narrative_volatility, round(score, 4) AS score, {LEVEL} AS level FROM scored")
def a18(*tables):
    return rounded(I.instability(parts(*tables)), *I.WEIGHTS, "score")


@query("P23_country_detail", *ALL, sql=f"{INDEX} SELECT country, round(score, 4) AS score, {LEVEL} AS level FROM scored WHERE country IN ('nation_7', 'europe')")
def p23(*tables):
    """Country detail by key."""
    return rounded(I.instability(parts(*tables)).filter(F.col("country").isin("nation_7", "europe")).select("country", "score", "level"), "score")


ON = {k: f"{k} >= 20" for k in I.WEIGHTS}
KIND = f"CASE WHEN ({ON['conflict']} OR {ON['event_severity']}) AND {ON['media_attention']} AND {ON['contradiction']} THEN 'crisis_escalation' WHEN ({ON['conflict']} OR {ON['event_severity']}) AND {ON['entity_activity']} THEN 'military_escalation' WHEN {ON['media_attention']} AND {ON['contradiction']} AND {ON['narrative_volatility']} THEN 'information_crisis' WHEN ({ON['conflict']} OR {ON['event_severity']}) AND {ON['media_attention']} THEN 'conflict_spotlight' WHEN {ON['media_attention']} AND {ON['entity_activity']} THEN 'emerging_situation' WHEN {ON['contradiction']} AND {ON['narrative_volatility']} THEN 'narrative_instability' ELSE 'multi_signal' END"


@query("A19_signal_convergence", *ALL, sql=f"WITH {PARTS}, n AS (SELECT *, {' + '.join(f'CAST({c} AS INT)' for c in ON.values())} AS domain_count FROM parts) SELECT country, domain_count, round(least(100.0, ({SCORE}) * (1.0 + (domain_count - 2) * 0.15)), 4) AS score, {KIND} AS convergence_type FROM n WHERE domain_count >= 2")
def a19(*tables):
    return rounded(I.convergence(parts(*tables)).select("country", "domain_count", "score", "convergence_type"), "score")


@query("W4_score_trend", "structured_v", sql=f"""WITH s AS (SELECT {C.format('country')} AS country, event_date, CAST(sum(fatalities) AS DOUBLE) AS score FROM structured_v GROUP BY 1, 2),
 now AS (SELECT country, score FROM s WHERE event_date = DATE '2024-01-30'), near AS (SELECT country, arg_min(score, (abs(epoch({T}) - 86400 - epoch(CAST(event_date AS TIMESTAMP))), event_date)) AS previous FROM s WHERE abs(epoch({T}) - 86400 - epoch(CAST(event_date AS TIMESTAMP))) <= 43200 GROUP BY 1)
 SELECT country, score, previous, CASE WHEN previous IS NULL THEN 'new' WHEN score - previous > 5 THEN 'rising' WHEN score - previous < -5 THEN 'falling' ELSE 'stable' END AS trend FROM now LEFT JOIN near USING (country)""")
def w4(structured):
    daily = structured.groupBy(I.S.country("country").alias("country"), "event_date").agg(F.sum("fatalities").cast("double").alias("score"))
    snapshots = daily.select("country", F.col("event_date").cast("timestamp").alias("at"), "score")
    return I.trend(daily.filter("event_date = DATE '2024-01-30'").select("country", "score"), snapshots, AS_OF)


@query("A11_region_attention", "articles_v", "registry_v", sql=f"""WITH w AS (SELECT region, a.source_domain, published_at, 1.0 + 1.75 * {RECENCY} AS w FROM articles_v a JOIN registry_v r USING (source_domain) WHERE published_at >= {T} - INTERVAL {HOURS} HOUR),
 g AS (SELECT region, sum(w) AS weight, count(*) AS articles, count(DISTINCT source_domain) AS sources, max(published_at) AS latest FROM w GROUP BY region)
 SELECT region, articles, sources, latest, round(weight, 4) AS weight, round(weight / sum(weight) FILTER (WHERE region <> 'global') OVER (), 4) AS share, round(weight / max(weight) FILTER (WHERE region <> 'global') OVER (), 4) AS size FROM g""")
def a11(articles, registry):
    """Region attention: weight, sources, share and size, 'global' kept apart from the totals."""
    return rounded(A.region_attention(articles.join(registry.select("source_domain", "region"), "source_domain"), AS_OF, HOURS), "weight", "share", "size")
