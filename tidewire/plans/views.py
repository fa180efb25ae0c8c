"""News-shaped views over the stored tables, once for Spark and once as SQL text.

The texts run unchanged in Spark (session zone UTC) and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

ARTICLES = """SELECT concat('https://',source,'.example/',CAST(doc_id AS STRING)) url, substr(text,1,80) title, substr(text,81) description, source, concat(source,'.example') source_domain, lang language, CAST('2024-01-01' AS TIMESTAMP) + CAST((doc_id*37)%43200 AS INT) * INTERVAL '1' MINUTE published_at, CASE WHEN doc_id%2=0 THEN 'geopolitics' ELSE 'economics' END topic FROM documents"""
STRUCTURED = """SELECT e.event_id, CASE WHEN e.event_id%3=0 THEN 'acled' ELSE 'gdelt_gkg' END dataset, CAST(e.ts AS DATE) event_date, n.n_name country, CAST((e.user_id%25)*5-60 AS DOUBLE) + CAST(e.event_id%100 AS DOUBLE)/10 latitude, CAST((e.user_id%25)*12-150 AS DOUBLE) + CAST(e.event_id%70 AS DOUBLE)/10 longitude, CASE e.event_type WHEN 'error' THEN 'Battles' WHEN 'purchase' THEN 'Violence against civilians' WHEN 'click' THEN 'Protests' WHEN 'view' THEN 'Riots' ELSE 'Strategic developments' END event_type, CAST(floor(e.value) AS INT)%12 fatalities, concat('actor',CAST(e.user_id%9 AS STRING)) actor_primary, e.ts FROM events e JOIN nation n ON n.n_nationkey = e.user_id%25"""
MENTIONS = """SELECT concat('E',CAST(event_id%40 AS STRING)) entity, CASE WHEN event_id%4=0 THEN 'GPE' ELSE 'ORG' END entity_type, CASE WHEN user_id%2=0 THEN 'geopolitics' ELSE 'economics' END topic, concat('u',CAST(user_id AS STRING),'-',CAST(CAST(ts AS DATE) AS STRING)) article_url, ts mentioned_at FROM events"""
#: one row per source: tier, type and region by the number of the source
REGISTRY = """SELECT source source_name, concat(source,'.example') source_domain, CASE CAST(substr(source,4) AS INT)%4 WHEN 0 THEN 'tier_1' WHEN 1 THEN 'tier_2' WHEN 2 THEN 'tier_3' ELSE 'tier_4' END trust_tier, CASE CAST(substr(source,4) AS INT)%3 WHEN 0 THEN 'wire' WHEN 1 THEN 'news' ELSE 'official' END source_type, CASE CAST(substr(source,4) AS INT)%5 WHEN 0 THEN 'global' WHEN 1 THEN 'europe' WHEN 2 THEN 'asia' WHEN 3 THEN 'africa' ELSE 'americas' END region, CAST(substr(source,4) AS INT)%6 <> 5 active FROM (SELECT DISTINCT source FROM documents) s"""
#: framing signals: one for each article and the country whose number its id gives
FRAMING = """SELECT concat('https://',d.source,'.example/',CAST(d.doc_id AS STRING)) article_url, n.n_name subject_key, CASE WHEN d.doc_id%7 IN (0,1,2) THEN 'security' WHEN d.doc_id%7 IN (3,4) THEN 'economic' WHEN d.doc_id%7=5 THEN 'humanitarian' ELSE 'legal' END dominant_frame, d.source, CAST('2024-01-01' AS TIMESTAMP) + CAST((d.doc_id*37)%43200 AS INT) * INTERVAL '1' MINUTE published_at FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id%25"""
#: disputes: one record for each country and day, with the number of errors as contradictions
DISPUTES = """SELECT concat(n.n_name,'-',CAST(CAST(e.ts AS DATE) AS STRING)) event_key, concat('Clashes in ',lower(n.n_name)) event_label, CAST(e.ts AS DATE) generated_on, CAST(sum(CASE WHEN e.event_type='error' THEN 1 ELSE 0 END) AS INT) contradiction_count FROM events e JOIN nation n ON n.n_nationkey = e.user_id%25 GROUP BY n.n_name, CAST(e.ts AS DATE)"""
#: claims: one for each order line, by supplier as source and part as event
CLAIMS = """SELECT CAST(l_partkey AS STRING) event_key, concat('s',CAST(l_suppkey AS STRING)) source_name, CASE l_returnflag WHEN 'A' THEN 'corroborated' WHEN 'N' THEN 'unresolved' ELSE 'contradicted' END resolution_status, CASE WHEN l_linenumber%3=0 THEN 'casualty' WHEN l_linenumber%3=1 THEN 'timeline' ELSE 'fact' END claim_type, CASE WHEN l_linestatus='O' THEN 'geopolitics' ELSE 'economics' END topic, l_quantity claim_value, l_shipdate published_at, l_orderkey, l_linenumber FROM lineitem"""

PLACE = "CASE {} WHEN 0 THEN 'Iran' WHEN 1 THEN 'Moscow' WHEN 2 THEN 'Kyiv' WHEN 3 THEN 'the U.K.' WHEN 4 THEN 'China' WHEN 5 THEN 'Damascus' WHEN 6 THEN 'Ankara' WHEN 7 THEN 'South Korea' WHEN 8 THEN 'DRC' ELSE 'Washington' END"
#: news reports: title and lead by the number of the document, which gives the rest of the text
REPORTS = f"""SELECT doc_id, concat('https://',source,'.example/r/',CAST(doc_id AS STRING)) url, replace(CASE doc_id%11 WHEN 0 THEN 'Airstrike hits port in *, 12 killed' WHEN 1 THEN 'Ceasefire talks collapse in *' WHEN 2 THEN 'Parliament in * approves sanctions bill' WHEN 3 THEN 'Rebels captured border town near *' WHEN 4 THEN 'Court in * jailed opposition leader' WHEN 5 THEN 'Aid delivery reopened for *' WHEN 6 THEN 'Election results in * rejected' WHEN 7 THEN 'Inflation and exports shock market in *' WHEN 8 THEN 'Militant drone attack in * wounded 1,200!' WHEN 9 THEN 'Officials agreed summit agreement with *' ELSE 'Quiet weather over *' END, '*', {PLACE.format('doc_id%10')}) title,
 concat(replace(CASE doc_id%7 WHEN 0 THEN 'Government said 40 fighters withdrew after the raid.' WHEN 1 THEN 'Analysts say talks are likely within 3 weeks in *.' WHEN 2 THEN 'Humanitarian relief was blocked and roads closed near Seattle.' WHEN 3 THEN 'The central bank said interest rates and tariffs rise; trade with * slows.' WHEN 4 THEN 'Terrorist group claimed the missile strike on *.' WHEN 5 THEN 'Police detained 15 people, protest leaders told the White House.' ELSE 'Nothing else was reported.' END, '*', {PLACE.format('(doc_id*3)%10')}), ' ', text) description,
 {PLACE.format('doc_id%10')} place, concat('Group ',CAST(doc_id%17 AS STRING)) actor, source, concat(source,'.example') source_domain, lang language, CAST('2024-01-01' AS TIMESTAMP) + CAST((doc_id*37+(doc_id*doc_id)%997)%43200 AS INT) * INTERVAL '1' MINUTE published_at, CASE WHEN doc_id%2=0 THEN 'geopolitics' ELSE 'economics' END topic FROM documents"""

TEXTS = {"reports_v": REPORTS, "articles_v": ARTICLES, "structured_v": STRUCTURED, "mentions_v": MENTIONS, "registry_v": REGISTRY, "framing_v": FRAMING, "disputes_v": DISPUTES, "claims_v": CLAIMS}
TABLES = ("documents", "events", "nation", "lineitem")


def zoned(df: DataFrame) -> DataFrame:
    """Stored times without a zone as instants of the session zone (UTC)."""
    local = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, or a stored table."""
    if name not in TEXTS:
        return zoned(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    text = TEXTS[name]
    used = {}
    for t in TABLES:
        for lead in ("FROM ", "JOIN "):
            if f"{lead}{t}" in text:
                text = text.replace(f"{lead}{t}", f"{lead}{{{t}}}")
                used[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return zoned(spark.sql(text, **used))


def with_views(sql: str) -> str:
    """SQL text with the views that it names put in front."""
    named = [f"{k} AS ({v})" for k, v in TEXTS.items() if k in sql]
    if not named:
        return sql
    body, lead = sql.strip(), "WITH"
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{', '.join(named)}, {body[len(start):]}"
    return f"{lead} {', '.join(named)} {body}"
