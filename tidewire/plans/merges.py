"""Queries of merges (K1-K29) with their SQL.

Stored and incoming rows are two overlapping loads of one table by date, the later one
with changed values where a rule needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.operators import merge as M
from tidewire.plans.registry import query

CUT0, CUT1 = "1995-06-01 00:00:00", "1994-06-01 00:00:00"
OLD = f"SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s, o_orderdate AS t FROM orders WHERE o_orderdate < TIMESTAMP '{CUT0}'"
NEW = f"SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice * 2 END AS v, CASE WHEN o_orderpriority = '2-HIGH' THEN '' ELSE lower(o_orderstatus) END AS s, o_orderdate AS t FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT1}'"


def loads(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = orders.withColumnRenamed("o_orderkey", "k").withColumn("t", F.col("o_orderdate"))
    old = k.filter(F.col("t") < CUT0).select("k", F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"), "t")
    v = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") * 2)
    s = F.when(F.col("o_orderpriority") == "2-HIGH", "").otherwise(F.lower("o_orderstatus"))
    return old, k.filter(F.col("t") >= CUT1).select("k", v.alias("v"), s.alias("s"), "t")


def sql(v: str, s: str, both: str = "TRUE") -> str:
    act = f"CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NOT NULL AND ({both}) THEN 'updated' ELSE 'kept' END"
    pick = lambda c, rule: f"CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL AND ({both}) THEN {rule} WHEN o.k IS NOT NULL THEN o.{c} ELSE n.{c} END AS {c}"
    return f"SELECT coalesce(o.k, n.k) AS k, {pick('v', v)}, {pick('s', s)}, {act} AS _action FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.k = n.k"


def rule_query(name: str, v: str, s: str, sql_v: str, sql_s: str, both: str = "TRUE", when=None) -> None:
    @query(name, "orders", sql=sql(sql_v, sql_s, both))
    def run(orders):
        old, new = loads(orders)
        return M.merge_upsert(old, new, ["k"], {"v": v, "s": s, "t": "old"}, when=when() if when else None).drop("t")




def differs():
    return F.col("old.s") != F.col("new.s")


def changes():
    v = F.col("new.v").isNotNull() & ~F.col("new.v").eqNullSafe(F.col("old.v"))
    return v | ((F.col("new.s") != "") & ~F.col("new.s").eqNullSafe(F.col("old.s")))


rule_query("K1_article_upsert", "new", "new", "n.v", "n.s", "o.s <> n.s", differs)
rule_query("K2_bulk_merge", "new_or_old", "new", "coalesce(n.v, o.v)", "n.s", "o.s <> n.s", differs)
rule_query("K5_translation_upsert", "new", "new", "n.v", "n.s")
rule_query("K6_event_upsert", "new", "old", "n.v", "o.s")
rule_query("K7_observation_upsert", "least", "old_or_new", "least(o.v, n.v)", "coalesce(o.s, n.s)")
rule_query("K8_canonical_upsert", "new_or_old", "new_unless_empty", "coalesce(n.v, o.v)", "CASE WHEN n.s IS NULL OR n.s = '' THEN o.s ELSE n.s END")
rule_query("K10_perspective_upsert", "old_or_new", "new", "coalesce(o.v, n.v)", "n.s")
rule_query("K11_observation_history", "greatest", "new", "greatest(o.v, n.v)", "n.s")
rule_query("K12_identity_map", "least", "new_unless_empty", "least(o.v, n.v)", "CASE WHEN n.s IS NULL OR n.s = '' THEN o.s ELSE n.s END")
rule_query("K14_assignment_evidence", "new_or_old", "new_or_old", "coalesce(n.v, o.v)", "coalesce(n.s, o.s)")
rule_query("K21_framing_upsert", "new", "new", "n.v", "n.s")
rule_query("K22_queue_upsert", "new_or_old", "new_unless_empty", "coalesce(n.v, o.v)", "CASE WHEN n.s IS NULL OR n.s = '' THEN o.s ELSE n.s END", "(n.v IS NOT NULL AND n.v IS DISTINCT FROM o.v) OR (n.s <> '' AND n.s IS DISTINCT FROM o.s)", changes)
rule_query("K24_registry_upsert", "new", "new_or_old", "n.v", "coalesce(n.s, o.s)")
rule_query("K25_official_upsert", "new", "new", "n.v", "n.s")
rule_query("K26_prediction_upsert", "old", "new", "o.v", "n.s")
rule_query("K27_job_state", "new", "new", "n.v", "n.s")


@query("K3_insert_absent", "orders", sql=f"SELECT k, v, s FROM ({OLD}) UNION ALL SELECT k, v, s FROM ({NEW}) WHERE k NOT IN (SELECT k FROM ({OLD}))")
def k3(orders):
    old, new = loads(orders)
    return M.insert_absent(old, new, ["k"]).drop("t")


@query("K4_placeholder_articles", "pages", "articles_v", sql="SELECT DISTINCT url, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[-_?=&#.]+', ' ', 'g')[:200] AS title FROM pages WHERE regexp_matches(url, '^https?://') AND url NOT IN (SELECT url FROM articles_v)")
def k4(pages, articles):
    title = F.substring(F.regexp_replace(F.element_at(F.split("url", "/"), -1), r"[-_?=&#.]+", " "), 1, 200)
    rows = pages.filter(F.col("url").rlike("^https?://")).select("url", title.alias("title")).dropDuplicates(["url"])
    return rows.join(articles.select("url"), "url", "left_anti")


@query("K9_synthesis_update", "orders", sql="SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS v, o_orderpriority = '1-URGENT' AS matched FROM orders")
def k9(orders):
    hit = F.col("o_orderpriority") == "1-URGENT"
    return orders.select("o_orderkey", F.when(hit, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")).alias("v"), hit.alias("matched"))


@query("K13_audit_append", "orders", sql=f"SELECT k, s FROM ({OLD}) UNION ALL SELECT k, s FROM ({NEW})")
def k13(orders):
    old, new = loads(orders)
    return old.unionByName(new).select("k", "s")


@query("K15_document_upsert", "documents", sql="""WITH o AS (SELECT source, sha256(text) AS digest, min(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE lang <> 'en' GROUP BY 1, 2),
 t AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, sha256(text) AS digest FROM documents WHERE lang <> 'en'),
 n AS (SELECT DISTINCT coalesce(o.h, concat('n', CAST(doc_id AS VARCHAR))) AS id, d.source, sha256(text) AS digest FROM documents d LEFT JOIN o ON o.source = d.source AND o.digest = sha256(text))
 SELECT coalesce(t.id, n.id) AS id, coalesce(n.source, t.source) AS source, coalesce(n.digest, t.digest) AS digest FROM t FULL JOIN n ON n.id = t.id""")
def k15(documents):
    rows = documents.select(F.col("doc_id").cast("string").alias("id"), "source", F.sha2("text", 256).alias("digest"), "lang")
    stored = rows.filter("lang <> 'en'").drop("lang")
    return M.upsert_by_id_or_hash(stored, rows.drop("lang").withColumn("id", F.concat(F.lit("n"), "id")), "id", "source", "digest").drop("_action")


@query("K16_snapshot_replace", "claims_v", sql="SELECT topic, event_key, claim_value FROM claims_v WHERE topic <> 'economics' UNION ALL SELECT topic, event_key, claim_value * 2 FROM claims_v WHERE topic = 'economics'")
def k16(claims):
    rows = claims.select("topic", "event_key", "claim_value")
    return M.replace_slice(rows, rows.filter("topic = 'economics'").withColumn("claim_value", F.col("claim_value") * 2), ["topic"])


@query("K17_claim_snapshot", "claims_v", sql="SELECT sha256(concat(event_key, '|', source_name, '|', CAST(l_orderkey AS VARCHAR), '|', CAST(l_linenumber AS VARCHAR))) AS claim_key, event_key, resolution_status FROM claims_v")
def k17(claims):
    return claims.select(S.stable_hash("event_key", "source_name", "l_orderkey", "l_linenumber").alias("claim_key"), "event_key", "resolution_status")


@query("K19_changed_history", "orders", sql=f"WITH h AS (SELECT k, s FROM ({OLD})) SELECT n.k, n.s FROM ({NEW}) n LEFT JOIN h ON h.k = n.k WHERE n.s IS DISTINCT FROM h.s")
def k19(orders):
    old, new = loads(orders)
    return M.append_changed(old, new, "k", "s", "t").select("k", "s")


@query("K20_changed_snapshots", "structured_v", sql="WITH d AS (SELECT country, event_date, sha256(CAST(sum(fatalities) AS VARCHAR)) AS digest FROM structured_v GROUP BY 1, 2) SELECT country, event_date, digest FROM (SELECT *, lag(digest) OVER (PARTITION BY country ORDER BY event_date) AS before FROM d) WHERE digest IS DISTINCT FROM before")
def k20(structured):
    from pyspark.sql import Window

    daily = structured.groupBy("country", "event_date").agg(F.sha2(F.sum("fatalities").cast("string"), 256).alias("digest"))
    before = F.lag("digest").over(Window.partitionBy("country").orderBy("event_date"))
    return daily.withColumn("before", before).filter(~F.col("digest").eqNullSafe(F.col("before"))).drop("before")


@query("K23_payload_patch", "customer", sql="SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN 'retry' ELSE 'fetched' END AS status FROM customer")
def k23(customer):
    """Status and payload patch: a JSON object read as a map, entries of the patch winning."""
    payload = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.lit("new").alias("status")))
    stored = F.from_json(payload, "map<string,string>")
    patch = F.create_map(F.lit("status"), F.when(F.col("c_acctbal") < 0, "retry").otherwise("fetched"))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(patch, k)), patch)
    return customer.select("c_custkey", merged["segment"].alias("segment"), merged["status"].alias("status"))


@query("K28_mentions_insert", "mentions_v", sql="SELECT topic, article_url, entity, min(mentioned_at) AS mentioned_at FROM mentions_v GROUP BY 1, 2, 3")
def k28(mentions):
    rows = mentions.groupBy("topic", "article_url", "entity").agg(F.min("mentioned_at").alias("mentioned_at"))
    early = rows.filter("mentioned_at < TIMESTAMP '2024-01-15 00:00:00'")
    return M.insert_absent(early, rows, ["topic", "article_url", "entity"])


@query("K29_startup_purge", "customer", sql="SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal < 0)")
def k29(customer):
    return M.purge(customer, (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") < 0)).select("c_custkey")
