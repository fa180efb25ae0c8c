"""Merges (K*) over the columns of the tables that they keep, with their SQL.

Stored rows are earlier reports of a key, incoming rows are later ones; both are made of the reports.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.operators import merge as M
from tidewire.plans.registry import query

SPLIT = "TIMESTAMP '2024-01-03 00:00:00'"
HASH = "sha256(concat(trim(title), '|', trim(source)))"


def halves(reports):
    return reports.filter(f"published_at < {SPLIT} OR doc_id % 2 = 0"), reports.filter(f"published_at >= {SPLIT} OR doc_id % 3 = 0")


IN_OLD, IN_NEW = f"(published_at < {SPLIT} OR doc_id % 2 = 0)", f"(published_at >= {SPLIT} OR doc_id % 3 = 0)"


@query("K1_articles_by_hash", "reports_v", sql=f"""SELECT url, CASE WHEN {IN_NEW} AND NOT {IN_OLD} THEN 'inserted' WHEN {IN_NEW} AND doc_id % 4 = 0 THEN 'updated' ELSE 'kept' END AS action,
 CASE WHEN {IN_NEW} AND (NOT {IN_OLD} OR doc_id % 4 = 0) THEN 2 ELSE 1 END AS last_ingested_at, CASE WHEN {IN_OLD} THEN 1 ELSE 2 END AS first_ingested_at, CASE WHEN {IN_NEW} THEN 2 ELSE 1 END AS topic_assigned_at FROM reports_v WHERE {IN_OLD} OR {IN_NEW}""")
def k1(reports):
    """An article is updated only where its content hash differs (a fourth was changed); its topic's time is refreshed either way."""
    old, new = halves(reports)
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("title", F.lit(" (corrected)"))).otherwise(F.col("title"))
    side = lambda df, title, at: df.select("url", S.stable_hash(title, "source").alias("content_hash"), F.lit(at).alias("first_ingested_at"), F.lit(at).alias("last_ingested_at"))
    merged = M.merge_upsert(side(old, F.col("title"), 1), side(new, changed, 2), ["url"], {"first_ingested_at": "old"}, when=~F.col("old.content_hash").eqNullSafe(F.col("new.content_hash")))
    topics = M.merge_upsert(old.select("url", "topic", F.lit(1).alias("topic_assigned_at")), new.select("url", "topic", F.lit(2).alias("topic_assigned_at")), ["url", "topic"])
    return merged.join(topics.select("url", "topic_assigned_at"), "url").select("url", F.col("_action").alias("action"), "last_ingested_at", "first_ingested_at", "topic_assigned_at")


SEEN = "min(published_at) AS first_seen, max(published_at) AS latest_seen, min(published_at) FILTER (WHERE {m}) AS first_major, arg_min(source, (published_at, doc_id)) AS earliest_source, arg_min(source, (published_at, doc_id)) FILTER (WHERE {m}) AS earliest_major, list_sort(list(DISTINCT source)) AS sources"
MAJOR = "CAST(substr(source, 4) AS INT) % 4 = 0"


@query("K7_observation_archive", "reports_v", sql=f"""WITH o AS (SELECT place, actor, {SEEN.format(m=MAJOR)} FROM reports_v WHERE {IN_OLD} GROUP BY 1, 2), n AS (SELECT place, actor, {SEEN.format(m=MAJOR)} FROM reports_v WHERE {IN_NEW} GROUP BY 1, 2)
 SELECT place, actor, least(o.first_seen, n.first_seen) AS first_seen, greatest(o.latest_seen, n.latest_seen) AS latest_seen, coalesce(o.first_major, n.first_major) AS first_major, coalesce(o.earliest_source, n.earliest_source) AS earliest_source, coalesce(o.earliest_major, n.earliest_major) AS earliest_major, coalesce(n.sources, o.sources) AS sources FROM o FULL JOIN n USING (place, actor)""")
def k7(reports):
    """First seen the least, latest seen the greatest, the first-* columns once they are known, lists overwritten."""
    major = F.substring("source", 4, 9).cast("int") % 4 == 0
    when = F.struct("published_at", "doc_id")
    side = lambda df: df.groupBy("place", "actor").agg(
        F.min("published_at").alias("first_seen"), F.max("published_at").alias("latest_seen"), F.min(F.when(major, F.col("published_at"))).alias("first_major"), F.min_by("source", when).alias("earliest_source"),
        F.min_by("source", F.when(major, when)).alias("earliest_major"), F.sort_array(F.collect_set("source")).alias("sources"),
    )
    old, new = map(side, halves(reports))
    return M.merge_upsert(old, new, ["place", "actor"], {"first_seen": "least", "latest_seen": "greatest", "first_major": "old_or_new", "earliest_source": "old_or_new", "earliest_major": "old_or_new"}).drop("_action")


EVENT = "arg_min(topic, (published_at, doc_id)) AS topic, min(published_at) AS first_seen, max(CASE WHEN doc_id % 3 = 0 THEN actor END) AS admin1, count(*) AS articles, list_sort(list(DISTINCT actor) FILTER (WHERE doc_id % 5 = 0)) AS reasons"


@query("K8_canonical_events", "reports_v", sql=f"""WITH o AS (SELECT place, {EVENT} FROM reports_v WHERE {IN_OLD} GROUP BY 1), n AS (SELECT place, {EVENT} FROM reports_v WHERE {IN_NEW} GROUP BY 1)
 SELECT place, coalesce(o.topic, n.topic) AS topic, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.admin1, o.admin1) AS admin1, coalesce(n.articles, o.articles) AS articles, CASE WHEN len(coalesce(n.reasons, [])) > 0 THEN n.reasons ELSE coalesce(o.reasons, []) END AS reasons FROM o FULL JOIN n USING (place)""")
def k8(reports):
    """Topic and first seen are never overwritten, places only by known ones, reasons not by empty ones."""
    side = lambda df: df.groupBy("place").agg(
        F.min_by("topic", F.struct("published_at", "doc_id")).alias("topic"), F.min("published_at").alias("first_seen"), F.max(F.when(F.col("doc_id") % 3 == 0, F.col("actor"))).alias("admin1"), F.count(F.lit(1)).alias("articles"),
        F.sort_array(F.collect_set(F.when(F.col("doc_id") % 5 == 0, F.col("actor")))).alias("reasons"),
    )
    old, new = map(side, halves(reports))
    return M.merge_upsert(old, new, ["place"], {"topic": "old", "first_seen": "old", "admin1": "new_or_old", "reasons": "new_unless_empty"}).drop("_action")


@query("K9_matched_synthesis", "reports_v", sql="SELECT place, CASE WHEN n > 0 THEN 'Summary' ELSE 'none' END AS summary, CASE WHEN n > 0 THEN n ELSE 0 END AS perspectives, n > 0 AS matched FROM (SELECT place, count(*) FILTER (WHERE doc_id % 7 = 0 AND actor = 'Group 3') AS n FROM reports_v GROUP BY place)")
def k9(reports):
    """Synthesis rows of some events put on the stored ones; columns without a new value stay; whether a row matched."""
    stored = reports.select("place").distinct().withColumns({"summary": F.lit("none"), "perspectives": F.lit(0).cast("bigint")})
    new = reports.filter("doc_id % 7 = 0 AND actor = 'Group 3'").groupBy("place").agg(F.lit("Summary").alias("summary"), F.count(F.lit(1)).alias("perspectives"))
    done = M.merge_upsert(stored, new, ["place"], {"summary": "new_or_old", "perspectives": "new_or_old"})
    return done.select("place", "summary", "perspectives", (F.col("_action") == "updated").alias("matched"))


@query("K17_claim_snapshots", "claims_v", sql="""SELECT sha256(concat('new', '|', event_key, '|', source_name)) AS record_key, 'new' AS snapshot, event_key FROM claims_v WHERE topic = 'geopolitics' GROUP BY event_key, source_name
 UNION ALL SELECT sha256(concat('old', '|', event_key, '|', source_name)), 'old', event_key FROM claims_v WHERE topic = 'economics' GROUP BY event_key, source_name""")
def k17(claims):
    """The rows of a snapshot are deleted and put in again under keys that name the snapshot; other snapshots stay."""
    rows = lambda topic, snapshot: claims.filter(F.col("topic") == topic).select("event_key", "source_name").distinct().select(S.stable_hash(F.lit(snapshot), "event_key", "source_name").alias("record_key"), F.lit(snapshot).alias("snapshot"), "event_key")
    stored = rows("economics", "old").unionByName(rows("economics", "new"))
    return M.replace_slice(stored, rows("geopolitics", "new"), ["snapshot"])


@query("K24_registry_activation", "registry_v", sql="SELECT source_name, CASE WHEN CAST(substr(source_name, 4) AS INT) % 7 = 0 THEN false WHEN CAST(substr(source_name, 4) AS INT) % 5 = 0 THEN true ELSE active END AS active FROM registry_v")
def k24(registry):
    """Sources activated and deactivated by lists of ids, the later list last."""
    number = F.substring("source_name", 4, 9).cast("int")
    lists = registry.filter(number % 5 == 0).select("source_name", F.lit(True).alias("set"), F.lit(1).alias("n")).unionByName(registry.filter(number % 7 == 0).select("source_name", F.lit(False).alias("set"), F.lit(2).alias("n")))
    last = lists.groupBy("source_name").agg(F.max_by("set", "n").alias("set"))
    return registry.select("source_name", "active").join(last, "source_name", "left").select("source_name", F.coalesce("set", "active").alias("active"))


@query("K26_prediction_delete", "conversations", sql="SELECT concat(conv_id, '-', turn) AS prediction_key FROM conversations WHERE role = 'assistant' AND NOT (conv_id % 3 = 0 AND turn % 4 = 1)")
def k26(conversations):
    """Predictions of a topic and source reference go; a delete without any condition deletes nothing."""
    rows = conversations.filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("prediction_key"), (F.col("conv_id") % 3).alias("topic"), (F.col("turn") % 4).alias("source_ref"))
    kept = M.purge(rows, (F.col("topic") == 0) & (F.col("source_ref") == 1))
    return M.purge(kept, F.lit(None).cast("boolean")).select("prediction_key")


@query("K27_run_log", "events", sql="SELECT event_type AS topic, count(*) AS runs, arg_max(event_id, (ts, event_id)) AS last_run, max(ts) AS completed_at FROM events GROUP BY event_type")
def k27(events):
    """Runs appended to a log in two loads; the state row of each topic is its latest run."""
    runs = events.select(F.col("event_type").alias("topic"), F.col("event_id").alias("run"), F.col("ts").alias("at"))
    log = runs.filter("run % 2 = 0").unionByName(runs.filter("run % 2 = 1"))
    state = lambda df: df.groupBy("topic").agg(F.max(F.struct("at", "run")).alias("last"))
    states = M.merge_upsert(state(runs.filter("run % 2 = 0")), state(runs.filter("run % 2 = 1")), ["topic"], {"last": "greatest"})
    return states.join(log.groupBy("topic").agg(F.count(F.lit(1)).alias("runs")), "topic").select("topic", "runs", F.col("last.run").alias("last_run"), F.col("last.at").alias("completed_at"))
