"""Queries of streaming forms (T1-T10); each must give what the batch form gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.plans.registry import query, stored
from tidewire.plans.views import view
from tidewire.streaming import streams as T


def events(spark, sf_dir):
    return T.file_stream(spark, f"{sf_dir}/events.parquet*")


@stored("T1_event_upserts", sql="SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY user_id")
def t1(spark, sf_dir):
    def step(batch):
        return batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count(F.lit(1)).alias("n"))

    out = T.upsert_stream(events(spark, sf_dir), "t1", step, ["user_id"], {"last": "greatest", "n": "sum"})
    return out.select("user_id", "last.event_type", "n")


@stored("T3_sliding_windows", sql="""WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) AS b, event_type FROM events), s AS (SELECT b AS start, event_type FROM w UNION ALL SELECT b - INTERVAL 12 HOUR, event_type FROM w)
 SELECT start, start + INTERVAL 24 HOUR AS "end", event_type, count(*) AS n FROM s GROUP BY start, event_type""")
def t3(spark, sf_dir):
    """Every row's two windows; update mode, so that windows still open count and each batch writes those that it changed."""
    stream = T.windowed_counts(events(spark, sf_dir), "ts", "24 hours", "12 hours", "event_type")
    return T.upsert_stream(stream, "t3", lambda batch: batch, ["start", "end", "event_type"], mode="update")


@stored("T4_daily_counts", sql="SELECT CAST(ts AS DATE)::TIMESTAMP AS start, CAST(ts AS DATE)::TIMESTAMP + INTERVAL 1 DAY AS \"end\", user_id, count(*) AS n FROM events GROUP BY 1, 2, 3")
def t4(spark, sf_dir):
    return T.upsert_stream(T.windowed_counts(events(spark, sf_dir), "ts", "1 day", None, "user_id"), "t4", lambda batch: batch, ["start", "end", "user_id"], mode="update")


@stored("T6_stateful_trend", sql="""WITH s AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS pt, sum(value) AS score FROM events GROUP BY 1, 2),
 p AS (SELECT a.user_id, a.pt, a.score, arg_min(b.score, (abs(epoch(a.pt) - 86400 - epoch(b.pt)), b.pt)) AS before FROM s a LEFT JOIN s b ON a.user_id = b.user_id AND b.pt < a.pt AND abs(epoch(a.pt) - 86400 - epoch(b.pt)) <= 43200 GROUP BY 1, 2, 3)
 SELECT user_id, pt AS "at", round(score, 6) AS score, CASE WHEN before IS NULL THEN 'new' WHEN score - before > 5 THEN 'rising' WHEN score - before < -5 THEN 'falling' ELSE 'stable' END AS trend FROM p""")
def t6(spark, sf_dir):
    """Scores of users every six hours, in four files one after the other, each against the score nearest to a day before."""
    files = T.shared_folder(spark, "t6-files")
    at = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 21600) * 21600)
    scores = view(spark, sf_dir, "events").groupBy("user_id", at.alias("at")).agg(F.sum("value").alias("score"))
    for days in ((1, 9), (9, 17), (17, 25), (25, 400)):
        part = F.datediff("at", F.lit("2024-01-01")) + 1
        scores.filter((part >= days[0]) & (part < days[1])).coalesce(1).write.mode("append").parquet(files)
    out = T.run_available(T.trends(T.file_stream(spark, files, 1), "user_id", "score", "at", 5.0), "t6")
    return out.filter("trend <> 'expired'").select("user_id", "at", F.round("score", 6).alias("score"), "trend")


@stored("T7_once_per_key", sql="SELECT DISTINCT user_id, event_type FROM events")
def t7(spark, sf_dir):
    stream = T.distinct_within(events(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "400 days")
    return T.run_available(stream, "t7").select("user_id", "event_type")


@stored("T8_first_last_seen", sql="SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id")
def t8(spark, sf_dir):
    return T.upsert_stream(events(spark, sf_dir), "t8", lambda batch: T.seen(batch, "user_id", "ts"), ["user_id"], T.SEEN)


@query("T10_staleness", "articles_v", sql="SELECT topic, max(published_at) AS newest, max(published_at) < TIMESTAMP '2024-01-31' - INTERVAL 8 HOUR AS stale FROM articles_v GROUP BY topic")
def t10(articles):
    newest = F.max("published_at")
    return articles.groupBy("topic").agg(newest.alias("newest"), (newest < F.lit("2024-01-31").cast("timestamp") - F.expr("INTERVAL 8 HOURS")).alias("stale"))
