"""Filters, predicates and ordered reads.  "Now" is always the parameter ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.operators.aggregates import since

# fixed values: HTTP codes and texts of failures worth another try
RETRY_CODES = ("408", "425", "429", "500", "502", "503", "504")
RETRY_TEXTS = "timeout|timed out|temporarily|connection reset|connection aborted|remote end closed"
FALLBACK_TIME = "0001-01-01 00:00:00"


def newest(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def recent_articles(articles: DataFrame, translations: DataFrame | None, as_of: str, hours: int = 72, topic: str | None = None, limit: int | None = 60) -> DataFrame:
    """Articles of the window, newest first, translated text overlaid."""
    rows = articles.filter(F.col("published_at") >= since(as_of, f"{hours} HOURS"))
    if topic is not None:
        rows = rows.filter(F.col("topic") == topic)
    rows = newest(rows, limit, F.desc("published_at"), F.col("url"))
    if translations is None:
        return rows
    t = translations.select(F.col("article_url").alias("url"), "translated_title", "translated_description")
    rows = rows.join(t, "url", "left")
    return rows.withColumn("title", F.coalesce("translated_title", "title")).withColumn("description", F.coalesce("translated_description", "description")).drop("translated_title", "translated_description")


def headline_tier(payload: Column | str) -> Column:
    """Null, empty or 'headline' tier in the JSON payload."""
    return F.coalesce(F.get_json_object(S.col(payload), "$.analytic_tier"), F.lit("")).isin("", "headline")


def recent_events(events: DataFrame, as_of: str, days: int = 7, limit: int | None = 3000, **equal: str) -> DataFrame:
    """Events of the window; where it is empty, the window ends at the newest event.

    The two window starts are scalars of one aggregate, joined as a single broadcast row.
    """
    for k, v in equal.items():
        events = events.filter(F.col(k) == v)
    start = F.to_date(since(as_of, f"{days} DAYS"))
    edge = events.agg(F.count_if(F.col("event_date") >= start).alias("n"), F.max("event_date").alias("newest"))
    edge = edge.select(F.when(F.col("n") > 0, start).otherwise(F.date_sub("newest", days - 1)).alias("start"))
    rows = events.join(F.broadcast(edge), F.col("event_date") >= F.col("start")).drop("start")
    return newest(rows, limit, F.desc("event_date"), F.desc("fatalities"), F.col("event_id"))


def between(events: DataFrame, start: str, end: str, limit: int | None = 300) -> DataFrame:
    """P4."""
    rows = events.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return newest(rows, limit, F.desc("event_date"), F.col("event_id")).select("event_id")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """P5: rows whose key is listed."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def by_urls(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Articles under the URL that was asked for, an exact hit before a canonical one."""
    ask = wanted.select(F.col("url").alias("asked")).distinct()
    exact = ask.join(articles.withColumn("asked", F.col("url")), "asked").withColumn("hit", F.lit(0))
    near = ask.withColumn("_c", S.canonical_url("asked")).join(articles.withColumn("_c", S.canonical_url("url")), "_c").drop("_c").withColumn("hit", F.lit(1))
    both = exact.unionByName(near)
    best = both.groupBy("asked").agg(F.min_by(F.struct(*articles.columns), F.struct("hit", "url")).alias("a"), F.min("hit").alias("hit"))
    return best.select("asked", "hit", "a.*")


def retryable(error: Column | str) -> Column:
    """P10: by the HTTP code in the text, else by known phrases."""
    text = F.lower(F.coalesce(S.col(error), F.lit("")))
    code = F.regexp_extract(text, r"\b([1-5]\d\d)\b", 1)
    return F.when(F.length(code) > 0, code.isin(*RETRY_CODES)).otherwise(text.rlike(RETRY_TEXTS))


def promoted(quality: Column, registered: Column, region: Column, english: Column) -> Column:
    """Quality from 7; from 5 if registered or not English; from 4 outside the core regions."""
    outer = region.isNotNull() & ~region.isin("global", "united-states", "europe")
    return F.coalesce((quality >= 7) | (registered & (quality >= 5)) | (outer & (quality >= 4)) | (~english & (quality >= 5)), F.lit(False))


def precise_point(location: Column | str, country: Column | str, admin1: Column | str) -> Column:
    """A place finer than its country."""
    place, land, area = (S.place_key(x) for x in (location, country, admin1))
    comma = F.contains(F.coalesce(S.col(location), F.lit("")), F.lit(","))
    return ((comma | (F.length(area) > 0)) & (area != land) & (place != "") | ((place != "") & (place != land) & (area != land) & (F.length(area) > 0)))


def mentions_subject(text: Column | str, subject: str) -> Column:
    """The phrase, or at least two (or all) of its words of four letters or more."""
    t = F.lower(F.coalesce(S.col(text), F.lit("")))
    words = sorted({w for w in subject.lower().split() if len(w) >= 4})
    hits = sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.contains(t, F.lit(subject.lower())) | ((hits >= min(2, len(words))) if words else F.lit(False))


def translation_backlog(articles: DataFrame, translations: DataFrame, priority: Column, least: int = 7, limit: int | None = 24) -> DataFrame:
    """Non-English articles without a translation, by priority."""
    rows = articles.filter(~S.is_english("language")).join(translations.select(F.col("article_url").alias("url")), "url", "left_anti")
    rows = rows.withColumn("priority", priority).filter(F.col("priority") >= least)
    return newest(rows, limit, F.desc("priority"), F.desc("published_at"), F.col("url"))


def queue_batch(queue: DataFrame, limit: int, order: dict[str, int]) -> DataFrame:
    """Rows of the listed states in their order, oldest first."""
    from tidewire.operators.indices import lookup

    rows = queue.filter(F.col("fetch_status").isin(*order)).withColumn("_o", lookup(F.col("fetch_status"), order, 99))
    return newest(rows, limit, F.col("_o"), F.col("created_at"), F.col("url")).drop("_o")


def queue_mix(queue: DataFrame, limit: int, retry_share: float = 0.2) -> DataFrame:
    """Pending rows up to their share of the limit, then retries up to what is left of it, so
    that a share that pending rows leave unused goes to retries."""
    pending = newest(queue.filter("fetch_status = 'pending'"), limit - int(limit * retry_share), F.col("created_at"), F.col("url"))
    retry = newest(queue.filter("fetch_status = 'retry'"), limit, F.col("created_at"), F.col("url"))
    both = pending.withColumn("_o", F.lit(0)).unionByName(retry.withColumn("_o", F.lit(1)))
    return newest(both, limit, F.col("_o"), F.col("created_at"), F.col("url")).drop("_o")


def next_status(code: Column, attempts: Column, error: Column, topics: Column, most: int = 3) -> Column:
    """P25: state of a queue row after a fetch."""
    return (
        F.when(code.between(200, 299) & (topics > 0), "fetched").when(code.between(200, 299), "no_topic")
        .when((attempts < most) & retryable(F.coalesce(error, code.cast("string"))), "retry").otherwise("failed")
    )


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The newest row of each key (ties by the remaining columns given)."""
    packed = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")
    return rows.groupBy(*key).agg(packed).select("_r.*")


def top_per(rows: DataFrame, key: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
