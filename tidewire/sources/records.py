"""Normalisers of stored records: index lines, queue records, event and report payloads, feeds."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import news as N
from tidewire.functions import scalars as S

# fixed values: columns of the index files, names of languages, suffixes of formats
MENTION_COLUMNS = ["GLOBALEVENTID", "EventTimeDate", "MentionTimeDate", "MentionType", "MentionSourceName", "MentionIdentifier", "SentenceID"]
KNOWLEDGE_COLUMNS = ["GKGRECORDID", "DATE", "SourceCollectionIdentifier", "SourceCommonName", "DocumentIdentifier", "Themes", "ExtrasXML"]
LANGUAGES = {
    "arabic": "ar", "bulgarian": "bg", "chinese": "zh", "english": "en", "french": "fr", "german": "de", "hindi": "hi", "japanese": "ja", "korean": "ko", "norwegian": "no", "polish": "pl", "portuguese": "pt",
    "romanian": "ro", "russian": "ru", "spanish": "es", "turkish": "tr",
}
ENGLISH = ["en", "eng", "english"]
FORMATS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".csv": "csv", ".tsv": "tsv", ".txt": "tsv", ".zip": "zip"}
LANGUAGE_PLACES = ["$.language", "$.Language", "$.sourceLanguage", "$.source_language", "$.TranslationInfo.sourceLanguage", "$.extras.language"]

filled = lambda c: F.nullif(F.trim(c), F.lit(""))


def fields(line: Column, names: list[str]) -> dict[str, Column]:
    """Tab-separated fields by name; a short line has nulls at its end."""
    parts = F.split(line, "\t")
    return {n: filled(F.try_element_at(parts, F.lit(k + 1))) for k, n in enumerate(names)}


def index_time(c: Column) -> Column:
    """Compact second, compact day or ISO time; null for anything else."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(c, F.lit("yyyyMMdd")), S.timestamp(c))


def mentions(lines: DataFrame) -> DataFrame:
    """Lines of a mention file; blank lines go."""
    f = fields(F.col("line"), MENTION_COLUMNS)
    return lines.filter("trim(line) <> ''").select(f["MentionIdentifier"].alias("url"), f["MentionSourceName"].alias("source_domain"), index_time(f["MentionTimeDate"]).alias("published_at"), F.lit(None).cast("string").alias("title"))


def knowledge(lines: DataFrame) -> DataFrame:
    """Lines of a knowledge-graph file, the page title cut from the XML of the last column."""
    f = fields(F.col("line"), KNOWLEDGE_COLUMNS)
    title = filled(F.regexp_extract(F.coalesce(f["ExtrasXML"], F.lit("")), r"(?is)<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1))
    return lines.filter("trim(line) <> ''").select(f["DocumentIdentifier"].alias("url"), f["SourceCommonName"].alias("source_domain"), index_time(f["DATE"]).alias("published_at"), title.alias("title"))


def topic_guess(explicit: Column, query: Column, signals: Column) -> Column:
    """The topic named outright, else in the query, else that with most keywords."""
    named = lambda c: F.when(F.contains(F.lower(c), F.lit("geopolitics")), "geopolitics").when(F.contains(F.lower(c), F.lit("economics")), "economics")
    t = F.lower(F.coalesce(signals, F.lit("")))
    g, e = N.hits(t, N.TOPIC_KEYWORDS["geopolitics"]), N.hits(t, N.TOPIC_KEYWORDS["economics"])
    return F.coalesce(named(explicit), named(query), F.when(e > g, "economics").when(g > 0, "geopolitics"))


def queue_records(rows: DataFrame, via: str) -> DataFrame:
    """Rows (url, title, domain, stamp, topic, query) as records of the fetch queue; those without a usable URL go."""
    url = S.canonical_url("url")
    out = rows.select(
        "url", url.alias("canonical_url"), filled(F.col("title")).alias("title"), F.lower(F.coalesce(filled(F.col("domain")), S.domain("url"))).alias("source_domain"), index_time(F.col("stamp")).alias("published_at"),
        topic_guess(F.col("topic"), F.col("query"), F.col("title")).alias("topic_guess"), F.lit(via).alias("discovered_via"), F.lit("pending").alias("fetch_status"), F.lit(0).alias("attempt_count"),
    )
    return out.filter(F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]+"))


def file_format(name: Column) -> Column:
    """Format of a file by its suffix; null if unknown."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), suffix)


def zip_members(archives: DataFrame) -> DataFrame:
    """(archive, member, line) of zip files given as (archive, content), some megabytes of lines at a time."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["archive"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        with z.open(member) as f:
                            for part in iter(lambda f=f: f.readlines(4 << 20), []):
                                yield pd.DataFrame({"archive": name, "member": member, "line": [x.decode("utf-8", "replace").rstrip("\r\n") for x in part]})

    return archives.select("archive", "content").mapInPandas(lines, "archive string, member string, line string")


def first_file_wins(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Of events that several files repeat, the row of the first file."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def conflict_events(records: DataFrame) -> DataFrame:
    """JSON records of the conflict API (column ``json``) as structured events.

    Blank fields are null, counts and coordinates are cast, ids get a prefix; the summary is
    the first 400 characters of the notes, else a sentence of what, who and where.
    """
    at = lambda name: filled(F.get_json_object("json", f"$.{name}"))
    r = records.select(*[at(n).alias(n) for n in ("event_id_cnty", "event_date", "country", "admin1", "location", "event_type", "sub_event_type", "actor1", "actor2", "notes")], *[at(n).try_cast(t).alias(n) for n, t in (("latitude", "double"), ("longitude", "double"), ("fatalities", "int"))])
    kind = F.coalesce("event_type", F.lit("Incident"))
    action = F.when(F.lower("sub_event_type") != F.lower(kind), F.col("sub_event_type")).otherwise(kind)
    action = F.coalesce(action, kind)
    where = F.coalesce(F.concat(F.lit(" in "), F.coalesce("location", "admin1", "country")), F.lit(""))
    who = F.when(F.col("actor1").isNull(), " reported").otherwise(F.concat(F.lit(" involving "), "actor1", F.coalesce(F.concat(F.lit(" and "), "actor2"), F.lit(""))))
    dead = F.when(F.col("fatalities") > 0, F.concat(F.col("fatalities").cast("string"), F.lit(" fatalities reported")))
    said = F.concat(F.concat_ws(". ", F.concat(action, who, where), dead, F.concat(F.lit("on "), "event_date")), F.lit("."))
    return r.select(
        F.concat(F.lit("acled-"), "event_id_cnty").alias("event_id"), F.col("event_date").try_cast("date").alias("event_date"), "country", "admin1", "location", "latitude", "longitude", "event_type", "sub_event_type",
        F.col("actor1").alias("actor_primary"), F.col("actor2").alias("actor_secondary"), "fatalities", F.coalesce(F.substring("notes", 1, 400), said).alias("summary"),
    )


def language_code(c: Column) -> Column:
    """A code of two or three letters, English in any form, or the code of a language's name."""
    low = F.replace(F.lower(filled(c)), F.lit("_"), F.lit("-"))
    base = F.split(low, "-")[0]
    return F.when(base.isin(*ENGLISH), "en").when(base.rlike("^[a-z]{2,3}$"), base).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), low))


def index_articles(payloads: DataFrame) -> DataFrame:
    """Articles of news-index payloads (column ``json``); the language from the first place that holds one."""
    items = F.explode(F.from_json(F.get_json_object("json", "$.articles"), "array<string>"))
    r = payloads.select(items.alias("a"))
    at = lambda *names: F.coalesce(*[filled(F.get_json_object("a", f"$.{n}")) for n in names])
    language = F.coalesce(*[language_code(F.get_json_object("a", p)) for p in LANGUAGE_PLACES], F.lit("unknown"))
    out = r.select(at("url").alias("url"), at("title").alias("title"), at("snippet", "description", "excerpt", "title").alias("description"), at("domain", "source").alias("source"), S.timestamp(at("seendate", "published", "date")).alias("published_at"), language.alias("language"))
    return out.filter("url IS NOT NULL AND title IS NOT NULL").withColumn("source", F.coalesce("source", S.domain("url")))


def report_updates(payloads: DataFrame, body: str = "UN OCHA") -> DataFrame:
    """Humanitarian reports (column ``json``) as updates: alias or node URL, text without tags."""
    at = lambda p: filled(F.get_json_object("json", p))
    url = F.coalesce(at("$.fields.url_alias"), at("$.fields.url"), F.concat(F.lit("https://reports.example/node/"), at("$.id")))
    text = filled(S.fragment(F.coalesce(at("$.fields.body-html"), at("$.fields.body"), F.lit(""))))
    return payloads.select(url.alias("url"), at("$.fields.title").alias("title"), F.substring(text, 1, 400).alias("summary"), F.lit(body).alias("issuing_body"), S.stable_hash(F.lit(body), url).alias("update_id")).filter("title IS NOT NULL")


def entry_rows(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feed entries (source, source_type, trust_tier, url, title, description, published_at) as raw documents, articles and official updates."""
    digest = S.stable_hash("title", "description", "url")
    raw = entries.select(S.stable_hash("source", "url", digest).alias("document_id"), F.col("source").alias("source_id"), "url", "title", "published_at", "source_type", "trust_tier", digest.alias("content_hash"))
    articles = entries.filter("source_type <> 'official'").select("url", "title", F.coalesce(filled(F.col("description")), F.col("title")).alias("description"), "source", "published_at", digest.alias("content_hash"))
    updates = entries.filter("source_type = 'official'").select(S.stable_hash("source", "url").alias("update_id"), F.col("source").alias("issuing_body"), update_type(F.col("title")).alias("update_type"), "title", "url", F.substring(F.coalesce("description", F.lit("")), 1, 400).alias("summary"))
    return raw, articles, updates


def update_type(title: Column) -> Column:
    """Type of an official update by the words of its title."""
    t = F.lower(title)
    return F.when(N.has_any(t, ["sanction", "tariff"]), "sanctions").when(N.has_any(t, ["agreement", "talks", "summit"]), "diplomacy").when(N.has_any(t, ["inflation", "market", "rates"]), "economic").otherwise("statement")


def official_items(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items (source, url, title, published_at) that pass their body's rule (source, allowed, blocked, keywords); the last row of an update id wins."""
    rows = items.join(rules, "source")
    part = lambda name: F.exists(name, lambda p: F.contains("url", p))
    ok = (part("allowed") | (F.size("allowed") == 0)) & ~part("blocked") & (F.exists("keywords", lambda w: F.contains(F.lower("title"), w)) | (F.size("keywords") == 0))
    rows = rows.filter(ok).select(S.stable_hash("source", "title").alias("update_id"), "source", "title", "url", "published_at", update_type(F.col("title")).alias("update_type"))
    return rows.groupBy("update_id").agg(F.max_by(F.struct("source", "title", "url", "published_at", "update_type"), F.struct("published_at", "url")).alias("r")).select("update_id", "r.*")


def direct_feeds(entries: DataFrame, feeds: DataFrame, topic: str, per_feed: int, per_domain: int) -> DataFrame:
    """Entries of the feeds hinted at a topic, the newest ``per_feed`` of each, one for each URL, ``per_domain`` of each domain, in pack order."""
    rows = entries.join(feeds.filter(F.array_contains("hints", topic)), "source")
    newest = Window.partitionBy("source").orderBy(F.desc("published_at"), "url")
    rows = rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= per_feed)
    rows = rows.groupBy("url").agg(F.min_by(F.struct("source", "source_domain", "pack_order", "title", "published_at"), F.struct("pack_order", "source")).alias("r")).select("url", "r.*")
    spread = Window.partitionBy("source_domain").orderBy("pack_order", F.desc("published_at"), "url")
    return rows.withColumn("place", F.row_number().over(spread)).filter(F.col("place") <= per_domain)


def feed_batch(scored: DataFrame) -> DataFrame:
    """Promoted and rejected entries and the newest one for each pack and source, each pack and all (grouping level 0, 1, 3)."""
    return scored.rollup("pack", "source").agg(F.count_if("promoted").alias("promoted"), F.count_if(~F.col("promoted")).alias("rejected"), F.max("published_at").alias("newest"), F.grouping_id().alias("level"))
