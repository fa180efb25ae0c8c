"""Readers and record normalisers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import scalars as S

# fixed values: names under which records hold a field, root codes of the event export
ALIASES = {
    "url": ["url", "link", "canonical_url", "article_url"], "title": ["title", "headline", "name"], "description": ["description", "summary", "snippet", "body", "text"],
    "source": ["source", "source_name", "publisher"], "published_at": ["published_at", "publishedAt", "date", "seendate"], "language": ["language", "lang"],
}
WRAPPERS = ("articles", "items", "data", "sources", "stories", "results")
ROOT_TYPES = {"14": "Protests", "18": "Violence against civilians", "19": "Battles", "20": "Explosions/Remote violence", "17": "Strategic developments", "13": "Strategic developments", "15": "Strategic developments", "16": "Strategic developments"}


def read_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """JSON (array or wrapper object), JSON lines, CSV, TSV or Parquet by suffix."""
    kind = kind or path.rstrip("/*").rpartition(".")[2].lower()
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if kind == "json":
        rows = spark.read.option("multiLine", True).json(path)
        wrapped = [c for c in WRAPPERS if c in rows.columns and dict(rows.dtypes)[c].startswith("array<struct")]
        return rows.select(F.explode(wrapped[0]).alias("r")).select("r.*") if wrapped else rows
    if kind in ("csv", "tsv"):
        return spark.read.option("header", kind == "csv").option("sep", "\t" if kind == "tsv" else ",").csv(path)
    if kind == "zip":
        return zip_lines(spark, path)
    return spark.read.parquet(path)


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the members of zip files, each archive in its own task row by row."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        with z.open(member) as f:
                            for part in iter(lambda f=f: f.readlines(4 << 20), []):
                                yield pd.DataFrame({"archive": name, "member": member, "line": [x.decode("utf-8", "replace").rstrip("\r\n") for x in part]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "archive string, member string, line string")


def first_of(columns: list[str], names: list[str]) -> Column:
    """The first of several columns that is not blank."""
    have = [F.when(F.trim(F.col(n).cast("string")) != "", F.trim(F.col(n).cast("string"))) for n in names if n in columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def as_articles(records: DataFrame) -> DataFrame:
    """Records under any known names as articles; rows without url or title go."""
    out = records.select(*[first_of(records.columns, names).alias(k) for k, names in ALIASES.items()])
    out = out.filter("url IS NOT NULL AND title IS NOT NULL AND title <> '[Removed]'")
    return out.withColumns({"description": F.coalesce("description", "title"), "source": F.coalesce("source", F.lit("Imported archive")), "language": F.coalesce("language", F.lit("en"))})


def route_topics(rows: DataFrame, known: list[str], forced: list[str] | None = None, inferred: Column | None = None) -> DataFrame:
    """Forced topics, else the record's known ones, else inferred; rows without any go."""
    own = F.array_intersect(F.coalesce("topics", F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))
    pick = F.array(*[F.lit(f) for f in forced]) if forced else F.when(F.size(own) > 0, own).otherwise(inferred if inferred is not None else F.array().cast("array<string>"))
    return rows.withColumn("topic", F.explode(pick)).drop("topics")


def export_events(lines: DataFrame, all_placed: bool = False) -> DataFrame:
    """Tab-separated export lines (id, day, root, quad class, country, place, latitude,
    longitude, actor, mentions) as structured events; the first line of an id wins.

    A point at 0, 0 stands for no place and is dropped, unless ``all_placed`` says that every line has a place.
    """
    f = F.split("line", "\t")
    at = lambda k: F.trim(F.try_element_at(f, F.lit(k + 1)))
    rows = lines.select(
        at(0).alias("event_id"), F.try_to_timestamp(at(1), F.lit("yyyyMMdd")).cast("date").alias("event_date"), at(2).alias("root"), at(3).try_cast("int").alias("quad"), at(4).alias("country"),
        S.distinct_parts(at(5)).alias("location"), at(6).try_cast("double").alias("latitude"), at(7).try_cast("double").alias("longitude"), at(8).alias("actor_primary"), at(9).try_cast("int").alias("mentions"),
    )
    from tidewire.operators.indices import lookup

    rows = rows.filter((F.col("quad").isin(3, 4) | F.col("root").try_cast("int").between(13, 20)) & F.col("event_date").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.lit(all_placed) | ~((F.col("latitude") == 0) & (F.col("longitude") == 0))))
    kind = lookup(F.col("root"), ROOT_TYPES, "Strategic developments")
    summary = F.substring(F.concat_ws(" ", F.coalesce(F.nullif("actor_primary", F.lit("")), F.lit("Unknown actor")), F.lit("-"), kind, F.lit("in"), F.col("location")), 1, 220)
    rows = rows.withColumn("event_type", kind).withColumn("summary", summary)
    return rows.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "event_id"]), F.struct("event_date", "summary")).alias("r")).select("event_id", "r.*")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """RSS items and Atom entries with Spark's XML source."""
    kind = "title string, link string, description string, pubDate string, guid string"
    rss = spark.read.option("rowTag", "item").schema(kind).xml(path).select("title", F.col("link").alias("url"), "description", F.col("pubDate").alias("published_at"))
    atom = spark.read.option("rowTag", "entry").schema("title string, id string, summary string, updated string").xml(path).select("title", F.col("id").alias("url"), F.col("summary").alias("description"), F.col("updated").alias("published_at"))
    return rss.unionByName(atom)


def meta(html: Column, name: str) -> Column:
    return S.fragment(F.regexp_extract(html, rf"(?is)<meta[^>]+(?:name|property)=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)", 1))


def linked_data(html: Column) -> Column:
    """The first JSON-LD object of a page, alone or in a list, whose type is an article or a report; null for none."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    each = F.flatten(F.transform(scripts, lambda s: F.when(F.startswith(F.trim(s), F.lit("[")), F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(s))))
    return F.try_element_at(F.filter(each, lambda c: F.lower(F.get_json_object(c, "$['@type']")).rlike("article|report")), F.lit(1))


def page_articles(pages: DataFrame, paragraphs: int | None = None) -> DataFrame:
    """Stored pages as articles: JSON-LD of an article or report, then meta, then the page's own.

    The body has all paragraphs of the page (or the first ``paragraphs``); the description falls back to
    its first 400 characters, the source to the host.
    """
    h = F.coalesce("html", F.lit(""))
    filled = lambda *cs: F.coalesce(*[F.nullif(S.fragment(c), F.lit("")) for c in cs])
    ld = lambda path: F.get_json_object("_ld", path)
    title = filled(ld("$.headline"), meta(h, "og:title"), meta(h, "twitter:title"), F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    plain = F.regexp_replace(h, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    found = F.regexp_extract_all(plain, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</?p[ >]|</article|$)"), F.lit(1))
    told = F.filter(F.transform(found if paragraphs is None else F.slice(found, 1, paragraphs), S.fragment), lambda p: p != "")
    rows = pages.withColumns({"_ld": linked_data(h), "_body": F.array_join(told, "\n")})
    about = filled(ld("$.description"), meta(h, "og:description"), meta(h, "description"), F.substring("_body", 1, 400))
    language = F.nullif(F.split_part(meta(h, "og:locale"), F.lit("_"), F.lit(1)), F.lit(""))
    return rows.select(
        "page_id", "url", title.alias("title"), about.alias("description"), F.col("_body").alias("body"), filled(ld("$.datePublished"), meta(h, "article:published_time")).alias("published_at"),
        F.coalesce(filled(ld("$.publisher.name"), meta(h, "og:site_name")), S.domain("url")).alias("source"), S.domain("url").alias("source_domain"), language.alias("language"),
    )


def page_links(pages: DataFrame, least: int = 12, allowed: str | None = None, blocked: str | None = None, keywords: list[str] | None = None) -> DataFrame:
    """Links of stored pages with absolute URL and text of at least ``least`` characters.

    ``allowed`` and ``blocked`` are patterns of the URL; with ``keywords`` the text must hold one of them.
    """
    a = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), F.lit(1))).alias("a")
    rows = pages.select("page_id", F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*)", 1).alias("base"), a)
    href = F.regexp_extract("a", r"(?is)href=[\"']([^\"']*)", 1)
    rows = rows.select("page_id", F.when(href.rlike("^https?://"), href).otherwise(F.concat("base", href)).alias("url"), S.fragment("a").alias("text"))
    rows = rows.filter(F.length("text") >= least)
    if allowed:
        rows = rows.filter(F.col("url").rlike(allowed))
    if blocked:
        rows = rows.filter(~F.col("url").rlike(blocked))
    if keywords:
        rows = rows.filter(F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower("text"), k)))
    return rows.dropDuplicates(["page_id", "url"])


def label_lines(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines with the bad ones marked instead of fatal."""
    parsed = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("r", parsed).select("file", "r.*").withColumn("valid", F.col("_bad").isNull())
