"""Queries of importers and feeds (S2 to S26) over records that Spark derives from the tables, with their SQL."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tidewire.functions import news as N
from tidewire.functions import scalars as S
from tidewire.plans.news import count
from tidewire.plans.registry import query, stored
from tidewire.plans.views import view
from tidewire.sources import records as R
from tidewire.streaming.streams import shared_folder

DIGEST = "sha256(concat(trim(title), '|', trim(description), '|', trim(url)))"


@query("S2_relational_archive", "articles_v", sql="WITH t AS (SELECT url, topic FROM articles_v UNION ALL SELECT url, 'general' FROM articles_v WHERE language <> 'en' UNION ALL SELECT url, topic FROM articles_v WHERE language = 'en') SELECT url, title, list_sort(list(DISTINCT topic)) AS topics FROM articles_v a JOIN t USING (url) GROUP BY url, title".replace("list(DISTINCT topic)", "list(DISTINCT t.topic)"))
def s2(articles):
    """Articles with the list of their topics, of a table that repeats pairs."""
    own = articles.select("url", "topic")
    topics = own.unionByName(articles.filter("language <> 'en'").select("url", F.lit("general").alias("topic"))).unionByName(articles.filter("language = 'en'").select("url", "topic"))
    lists = topics.groupBy("url").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    return articles.select("url", "title").join(lists, "url")


@query("S5_index_lines", "reports_v", sql="""SELECT url, CASE WHEN doc_id % 3 > 0 THEN source_domain END AS source_domain, date_trunc('second', published_at) AS published_at, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 > 0 THEN title END AS title FROM reports_v WHERE doc_id % 3 > 0 OR doc_id % 2 = 0""".replace("CASE WHEN doc_id % 3 > 0 THEN source_domain END", "source_domain"))
def s5(reports):
    """Mention lines of even reports, some cut short; knowledge lines of odd ones, with a title in XML; each third odd line is blank."""
    stamp = F.date_format("published_at", "yyyyMMddHHmmss")
    mention = F.concat_ws("\t", F.col("doc_id").cast("string"), stamp, stamp, F.lit("1"), "source_domain", "url", F.when(F.col("doc_id") % 3 == 0, F.lit("7")))
    known = F.concat_ws("\t", F.concat(stamp, F.lit("-"), F.col("doc_id").cast("string")), stamp, F.lit("1"), "source_domain", "url", F.lit("THEME"), F.concat(F.lit("<x><PAGE_TITLE> "), "title", F.lit(" </PAGE_TITLE></x>")))
    odd = reports.filter("doc_id % 2 = 1").select(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(known).alias("line"))
    return R.mentions(reports.filter("doc_id % 2 = 0").select(mention.alias("line"))).unionByName(R.knowledge(odd))


@query("S6_queue_records", "reports_v", sql=f"""WITH r AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN upper(topic) ELSE '' END AS named, CASE doc_id % 4 WHEN 1 THEN concat('about ', topic) END AS q, {count('lower(title)', N.TOPIC_KEYWORDS['geopolitics'])} AS g, {count('lower(title)', N.TOPIC_KEYWORDS['economics'])} AS e FROM reports_v WHERE doc_id % 5 > 0)
 SELECT concat(url, '/?q=1') AS url, url AS canonical_url, lower(source_domain) AS source_domain, CASE doc_id % 3 WHEN 1 THEN date_trunc('day', published_at) ELSE date_trunc('second', published_at) END AS published_at, CASE WHEN doc_id % 4 < 2 THEN topic WHEN e > g THEN 'economics' WHEN g > 0 THEN 'geopolitics' END AS topic_guess FROM r""")
def s6(reports):
    k = F.col("doc_id") % 4
    stamp = F.when(F.col("doc_id") % 3 == 0, F.date_format("published_at", "yyyyMMddHHmmss")).when(F.col("doc_id") % 3 == 1, F.date_format("published_at", "yyyyMMdd")).otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = reports.select(
        F.when(F.col("doc_id") % 5 > 0, F.concat("url", F.lit("/?q=1"))).otherwise("no url").alias("url"), "title", F.when(F.col("doc_id") % 2 == 0, F.upper("source_domain")).otherwise(" ").alias("domain"), stamp.alias("stamp"),
        F.when(k == 0, F.upper("topic")).otherwise("").alias("topic"), F.when(k == 1, F.concat(F.lit("about "), "topic")).alias("query"),
    )
    return R.queue_records(rows, "bulk").select("url", "canonical_url", "source_domain", "published_at", "topic_guess")


@query("S7_archive_members", "reports_v", sql="""SELECT CAST(doc_id AS VARCHAR) AS archive, unnest(['a.jsonl', 'b.CSV', 'c']) AS member, unnest(['jsonl', 'csv', NULL]) AS format, unnest([2, 1, 1]) AS lines FROM reports_v""")
def s7(reports):
    """A zip of three members for each report, packed and read again."""

    def pack(frames):
        for frame in frames:
            out = []
            for title in frame["title"]:
                made = io.BytesIO()
                with zipfile.ZipFile(made, "w") as z:
                    z.writestr("a.jsonl", '{"t": 1}\n{"t": 2}\n')
                    z.writestr("b.CSV", title)
                    z.writestr("c", "x\r\n")
                out.append(made.getvalue())
            yield pd.DataFrame({"archive": frame["doc_id"].astype(str), "content": out})

    rows = R.zip_members(reports.select("doc_id", "title").mapInPandas(pack, "archive string, content binary"))
    return rows.groupBy("archive", "member", R.file_format(F.col("member")).alias("format")).agg(F.count(F.lit(1)).cast("int").alias("lines"))


@query("S9_first_file_wins", "structured_v", sql="SELECT event_id, country, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS file FROM structured_v")
def s9(structured):
    """Events of three files of a quarter of an hour each; a third of them is missing from the first."""
    rows = structured.select("event_id", "country", F.explode(F.array(F.lit(3), F.lit(1), F.lit(2))).alias("file")).filter("file > 1 OR event_id % 3 > 0")
    return R.first_file_wins(rows, "event_id", "file")


@query("S10_conflict_records", "structured_v", sql="""SELECT concat('acled-', CAST(event_id AS VARCHAR)) AS event_id, event_date, CASE WHEN event_id % 5 > 0 THEN latitude END AS latitude, CASE WHEN event_id % 4 > 0 THEN fatalities END AS fatalities,
 CASE WHEN event_id % 3 = 0 THEN substr(repeat(concat('Note on ', country, '. '), 40), 1, 400) ELSE concat(event_type, CASE WHEN event_id % 2 = 0 THEN concat(' involving ', actor_primary, ' and others') ELSE ' reported' END, ' in ', country, CASE WHEN event_id % 4 > 0 AND fatalities > 0 THEN concat('. ', fatalities, ' fatalities reported') ELSE '' END, '. on ', CAST(event_date AS VARCHAR), '.') END AS summary FROM structured_v""")
def s10(structured):
    """JSON records with blanks in some coordinates, counts, notes and actors."""
    i = F.col("event_id")
    two = i % 2 == 0
    json = F.to_json(F.struct(
        i.cast("string").alias("event_id_cnty"), F.col("event_date").cast("string").alias("event_date"), "country", F.lit(" ").alias("location"), "event_type", F.lit("").alias("sub_event_type"),
        F.when(i % 5 > 0, F.col("latitude").cast("string")).otherwise("").alias("latitude"), F.col("longitude").cast("string").alias("longitude"), F.when(i % 4 > 0, F.col("fatalities").cast("string")).otherwise("").alias("fatalities"),
        F.when(two, F.col("actor_primary")).otherwise("").alias("actor1"), F.when(two, "others").alias("actor2"), F.when(i % 3 == 0, F.repeat(F.concat(F.lit("Note on "), "country", F.lit(". ")), F.lit(40))).otherwise(" ").alias("notes"),
    ))
    return R.conflict_events(structured.select(json.alias("json"))).select("event_id", "event_date", "latitude", "fatalities", "summary")


ENTRIES = "SELECT url, title, description, source, published_at, source_type, trust_tier, region FROM reports_v r JOIN registry_v g ON g.source_name = r.source"


def entries(reports, registry):
    return reports.join(registry.select(F.col("source_name").alias("source"), "source_type", "trust_tier", "region"), "source").select("url", "title", "description", "source", "published_at", "source_type", "trust_tier", "region", "source_domain")


@query("S12_entry_rows", "reports_v", "registry_v", sql=f"""WITH e AS ({ENTRIES}) SELECT 'document' AS kind, sha256(concat(trim(source), '|', trim(url), '|', {DIGEST})) AS id, url FROM e
 UNION ALL SELECT 'article', {DIGEST}, url FROM e WHERE source_type <> 'official' UNION ALL SELECT 'update', sha256(concat(trim(source), '|', trim(url))), url FROM e WHERE source_type = 'official'""")
def s12(reports, registry):
    raw, articles, updates = R.entry_rows(entries(reports, registry))
    named = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "url")
    return named(raw, "document", "document_id").unionByName(named(articles, "article", "content_hash")).unionByName(named(updates, "update", "update_id"))


@query("S15_index_payloads", "reports_v", sql="SELECT url, title, title AS description, source_domain AS source, date_trunc('second', published_at) AS published_at, CASE doc_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'pt' ELSE 'unknown' END AS language FROM reports_v WHERE doc_id % 7 > 0")
def s15(reports):
    """One payload for each report; the language stands in another place for each, or nowhere."""
    k = F.col("doc_id") % 5
    item = F.to_json(F.struct(
        F.when(F.col("doc_id") % 7 > 0, F.col("url")).otherwise("").alias("url"), "title", F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.when(k == 0, "English").alias("language"), F.when(k == 1, "fr_FR").alias("sourceLanguage"),
        F.when(k == 2, F.struct(F.lit("German").alias("sourceLanguage"))).alias("TranslationInfo"), F.when(k == 3, F.struct(F.lit("pt-BR").alias("language"))).alias("extras"),
    ))
    return R.index_articles(reports.select(F.concat(F.lit('{"articles": ['), item, F.lit("]}")).alias("json")))


@query("S17_mirrored_documents", "reports_v", "registry_v", sql=f"""WITH w AS (SELECT *, {DIGEST} AS h FROM reports_v WHERE published_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 336 HOUR), m AS (SELECT source_name AS source_id, url, h FROM w JOIN registry_v USING (source_domain) WHERE active)
 SELECT DISTINCT source_id, h AS content_hash FROM m UNION SELECT source, {DIGEST} FROM reports_v WHERE doc_id % 4 = 0""")
def s17(reports, registry):
    """Recent articles of known domains put into the stored documents (a fourth of all), one for each source and hash."""
    digest = S.stable_hash("title", "description", "url")
    recent = reports.filter(F.col("published_at") >= F.expr("TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 336 HOUR"))
    new = recent.join(registry.filter("active").select("source_name", "source_domain"), "source_domain").select(F.col("source_name").alias("source_id"), digest.alias("content_hash")).distinct()
    stored_rows = reports.filter("doc_id % 4 = 0").select(F.col("source").alias("source_id"), digest.alias("content_hash")).distinct()
    return stored_rows.unionByName(new.join(stored_rows, ["source_id", "content_hash"], "left_anti"))


@stored("S20_windowed_archive", sql="SELECT url, title FROM reports_v WHERE published_at >= TIMESTAMP '2024-01-02 06:00:00' AND published_at < TIMESTAMP '2024-01-04 18:00:00'")
def s20(spark, sf_dir):
    """A time window of an archive stored by day: only the folders of its days are read."""
    out = shared_folder(spark, "s20")
    view(spark, sf_dir, "reports_v").select("url", "title", "published_at", F.to_date("published_at").alias("day")).write.partitionBy("day").parquet(out)
    rows = spark.read.parquet(out).filter("day BETWEEN DATE '2024-01-02' AND DATE '2024-01-04'")
    return rows.filter("published_at >= TIMESTAMP '2024-01-02 06:00:00' AND published_at < TIMESTAMP '2024-01-04 18:00:00'").select("url", "title")


KIND = "CASE WHEN regexp_matches(lower(title), 'sanction|tariff') THEN 'sanctions' WHEN regexp_matches(lower(title), 'agreement|talks|summit') THEN 'diplomacy' WHEN regexp_matches(lower(title), 'inflation|market|rates') THEN 'economic' ELSE 'statement' END"


@query("S21_official_items", "reports_v", "registry_v", sql=f"""SELECT source, title, arg_max(url, (published_at, url)) AS url, {KIND} AS update_type FROM reports_v JOIN registry_v ON source = source_name
 WHERE source_type = 'official' AND (region <> 'asia' OR contains(url, '1')) AND NOT contains(url, '/r/7') AND (trust_tier <> 'tier_1' OR contains(lower(title), 'port') OR contains(lower(title), 'aid')) GROUP BY source, title""")
def s21(reports, registry):
    """Rules: Asian bodies only links with a 1, none with /r/7, first-tier bodies only titles with a keyword."""
    none = F.array().cast("array<string>")
    rules = registry.filter("source_type = 'official'").select(
        F.col("source_name").alias("source"), F.when(F.col("region") == "asia", F.array(F.lit("1"))).otherwise(none).alias("allowed"), F.array(F.lit("/r/7")).alias("blocked"),
        F.when(F.col("trust_tier") == "tier_1", F.array(F.lit("port"), F.lit("aid"))).otherwise(none).alias("keywords"),
    )
    return R.official_items(reports.select("source", "url", "title", "published_at"), rules).select("source", "title", "url", "update_type")


@query("S22_report_updates", "reports_v", sql="""SELECT CASE WHEN doc_id % 2 = 0 THEN concat('https://reports.example/alias/', doc_id) ELSE concat('https://reports.example/node/', doc_id) END AS url, title, substr(trim(regexp_replace(concat('Lead of ', title, ' and more ', repeat('text ', 100)), '\\s+', ' ', 'g')), 1, 400) AS summary FROM reports_v WHERE doc_id % 6 > 0""")
def s22(reports):
    html = F.concat(F.lit("<p>Lead of <b>"), "title", F.lit("</b></p> and more <i>"), F.repeat(F.lit("text "), F.lit(100)), F.lit("</i>"))
    alias = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://reports.example/alias/"), F.col("doc_id").cast("string")))
    json = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(alias.alias("url_alias"), F.when(F.col("doc_id") % 6 > 0, F.col("title")).alias("title"), html.alias("body-html")).alias("fields")))
    return R.report_updates(reports.select(json.alias("json"))).select("url", "title", "summary")


@query("S23_official_totals", "reports_v", "registry_v", sql=f"WITH e AS ({ENTRIES}) SELECT source, count(*) AS documents, count(*) FILTER (WHERE source_type = 'official') AS updates, count(*) FILTER (WHERE source_type <> 'official') AS articles FROM e GROUP BY source")
def s23(reports, registry):
    """Documents, updates and mirrored articles made of the entries of each source."""
    raw, articles, updates = R.entry_rows(entries(reports, registry))
    tagged = raw.select(F.col("source_id").alias("source"), F.lit("d").alias("k")).unionByName(updates.select(F.col("issuing_body").alias("source"), F.lit("u").alias("k"))).unionByName(articles.select("source", F.lit("a").alias("k")))
    return tagged.groupBy("source").agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("d", "documents"), ("u", "updates"), ("a", "articles"))])


@query("S24_headline_records", "reports_v", sql="SELECT url, title, CASE WHEN doc_id % 3 = 0 THEN title ELSE 'About it' END AS description, source, 'en' AS language FROM reports_v WHERE doc_id % 4 > 1")
def s24(reports):
    """JSON of the headline API: removed titles and blank URLs go."""
    from tidewire.sources.scans import as_articles

    k = F.col("doc_id") % 4
    json = F.to_json(F.struct(F.when(k > 0, F.col("url")).otherwise(" ").alias("url"), F.when(k == 1, "[Removed]").otherwise(F.col("title")).alias("title"), F.when(F.col("doc_id") % 3 > 0, "About it").alias("description"), F.struct(F.col("source").alias("name")).alias("source"), F.col("published_at").cast("string").alias("publishedAt")))
    parsed = F.from_json(json, "url string, title string, description string, source struct<name:string>, publishedAt string")
    rows = reports.select(parsed.alias("r")).select("r.url", "r.title", "r.description", F.col("r.source.name").alias("source"), "r.publishedAt")
    return as_articles(rows).select("url", "title", "description", "source", "language")


PACK = "CASE WHEN trust_tier = 'tier_1' THEN 'core' WHEN region <> 'global' THEN 'regional' ELSE 'other' END"


def packs(registry):
    pack = F.when(F.col("trust_tier") == "tier_1", "core").when(F.col("region") != "global", "regional").otherwise("other")
    return registry.select(F.col("source_name").alias("source"), pack.alias("pack"))


@query("S25_direct_feeds", "reports_v", "registry_v", sql=f"""WITH f AS (SELECT source_name AS source, CASE {PACK} WHEN 'core' THEN 1 WHEN 'regional' THEN 2 ELSE 3 END AS pack_order FROM registry_v WHERE source_type <> 'official'),
 e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, url) AS n FROM reports_v JOIN f USING (source)),
 d AS (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY pack_order, published_at DESC, url) AS spot FROM e WHERE n <= 6) SELECT url, source, CAST(spot AS INT) AS place FROM d WHERE spot <= 4""")
def s25(reports, registry):
    kinds = packs(registry).join(registry.select(F.col("source_name").alias("source"), "source_type"), "source")
    hints = F.when(F.col("source_type") == "official", F.array(F.lit("economics"))).otherwise(F.array(F.lit("economics"), F.lit("geopolitics")))
    feeds = kinds.select("source", F.when(F.col("pack") == "core", 1).when(F.col("pack") == "regional", 2).otherwise(3).alias("pack_order"), hints.alias("hints"))
    return R.direct_feeds(reports.select("source", "source_domain", "url", "title", "published_at"), feeds, "geopolitics", 6, 4).select("url", "source", "place")


@query("S26_feed_batch", "reports_v", "registry_v", sql=f"""WITH e AS (SELECT {PACK} AS pack, source, published_at, active AND {count('lower(title)', ['airstrike', 'ceasefire', 'sanctions', 'election', 'inflation'])} > 0 AS promoted FROM reports_v JOIN registry_v ON source = source_name WHERE published_at >= TIMESTAMP '2024-01-03 00:00:00')
 SELECT pack, source, count(*) FILTER (WHERE promoted) AS promoted, count(*) FILTER (WHERE NOT promoted) AS rejected, max(published_at) AS newest, CAST(grouping(pack, source) AS BIGINT) AS level FROM e GROUP BY ROLLUP (pack, source)""")
def s26(reports, registry):
    """Fresh entries by pack and source; promoted are those of active sources with a word of the list in the title."""
    rows = reports.join(packs(registry).join(registry.select(F.col("source_name").alias("source"), "active"), "source"), "source").filter("published_at >= TIMESTAMP '2024-01-03 00:00:00'")
    return R.feed_batch(rows.withColumn("promoted", F.col("active") & N.has_any(F.lower("title"), ["airstrike", "ceasefire", "sanctions", "election", "inflation"])))
