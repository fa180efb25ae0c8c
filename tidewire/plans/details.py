"""Further rules fed with all the cases they tell apart, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.functions import news as N
from tidewire.functions import scalars as S
from tidewire.functions import texts as X
from tidewire.operators import reads as R
from tidewire.plans.indices import rounded
from tidewire.plans.registry import query, stored
from tidewire.plans.views import view
from tidewire.sources import scans
from tidewire.streaming.streams import shared_folder

FLAT = "trim(regexp_replace(regexp_replace(description, '[^a-zA-Z0-9 .,;!?]', ' ', 'g'), ' +', ' ', 'g'))"
END = lambda m: f"CASE WHEN strpos(reverse(left(d, 201)), '{m[::-1]}') > 0 AND length(left(d, 201)) - strpos(reverse(left(d, 201)), '{m[::-1]}') - 1 >= 160 THEN trim(left(d, length(left(d, 201)) - strpos(reverse(left(d, 201)), '{m[::-1]}'))) END"
CUT = "CASE WHEN strpos(reverse(left(d, 199)), ' ') > 0 AND length(left(d, 199)) - strpos(reverse(left(d, 199)), ' ') > 0 THEN length(left(d, 199)) - strpos(reverse(left(d, 199)), ' ') ELSE 199 END"


@query("F4_trimmed_summary", "reports_v", sql=f"""WITH r AS (SELECT doc_id, {FLAT} AS d, doc_id % 2 = 0 AS led, title FROM reports_v)
 SELECT doc_id, CASE WHEN length(d) <= 200 THEN d ELSE coalesce({END('. ')}, {END('! ')}, {END('? ')}, {END('; ')}, concat(regexp_replace(left(d, {CUT}), '[ ,;:]+$', ''), '…')) END AS summary, CASE WHEN led THEN 'body' ELSE d END AS untitled FROM r""")
def f4(reports):
    """The text cut at 200 characters; and a description without the title it starts with (every second one)."""
    d = F.trim(F.regexp_replace(F.regexp_replace("description", "[^a-zA-Z0-9 .,;!?]", " "), " +", " "))
    led = F.when(F.col("doc_id") % 2 == 0, F.concat("title", F.lit(" - body"))).otherwise(d)
    return reports.select("doc_id", S.trimmed(d, 200).alias("summary"), S.without_leading_title(led, "title").alias("untitled"))


@query("F22_dates", "orders", sql="""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS found FROM orders""")
def f22(orders):
    """ISO, day-month-year and month-day-year dates inside texts, a date that can't be, and none."""
    k = F.col("o_orderkey") % 5
    day, month, year = F.dayofmonth("o_orderdate").cast("string"), F.date_format("o_orderdate", "MMMM"), F.year("o_orderdate").cast("string")
    said = (
        F.when(k == 0, F.concat(F.lit("Since "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" nothing."))).when(k == 1, F.concat(F.lit("On "), day, F.lit(" "), month, F.lit(" "), year, F.lit(", they met.")))
        .when(k == 2, F.concat(F.lit("By "), month, F.lit(" "), day, F.lit(", "), year)).when(k == 3, F.concat(F.lit("Around "), day, F.lit(" "), F.upper(month), F.lit(", "), year)).otherwise(F.concat(F.lit("31 February "), year))
    )
    return orders.select("o_orderkey", X.date(said).alias("found"))


@query("F29_world_regions", "structured_v", sql="""SELECT event_id, CASE WHEN lo < -30 AND la > 12 THEN 'north_america' WHEN lo < -30 THEN 'south_america' WHEN la > 35 AND lo < 60 THEN 'europe' WHEN la > 12 AND lo >= 25 AND lo < 63 THEN 'middle_east' WHEN la <= 35 AND lo < 52 THEN 'africa'
 WHEN la < -10 AND lo > 110 THEN 'oceania' WHEN la IS NULL THEN 'global' ELSE 'asia' END AS region FROM (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN latitude END AS la, CASE WHEN event_id % 9 > 0 THEN longitude END AS lo FROM structured_v)""")
def f29(structured):
    known = F.col("event_id") % 9 > 0
    return structured.select("event_id", S.world_region(F.when(known, F.col("latitude")), F.when(known, F.col("longitude"))).alias("region"))


@query("F26_story_keys", "reports_v", sql="SELECT place, topic, sha256(concat(topic, '|', arg_max(title, (published_at, doc_id)), '|', CAST(CAST(max(published_at) AS DATE) AS VARCHAR), '|', string_agg(url, '|' ORDER BY url))) AS event_key FROM reports_v GROUP BY place, topic")
def f26(reports):
    """A story's key: topic, label, latest day and its sorted links."""
    by = reports.groupBy("place", "topic").agg(F.max_by("title", F.struct("published_at", "doc_id")).alias("label"), F.max("published_at").alias("latest"), F.sort_array(F.collect_list("url")).alias("urls"))
    return by.select("place", "topic", F.sha2(F.concat_ws("|", "topic", "label", F.to_date("latest").cast("string"), F.array_join("urls", "|")), 256).alias("event_key"))


@query("F30_hotspot_weights", "structured_v", sql="WITH s AS (SELECT country, event_date, CAST(sum(fatalities) AS DOUBLE) AS f, count(DISTINCT actor_primary) AS n FROM structured_v GROUP BY 1, 2) SELECT country, event_date, round((1.0 + ln(1 + f) * 0.9 + least(n, 5) * 0.2) * (0.35 + 0.65 * greatest(0, 1 - date_diff('day', event_date, DATE '2024-01-31') / 30.0)), 6) AS weight FROM s")
def f30(structured):
    """Deaths, sources and age of each country's day."""
    s = structured.groupBy("country", "event_date").agg(F.sum("fatalities").alias("f"), F.countDistinct("actor_primary").alias("n"))
    recency = F.greatest(F.lit(0.0), 1 - F.datediff(F.lit("2024-01-31").cast("date"), "event_date") / 30.0)
    return rounded(s.select("country", "event_date", X.hotspot_weight(F.col("f"), F.col("n"), recency).alias("weight")), "weight", places=6)


@query("F34_story_ranks", "reports_v", sql="""WITH s AS (SELECT place, topic, count(*) AS n, count(DISTINCT source) AS k, max(published_at) AS latest FROM reports_v GROUP BY 1, 2), a AS (SELECT *, epoch((SELECT max(published_at) FROM reports_v) - latest) / 3600.0 AS age FROM s)
 SELECT place, topic, CAST(least(n, 10) * 2 + least(k, 8) * 3 + CASE WHEN age <= 6 THEN 12 WHEN age <= 24 THEN 8 WHEN age <= 72 THEN 4 ELSE 0 END AS INT) AS rank FROM a""")
def f34(reports):
    """Size, sources and the freshness band of each story."""
    by = reports.groupBy("place", "topic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("k"), F.max("published_at").alias("latest"))
    rows = by.join(F.broadcast(reports.agg(F.max("published_at").alias("now"))))
    age = (F.unix_micros("now") - F.unix_micros("latest")) / 3_600_000_000
    return rows.select("place", "topic", X.event_rank(F.col("n"), F.col("k"), age).cast("int").alias("rank"))


@query("F37_importance_parts", "structured_v", sql="""WITH d AS (SELECT country, event_date, CAST(sum(fatalities) AS DOUBLE) AS f, count(DISTINCT actor_primary) AS s, count(DISTINCT dataset) AS t, count(*) FILTER (WHERE event_type = 'Battles') AS c, count(*) AS n FROM structured_v GROUP BY 1, 2), g AS (SELECT *, n - coalesce(lag(n) OVER (PARTITION BY country ORDER BY event_date), n) AS growth FROM d)
 SELECT country, event_date, round(least(ln(1 + f) * 3.5, 25) + least(t * 5.0, 25) + least(s * 2.0, 20) + least(c * 3.0, 15) + least(greatest(growth * 1.5, 0), 15), 6) AS importance FROM g""")
def f37(structured):
    """All five capped parts: deaths, first-tier sources, sources, contradictions and growth over the day before."""
    d = structured.groupBy("country", "event_date").agg(F.sum("fatalities").alias("f"), F.countDistinct("actor_primary").alias("s"), F.countDistinct("dataset").alias("t"), F.count_if(F.col("event_type") == "Battles").alias("c"), F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.partitionBy("country").orderBy("event_date"))
    rows = d.withColumn("growth", F.col("n") - F.coalesce(before, F.col("n")))
    return rounded(rows.select("country", "event_date", X.importance(F.col("f"), F.col("t"), F.col("s"), F.col("c"), F.col("growth")).alias("importance")), "importance", places=6)


@query("F48_bucket_medians", "structured_v", sql="SELECT concat(isoyear(event_date), '-W', lpad(CAST(week(event_date) AS VARCHAR), 2, '0')) AS bucket, country, median(fatalities) AS median FROM structured_v GROUP BY 1, 2")
def f48(structured):
    return structured.groupBy(S.week_label("event_date").alias("bucket"), "country").agg(F.median("fatalities").alias("median"))


@query("F49_numbered_signals", "mentions_v", sql="""WITH n AS (SELECT topic, entity, count(*) FILTER (WHERE CAST(substr(entity, 2) AS INT) % 2 = 0) AS a, count(*) AS n FROM mentions_v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, entity) AS k FROM n)
 SELECT topic, string_agg(concat(k, '. ', entity, ': ', n, CASE WHEN a > 0 THEN ' mentions (rising)' ELSE ' mentions' END), chr(10) ORDER BY k) AS text FROM r WHERE k <= 8 GROUP BY topic""")
def f49(mentions):
    """The eight most named entities of a topic as numbered lines of one text."""
    n = mentions.groupBy("topic", "entity").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "entity"))
    rows = n.withColumn("k", k).filter("k <= 8")
    line = F.concat(F.col("k").cast("string"), F.lit(". "), "entity", F.lit(": "), F.col("n").cast("string"), F.when(F.substring("entity", 2, 9).cast("int") % 2 == 0, " mentions (rising)").otherwise(" mentions"))
    return rows.groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))), lambda e: e["line"]), "\n").alias("text"))


@stored("S1_csv_archive", sql="SELECT url, title, source, language FROM reports_v")
def s1(spark, sf_dir):
    """A CSV archive with a header under other names for its columns."""
    out = shared_folder(spark, "s1-csv")
    view(spark, sf_dir, "reports_v").select(F.col("url").alias("link"), F.col("title").alias("headline"), F.col("source").alias("publisher"), F.col("language").alias("lang")).write.option("header", True).csv(out)
    return scans.as_articles(scans.read_records(spark, out, "csv")).select("url", "title", "source", "language")


@query("S1_wrapped_json", "reports_v", sql="SELECT url, title, source FROM reports_v")
def s1b(reports):
    """Wrapper objects under any of the known names, each with a list of records."""
    item = F.struct(F.col("url").alias("article_url"), F.col("title").alias("name"), F.col("source").alias("source_name"))
    names = list(scans.WRAPPERS)
    wrapped = F.coalesce(*[F.when(F.col("doc_id") % len(names) == i, F.to_json(F.struct(F.array(item).alias(n)))) for i, n in enumerate(names)])
    record = "array<struct<article_url:string,name:string,source_name:string>>"
    parsed = F.from_json("json", ", ".join(f"{n} {record}" for n in names))
    rows = reports.select(wrapped.alias("json")).select(parsed.alias("w")).select(F.explode(F.coalesce(*[F.col(f"w.{n}") for n in names])).alias("r")).select("r.*")
    return scans.as_articles(rows).select("url", "title", "source")


@query("S4_routing_cases", "reports_v", sql="""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['economics', 'sport'] WHEN 1 THEN ['sport'] ELSE [] END AS own, contains(lower(title), 'strike') OR contains(lower(title), 'attack') AS conflict FROM reports_v)
 SELECT doc_id, 'economics' AS topic FROM r WHERE list_contains(own, 'economics') UNION ALL SELECT doc_id, 'geopolitics' FROM r WHERE NOT list_contains(own, 'economics') AND conflict""")
def s4(reports):
    """Known topics of the record first, else one inferred from the title; rows without any go."""
    none = F.array().cast("array<string>")
    own = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("economics"), F.lit("sport"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("sport"))).otherwise(none)
    inferred = F.when(N.has_any(F.lower("title"), ["strike", "attack"]), F.array(F.lit("geopolitics"))).otherwise(none)
    rows = reports.withColumn("topics", own).withColumn("inferred", inferred).drop("topic")
    return scans.route_topics(rows, ["economics", "geopolitics"], inferred=F.col("inferred")).select("doc_id", "topic")


@query("S8_export_rules", "structured_v", sql="""SELECT CAST(event_id AS VARCHAR) AS event_id, CASE event_id % 6 WHEN 0 THEN 'Battles' WHEN 1 THEN 'Protests' WHEN 2 THEN 'Violence against civilians' ELSE 'Strategic developments' END AS event_type, 'Port, Land' AS location FROM structured_v
 WHERE event_id % 11 > 0 AND event_id % 13 > 0 AND event_id % 7 > 0 AND (event_id % 6 < 3 OR event_id % 6 = 4)""")
def s8(structured):
    """Export lines of six kinds: roots 19, 14, 18, then 05 of class 1 (dropped), 03 of class 3 (kept), 12 of class 2 (dropped); null island, short days and blank coordinates go."""
    k, i = F.col("event_id") % 6, F.col("event_id")
    root = F.when(k == 0, "19").when(k == 1, "14").when(k == 2, "18").when(k == 3, "05").when(k == 4, "03").otherwise("12")
    quad = F.when(k == 3, "1").when(k == 4, "3").when(k == 5, "2").otherwise("4")
    point = lambda c: F.when(i % 11 == 0, "0").when(i % 7 == 0, "").otherwise((F.col(c) + 200).cast("string"))
    day = F.when(i % 13 == 0, "202401").otherwise(F.date_format("event_date", "yyyyMMdd"))
    line = F.concat_ws("\t", i.cast("string"), day, root, quad, F.lit("Land"), F.lit("Port, Port, Land"), point("latitude"), point("longitude"), "actor_primary", F.lit("3"))
    return scans.export_events(structured.select(line.alias("line"))).select("event_id", "event_type", "location")


@stored("S11_atom_entries", sql="SELECT url, title FROM (SELECT url, title, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, url) AS n FROM reports_v WHERE published_at >= TIMESTAMP '2024-01-02 00:00:00') WHERE n <= 5")
def s11(spark, sf_dir):
    """Atom entries, those since a day, the newest five of each source."""
    out = shared_folder(spark, "s11-atom")
    rows = view(spark, sf_dir, "reports_v").select("title", F.col("url").alias("id"), F.col("source").alias("summary"), F.col("published_at").cast("string").alias("updated"))
    rows.write.option("rowTag", "entry").option("rootTag", "feed").xml(out)
    entries = scans.feed_items(spark, out).withColumn("published_at", F.col("published_at").cast("timestamp")).filter("published_at >= TIMESTAMP '2024-01-02 00:00:00'")
    return R.top_per(entries, ["description"], 5, F.desc("published_at"), F.col("url")).select("url", "title")


@query("S14_link_rules", "reports_v", sql="""SELECT doc_id, concat('https://', source, '.example/news/', doc_id) AS url FROM reports_v WHERE doc_id % 3 > 0 AND contains(lower(title), 'talks')""")
def s14(reports):
    """Links of pages made of reports: allowed is /news/, blocked is /login/, the text must name talks."""
    page = F.concat(F.lit('<p><a href="/news/'), F.col("doc_id").cast("string"), F.lit('">'), "title", F.lit('</a> <a href="/login/x">Log in to read on here</a> <a href="/other">'), "title", F.lit("</a></p>"))
    rows = reports.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://"), "source", F.lit(".example/"), F.lit("x")).alias("url"), F.when(F.col("doc_id") % 3 > 0, page).alias("html"))
    links = scans.page_links(rows, allowed="/news/", blocked="/login/", keywords=["talks"])
    return links.select(F.col("page_id").alias("doc_id"), "url")


@query("S19_newest_label_files", "labels", sql="SELECT concat('labels-', lpad(CAST(doc_id % 9 AS VARCHAR), 3, '0'), '.jsonl') AS file, count(*) AS n, count(*) FILTER (WHERE doc_id % 7 > 0) AS valid FROM labels WHERE doc_id % 9 >= 5 GROUP BY 1")
def s19(labels):
    """The four newest files by name; bad lines are counted."""
    line = F.to_json(F.struct("doc_id", "quality"))
    rows = labels.select(F.concat(F.lit("labels-"), F.lpad((F.col("doc_id") % 9).cast("string"), 3, "0"), F.lit(".jsonl")).alias("file"), F.when(F.col("doc_id") % 7 > 0, line).otherwise(F.concat(F.lit("{"), line)).alias("line"))
    newest = R.newest(rows.select("file").distinct(), 4, F.desc("file"))
    return scans.label_lines(rows.join(newest, "file"), "doc_id bigint, quality int").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"))


@query("P10_requeued_failures", "customer", sql="""WITH q AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'HTTP 503 error' WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'connection timed out' WHEN 3 THEN 'no topic' ELSE 'parse error' END AS error, c_custkey % 2 = 0 AS failed FROM customer)
 SELECT id, CASE WHEN failed AND error IN ('HTTP 503 error', 'connection timed out') THEN 'retry' WHEN failed AND error = 'no topic' THEN 'pending' WHEN failed THEN 'failed' ELSE 'fetched' END AS fetch_status FROM q""")
def p10(customer):
    """Failed rows go back to retry where the error may pass, those without a topic to pending."""
    k = F.col("c_custkey") % 5
    error = F.when(k == 0, "HTTP 503 error").when(k == 1, "HTTP 404").when(k == 2, "connection timed out").when(k == 3, "no topic").otherwise("parse error")
    failed = F.col("c_custkey") % 2 == 0
    status = F.when(~failed, "fetched").when(R.retryable(error), "retry").when(error == "no topic", "pending").otherwise("failed")
    return customer.select(F.col("c_custkey").alias("id"), status.alias("fetch_status"))


@query("P14_point_reads", "reports_v", "claims_v", sql="""SELECT 'history' AS kind, url AS key FROM (SELECT url FROM reports_v WHERE place = 'Kyiv' ORDER BY published_at DESC, url LIMIT 10) UNION ALL SELECT 'claims', concat(source_name, '-', l_linenumber) FROM (SELECT * FROM claims_v WHERE event_key = '7' ORDER BY published_at DESC, source_name, l_orderkey, l_linenumber LIMIT 20)
 UNION ALL SELECT 'framing', url FROM reports_v WHERE url IN (SELECT url FROM reports_v WHERE doc_id % 97 = 5) UNION ALL SELECT 'snapshot', arg_max(title, (published_at, doc_id)) FROM reports_v GROUP BY place UNION ALL SELECT 'reference', url FROM reports_v WHERE actor = 'Group 5' AND published_at >= TIMESTAMP '2024-01-03 00:00:00'""")
def p14(reports, claims):
    """History of a key, claims of an event, rows of given links, the newest of each key, and those of a key not older than a time."""
    named = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("key"))
    history = R.newest(reports.filter("place = 'Kyiv'"), 10, F.desc("published_at"), F.col("url"))
    own = R.newest(claims.filter("event_key = '7'"), 20, F.desc("published_at"), F.col("source_name"), F.col("l_orderkey"), F.col("l_linenumber")).withColumn("k", F.concat_ws("-", "source_name", "l_linenumber"))
    framing = R.by_ids(reports, reports.filter("doc_id % 97 = 5").select("url"), "url")
    snapshot = R.latest(reports, ["place"], "published_at", "doc_id")
    fresh = reports.filter("actor = 'Group 5' AND published_at >= TIMESTAMP '2024-01-03 00:00:00'")
    parts = [named(history, "history", "url"), named(own, "claims", "k"), named(framing, "framing", "url"), named(snapshot, "snapshot", "title"), named(fresh, "reference", "url")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("J22_best_articles", "reports_v", sql="""WITH w AS (SELECT actor AS cluster, CASE WHEN doc_id % 2 = 0 THEN url ELSE concat(url, '?ref=1') END AS wanted FROM reports_v WHERE doc_id % 4 < 3), m AS (SELECT DISTINCT cluster, r.url, r.title, r.source, r.published_at FROM w JOIN reports_v r ON wanted = r.url OR wanted = concat(r.url, '?ref=1'))
 SELECT cluster, arg_max(title, (published_at, url)) AS title, count(*) AS matched, count(DISTINCT source) AS sources FROM m GROUP BY cluster""")
def j22(reports):
    """The newest article that a cluster's links name, by the stored or the canonical link; matched rows and sources."""
    wanted = reports.filter("doc_id % 4 < 3").select(F.col("actor").alias("cluster"), F.when(F.col("doc_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("?ref=1"))).alias("wanted"))
    keys = reports.select("url", "title", "source", "published_at").withColumn("wanted", F.explode(F.array(F.col("url"), F.concat("url", F.lit("?ref=1")))))
    met = wanted.join(keys, "wanted").drop("wanted").dropDuplicates(["cluster", "url"])
    return met.groupBy("cluster").agg(F.max_by("title", F.struct("published_at", "url")).alias("title"), F.count(F.lit(1)).alias("matched"), F.countDistinct("source").alias("sources"))
