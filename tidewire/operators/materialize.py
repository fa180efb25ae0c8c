"""C17: stories from reports, their identity, importance, evidence and perspectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import importance as I
from tidewire.functions import news as N
from tidewire.operators.firstfit import first_fit

#: entities and anchors that a story is known by, links to events that it takes
FOCUS, LINKED = 6, 80


def group_reports(reports: DataFrame, links: DataFrame) -> DataFrame:
    """C4: the reports (id, published_at, ...) with ``story``, newest first, each in the first group it is related to."""
    order = reports.withColumn("newest", -F.unix_micros("published_at"))
    return first_fit(order, "id", ["newest"], links).withColumnRenamed("group", "story").drop("newest")


def most_common(rows: DataFrame, key: str, values: Column, name: str, most: int) -> DataFrame:
    """(key, name): the ``most`` values that most rows of a key have, ties in order of the value."""
    counted = rows.select(key, F.explode(F.array_distinct(values)).alias("v")).groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "v"))).filter(F.col("r") <= most)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias(name))


def stories(grouped: DataFrame) -> DataFrame:
    """One row per story: topic, label (its newest title), earliest, latest, counts, entity and anchor focus.

    The links of a story stay a table of their own (:func:`group_reports`), so no story is gathered in a row.
    """
    newest = F.struct("published_at", "id")
    base = grouped.groupBy("story").agg(
        F.max_by("topic", newest).alias("topic"), F.max_by("title", newest).alias("label"), F.min("published_at").alias("earliest"), F.max("published_at").alias("latest"),
        F.count(F.lit(1)).alias("article_count"), F.countDistinct("source").alias("source_count"),
    )
    focus = most_common(grouped, "story", F.col("entities"), "entity_focus", FOCUS).join(most_common(grouped, "story", F.col("anchors"), "anchor_focus", FOCUS), "story", "full")
    none = F.array().cast("array<string>")
    out = base.join(focus, "story", "left").withColumns({c: F.coalesce(c, none) for c in ("entity_focus", "anchor_focus")})
    return out.withColumn("event_type", N.story_type("label", F.col("anchor_focus")))


def link_events(found: DataFrame, events: DataFrame, days: int = 2, most: int = LINKED) -> DataFrame:
    """J7 in full: (story, event_id, country, fatalities) of the newest ``most`` events between ``days`` before the first and
    after the last report; of those only the events in a country of the story, where it has any of these.

    The newest events of a span are those of its last days, so events are first ranked inside
    their day and only the ``most`` newest of a day can count: a story meets at most that many a day.
    """
    per_day = events.withColumn("n", F.row_number().over(Window.partitionBy("event_date").orderBy(F.desc("event_id")))).filter(F.col("n") <= most)
    counts = events.groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))
    first, last = F.date_sub(F.to_date("earliest"), days), F.date_add(F.to_date("latest"), days)
    span = found.select("story", "countries", F.explode(F.sequence(first, last)).alias("event_date")).join(counts, "event_date")
    # days are taken from the last on until they hold enough events
    later = F.sum("events").over(Window.partitionBy("story").orderBy(F.desc("event_date")).rowsBetween(Window.unboundedPreceding, -1))
    days_taken = span.withColumn("later", F.coalesce(later, F.lit(0))).filter(F.col("later") < most)
    met = days_taken.join(per_day.select("event_date", "event_id", "country", "fatalities", "n"), "event_date").filter(F.col("later") + F.col("n") <= most)
    met = met.withColumn("fits", F.array_contains("countries", F.lower("country")))
    any_fits = F.max("fits").over(Window.partitionBy("story"))
    return met.withColumn("any", any_fits).filter("fits OR NOT any").select("story", "event_id", "country", "fatalities")


def importance_rows(found: DataFrame, grouped: DataFrame, linked: DataFrame, registry: DataFrame, last: DataFrame, now: Column) -> DataFrame:
    """(story, importance, reasons and the five parts).

    ``registry``: source_domain, trust_tier, region; ``last``: story, last_articles, last_sources, last_contradictions.
    """
    known = grouped.select("story", "source", "source_domain", "language").join(registry.select("source_domain", "trust_tier", "region"), "source_domain", "left")
    known = known.withColumns({"tier": I.tier(F.col("trust_tier")), "region": F.coalesce("region", F.lit("global"))})
    by_source = known.groupBy("story", F.lower("source").alias("s")).agg(F.min("tier").alias("tier"))
    sources = by_source.groupBy("story").agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("tier") == "tier_1").alias("tier1"), F.avg(I.credibility(F.col("tier"), F.lit(None).cast("double"))).alias("credibility"))
    spread = known.groupBy("story").agg(F.countDistinct("region").alias("regions"), F.countDistinct("language").alias("languages"))
    events = linked.groupBy("story").agg(F.count(F.lit(1)).alias("linked"), F.sum("fatalities").alias("fatalities"))
    rows = found.join(sources, "story").join(spread, "story").join(events, "story", "left").join(last, "story", "left").fillna(0, ["linked", "fatalities"])
    hits = F.array_sort(F.array_intersect("anchor_focus", F.array(*[F.lit(x) for x in I.ESCALATION])))
    rows = rows.withColumns({"hits": hits, "contradictions": F.lit(0), "age": (F.unix_micros(now) - F.unix_micros("latest")) / 3_600_000_000})
    c = F.col
    found_parts = I.parts(c("sources"), c("tier1"), c("credibility"), c("regions"), c("languages"), F.size("entity_focus"), F.size("hits"), c("contradictions"), c("linked"), c("fatalities"), c("article_count"), c("last_articles"), c("last_sources"), c("last_contradictions"), c("age"))
    delta = lambda a, b: F.greatest(c(a) - F.coalesce(c(b), F.lit(0)), F.lit(0))
    why = I.reasons(found_parts, c("sources"), c("tier1"), c("regions"), c("languages"), c("hits"), c("contradictions"), c("fatalities"), c("last_articles").isNull(), delta("article_count", "last_articles"), delta("sources", "last_sources"))
    shown = [F.round(v, 2).alias(k) for k, v in found_parts.items() if k != "fatality_part"]
    return rows.select("story", I.score(found_parts).alias("importance"), why.alias("reasons"), *shown)


def evidence_rows(found: DataFrame, grouped: DataFrame) -> DataFrame:
    """why each report is in its story: overlaps with the story's focus and words, and the rule that holds."""
    about = found.select("story", "label", "latest", F.transform("entity_focus", F.lower).alias("ents"), "anchor_focus")
    about = about.withColumn("event_words", F.array_distinct(F.concat(N.assignment_tokens("label"), N.assignment_tokens(F.array_join("anchor_focus", " ")), N.assignment_tokens(F.array_join("ents", " ")))))
    rows = grouped.select("story", "id", F.lower(F.concat_ws(" ", "title", "description")).alias("t"), "published_at").join(about, "story")
    within = lambda names: F.size(F.filter(names, lambda x: F.contains(F.col("t"), x)))
    rows = rows.select(
        "story", "id", within("ents").alias("entity_overlap"), within("anchor_focus").alias("anchor_overlap"), F.size(F.array_intersect(N.assignment_tokens("t"), "event_words")).alias("keyword_overlap"),
        (F.unix_seconds("latest") - F.unix_seconds("published_at")).alias("gap"),
    )
    rows = rows.withColumn("gap", F.abs("gap") / 3600.0)
    args = [F.col(x) for x in ("entity_overlap", "anchor_overlap", "keyword_overlap", "gap")]
    rows = rows.withColumn("final_score", N.assignment_score(*args))
    return rows.withColumn("rule", N.assignment_rule(*args, F.col("final_score"))).drop("gap")


def perspective_rows(decided: DataFrame, grouped: DataFrame, framing: DataFrame, registry: DataFrame) -> DataFrame:
    """K10's rows: one for each report of an event, under the hash of both, with the source's tier and region and the report's frame.

    ``decided``: story, event_id; ``framing``: article_url, dominant_frame, once for each URL.
    """
    rows = grouped.select("story", "url", "source", "source_domain").join(decided.select("story", "event_id"), "story")
    rows = rows.join(framing.select(F.col("article_url").alias("url"), "dominant_frame"), "url", "left").join(registry.select("source_domain", "trust_tier", "region"), "source_domain", "left")
    return rows.select(F.sha2(F.concat_ws("|", "event_id", "url"), 256).alias("perspective_id"), "event_id", F.col("url").alias("article_url"), F.col("source").alias("source_name"), "trust_tier", F.col("region").alias("source_region"), "dominant_frame")
