"""Country indices: conflict, attention, contradictions, severity, activity, volatility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.operators.matching import collected, first_in_list

# fixed values: severity of an event type, weights and midpoints of the components
SEVERITY = {"Battles": 3.0, "Violence against civilians": 4.0, "Explosions/Remote violence": 3.5, "Protests": 1.0, "Riots": 1.5, "Strategic developments": 2.0}
WEIGHTS = {"conflict": 0.30, "media_attention": 0.20, "contradiction": 0.15, "event_severity": 0.20, "entity_activity": 0.10, "narrative_volatility": 0.05}
MIDPOINTS = {"conflict": 30, "media_attention": 30, "contradiction": 3, "event_severity": 20, "entity_activity": 2.0, "narrative_volatility": 4}
ACTIVE_FROM, CONVERGING = 20.0, 2


def lookup(c: Column, values: dict, default: float) -> Column:
    """A small fixed table as a CASE expression."""
    return reduce(lambda e, kv: e.when(c == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(default))).otherwise(F.lit(default))


def logistic(value: Column, midpoint: float, steepness: float = 4.0) -> Column:
    """0 for no signal, 50 at the midpoint, towards 100 beyond."""
    x = (value.cast("double") - F.lit(float(midpoint))) / F.lit(float(max(midpoint, 1)))
    return F.when(value <= 0, F.lit(0.0)).otherwise(F.lit(100.0) / (F.lit(1.0) + F.exp(F.lit(-steepness) * x)))


def conflict(events: DataFrame) -> DataFrame:
    """Severity-weighted events plus half the fatalities."""
    weight = lookup(F.col("event_type"), SEVERITY, 1.0)
    by = events.groupBy(S.country("country").alias("country")).agg(
        F.count(F.lit(1)).alias("event_count"), F.sum(F.coalesce("fatalities", F.lit(0))).alias("fatalities"), F.sum(weight).alias("weighted_count")
    )
    return by.withColumn("score", logistic(F.col("weighted_count") + F.col("fatalities") * 0.5, MIDPOINTS["conflict"]))


def severity(events: DataFrame) -> DataFrame:
    """Fatalities, plus ten for each event with ten or more."""
    by = events.groupBy(S.country("country").alias("country")).agg(F.sum(F.coalesce("fatalities", F.lit(0))).alias("total_fatalities"), F.count_if(F.col("fatalities") >= 10).alias("high_fatality_events"))
    return by.withColumn("score", logistic(F.col("total_fatalities") + F.col("high_fatality_events") * 10, MIDPOINTS["event_severity"]))


def recency(ts: Column, as_of: str, hours: int) -> Column:
    """1 now, 0 at the edge of the window or where the time is unknown."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts)) / F.lit(3.6e9))
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.coalesce(age, F.lit(float(hours))) / F.lit(float(hours)), F.lit(1.0)))


def attention(articles: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    """Articles by region, newer ones weighing up to 2.5; region 'global' is left out."""
    rows = articles.filter(F.col("published_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
    by = rows.withColumn("country", F.lower(F.trim(F.coalesce("region", F.lit("global"))))).filter("country <> 'global'").groupBy("country").agg(
        F.sum(F.lit(1.0) + recency(F.col("published_at"), as_of, hours) * 1.5).alias("weighted_articles"), F.countDistinct("source_domain").alias("source_count")
    )
    return by.withColumn("score", logistic(F.col("weighted_articles"), MIDPOINTS["media_attention"]))


def label_country(records: DataFrame, countries: DataFrame, label: str = "event_label") -> DataFrame:
    """The first gazetteer country that a label contains; ``countries`` has name, position.

    Each different label is read once by the automaton of all names; labels without any are left out.
    """
    listed = countries.select(F.lower("name").alias("name"), "position")
    names = collected(records.sparkSession, listed)
    if names is None:
        raise ValueError("a gazetteer must be small enough to be broadcast")
    first = {r.name: r.position for r in listed.groupBy("name").agg(F.min("position").alias("position")).collect() if r.name in set(names)}
    hit = first_in_list(records.select(label).distinct(), F.lower(label), first, "country").filter("country IS NOT NULL")
    return records.join(hit, label)


def contradictions(disputes: DataFrame, countries: DataFrame) -> DataFrame:
    """Contradictions by the country that the dispute's label names."""
    by = label_country(disputes, countries).groupBy(S.country("country").alias("country")).agg(F.sum("contradiction_count").alias("contradiction_count"), F.count(F.lit(1)).alias("event_count"))
    return by.withColumn("score", logistic(F.col("contradiction_count"), MIDPOINTS["contradiction"]))


def activity(spikes: DataFrame, places: DataFrame) -> DataFrame:
    """Mean spike ratio of place entities with a ratio of 1.5 or more."""
    rows = spikes.filter("entity_type = 'GPE' AND spike_ratio >= 1.5").join(places, "entity")
    by = rows.groupBy(S.country("country").alias("country")).agg(F.avg("spike_ratio").alias("avg_ratio"), F.count(F.lit(1)).alias("spikes"))
    return by.withColumn("score", logistic(F.col("avg_ratio"), MIDPOINTS["entity_activity"]))


def volatility(framing: DataFrame) -> DataFrame:
    """Distinct frames of a subject."""
    by = framing.groupBy(S.country("subject_key").alias("country")).agg(F.countDistinct("dominant_frame").alias("frames"))
    return by.withColumn("score", logistic(F.col("frames"), MIDPOINTS["narrative_volatility"]))


def event_scores(events: DataFrame) -> DataFrame:
    """A12, A15 in one grouping: (country, conflict, event_severity)."""
    weight = lookup(F.col("event_type"), SEVERITY, 1.0)
    by = events.groupBy(S.country("country").alias("country")).agg(F.sum(F.coalesce("fatalities", F.lit(0))).alias("f"), F.sum(weight).alias("w"), F.count_if(F.col("fatalities") >= 10).alias("high"))
    return by.select("country", logistic(F.col("w") + F.col("f") * 0.5, MIDPOINTS["conflict"]).alias("conflict"), logistic(F.col("f") + F.col("high") * 10, MIDPOINTS["event_severity"]).alias("event_severity"))


def components(*wide: DataFrame, **parts: DataFrame) -> DataFrame:
    """Outer union of component tables as one row per country, 0 where a part is missing.

    A part has a ``score``; a wide table has several components by name.
    """
    rows = [p.select("country", F.lit(k).alias("part"), "score") for k, p in parts.items()]
    for w in wide:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("score")) for c in w.columns if c in WEIGHTS]))
        rows.append(w.select("country", cells.alias("c")).select("country", "c.*"))
    stacked = reduce(DataFrame.unionByName, rows)
    return stacked.filter("country IS NOT NULL").groupBy("country").pivot("part", list(WEIGHTS)).agg(F.first("score")).fillna(0.0, list(WEIGHTS))


def instability(parts: DataFrame) -> DataFrame:
    """Weighted sum of the components, at most 100, with a level band."""
    score = F.least(F.lit(100.0), reduce(lambda a, b: a + b, [F.col(k) * w for k, w in WEIGHTS.items()]))
    level = F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "elevated").otherwise("low")
    return parts.withColumn("score", score).withColumn("level", level)


def convergence(parts: DataFrame) -> DataFrame:
    """Countries with at least two active domains, boosted by each further one."""
    on = {k: F.col(k) >= ACTIVE_FROM for k in WEIGHTS}
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in on.items()]))
    force, media, fog, entity, story = on["conflict"] | on["event_severity"], on["media_attention"], on["contradiction"], on["entity_activity"], on["narrative_volatility"]
    kind = (
        F.when(force & media & fog, "crisis_escalation").when(force & entity, "military_escalation").when(media & fog & story, "information_crisis")
        .when(force & media, "conflict_spotlight").when(media & entity, "emerging_situation").when(fog & story, "narrative_instability").otherwise("multi_signal")
    )
    base = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in WEIGHTS.items()])
    rows = parts.withColumn("active", names).withColumn("domain_count", F.size("active")).filter(F.col("domain_count") >= CONVERGING)
    return rows.withColumn("score", F.least(F.lit(100.0), base * (F.lit(1.0) + (F.col("domain_count") - CONVERGING) * 0.15))).withColumn("convergence_type", kind)


def trend(scores: DataFrame, snapshots: DataFrame, as_of: str, step: float = 5.0, rise: str = "rising", fall: str = "falling") -> DataFrame:
    """Each score against its country's snapshot nearest to 24 hours ago, within 12 hours."""
    gap = F.abs(F.unix_seconds(F.lit(as_of).cast("timestamp")) - 86400 - F.unix_seconds("at"))
    near = snapshots.filter(gap <= 43200).groupBy("country").agg(F.min_by("score", F.struct(gap, "at")).alias("previous"))
    delta = F.col("score") - F.col("previous")
    label = F.when(F.col("previous").isNull(), "new").when(delta > step, rise).when(delta < -step, fall).otherwise("stable")
    return scores.join(near, "country", "left").withColumn("trend", label)
