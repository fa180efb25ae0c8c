"""Signatures, pair scores, groups of reports over time, canonical matches, case scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import news as N
from tidewire.functions import scalars as S
from tidewire.operators import graph as G
from tidewire.operators.nearest import class_links

EARTH_KM = 6371.0
#: hours at which the score or the relation of a pair changes
HOURS = (6, 12, 36, 48, 72, 96, 120, 168)


def signatures(rows: DataFrame, text: Column) -> DataFrame:
    """Keywords, anchors and countries of a text beside the row's columns."""
    return rows.withColumns({"keywords": N.keywords(text), "anchors": N.anchors(text), "places": N.countries(text)})


def lexical_score(hours: Column | None = None) -> tuple[Column, Column]:
    """Score and relatedness of a pair with entities, keywords, anchors (suffixes _a, _b) and hours apart (a column ``hours``, if not given)."""
    both = lambda k: F.size(F.array_intersect(f"{k}_a", f"{k}_b"))
    e, k, a = both("entities"), both("keywords"), both("anchors")
    hours = F.col("hours") if hours is None else hours
    near = S.temporal_weight(hours)
    score = (e * 1.9 + k * 0.42 + a * 1.65 + S.jaccard("entities_a", "entities_b") * 2.0 + S.jaccard("keywords_a", "keywords_b") * 1.4 + S.jaccard("anchors_a", "anchors_b") * 1.5) * near
    conflict = N.anchor_conflict(F.col("anchors_a"), F.col("anchors_b"))
    score = score - F.when(conflict & (hours > 6), 2.6).otherwise(0.0) - F.when((hours > 168) & (e < 3), 2.2).otherwise(0.0) - F.when((e == 0) & (a == 0), 0.8).otherwise(0.0)
    score = F.round(score, 3)
    sure = ((a >= 1) & (e >= 1) & (hours <= 96)) | ((e >= 2) & (k >= 2) & (hours <= 120)) | ((k >= 6) & (a >= 1) & (hours <= 48))
    return score, sure | (~(conflict & (e < 3)) & (score >= 4.1))


def lexical_pairs(rows: DataFrame, keys: list[str], days: float) -> DataFrame:
    """(a, b, hours, score, related) of reports that share the keys and lie within ``days``."""
    pairs = G.bucket_pairs(rows, keys, "published_at", days, ["id", "entities", "keywords", "anchors"]).filter("id_a <> id_b")
    pairs = pairs.filter("gap_days > 0 OR id_a < id_b").withColumn("hours", F.col("gap_days") * 24.0)
    score, related = lexical_score()
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "hours", score.alias("score"), related.alias("related"))


def lexical_links(rows: DataFrame, keys: list[str], days: float) -> DataFrame:
    """(a, b): links with the same components and first-fit groups, newest first, as all related pairs within ``days``."""
    gaps = sorted({int(days * 86400), *(h * 3600 for h in HOURS if h < days * 24)})

    def related(gap: Column) -> Column:
        # lexical_score reads the column hours; here it is a fixed number for each band
        return lexical_score(gap / 3600.0)[1]

    return class_links(rows, "id", -F.unix_micros("published_at"), keys, -F.unix_seconds("published_at"), ["entities", "keywords", "anchors"], gaps, related)


def sessions(rows: DataFrame, keys: list[str], time: str, ident: str, days: float = 7.0) -> DataFrame:
    """Groups of reports with known country, in time order: one that comes within ``days`` of
    the last member joins.  Equal countries alone score above the threshold, so the greedy
    pass over group seeds gives just these runs.  The group's first id names it."""
    w = Window.partitionBy(*keys).orderBy(time, ident)
    gap = F.unix_micros(time) - F.lag(F.unix_micros(time)).over(w)
    starts = F.coalesce(gap > int(days * 86_400_000_000), F.lit(True))
    return rows.withColumn("seed", F.last(F.when(starts, F.col(ident)), ignorenulls=True).over(w))


def zones(points: DataFrame, km: float = 350.0) -> DataFrame:
    """Single-linkage zones of points (id, lat, lon): (id, zone), the zone named by its smallest id.

    Points meet on cells of a grid over the unit sphere as wide as the distance (the chord is
    never longer than the arc), so poles and the date line need no care.
    """
    la, lo = F.radians("lat"), F.radians("lon")
    width = km / EARTH_KM
    axes = {"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)}
    cells = points.withColumns({k: F.floor(v / width) for k, v in axes.items()})
    near = cells.select(F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), *axes)
    for k in axes:
        near = near.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    met = near.join(cells.select(F.col("id").alias("b"), "lat", "lon", *axes), list(axes)).filter("a < b")
    links = met.filter(S.haversine("lat_a", "lon_a", "lat", "lon") <= km).select("a", "b")
    labels = G.components(links)
    return points.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("zone"))


def causal_graph(nodes: DataFrame, lag_days: int = 14, least: float = 0.35) -> DataFrame:
    """C14: (cause, effect, score, reasons) of nodes (id, ts, country, entities, text).

    Only pairs that share an entity or the country are formed: they meet on that and a time
    bucket as wide as the lag.  A causal phrase alone says nothing of which event was the cause.
    """
    seconds = (lag_days + 1) * 86400
    keyed = nodes.withColumns({"_k": F.explode(F.array_distinct(F.concat("entities", F.array(F.concat(F.lit("@"), "country"))))), "_t": N.keywords("text"), "_b": F.floor(F.unix_seconds("ts") / seconds)})
    early = keyed.select("_k", F.col("id").alias("cause"), F.col("ts").alias("t0"), F.col("country").alias("c0"), F.col("entities").alias("e0"), F.col("_t").alias("w0"), F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"))
    late = keyed.select("_k", "_b", F.col("id").alias("effect"), F.col("ts").alias("t1"), F.col("country").alias("c1"), F.col("entities").alias("e1"), F.col("_t").alias("w1"), "text")
    lag = F.unix_micros("t1") - F.unix_micros("t0")
    rows = early.join(late, ["_k", "_b"]).filter((lag > 0) & (lag < seconds * 1_000_000)).drop("_k", "_b").dropDuplicates(["cause", "effect"])
    shared, same = F.arrays_overlap("e0", "e1"), F.col("c0") == F.col("c1")
    said = F.lower(F.coalesce("text", F.lit("")))
    first = F.coalesce(*[F.when(F.contains(said, F.lit(p)), F.lit(p)) for p in N.CAUSAL_PHRASES])
    both = F.size(F.array_intersect("w0", "w1")) / F.greatest(F.lit(1), F.least(F.size("w0"), F.size("w1")))
    more = F.when((F.size("w0") > 0) & (F.size("w1") > 0) & (both > 0.1), F.least(F.lit(0.3), both * 0.6)).otherwise(0.0)
    score = F.least(F.lit(1.0), F.when(shared, 0.4).otherwise(0.0) + F.when(same, 0.2).otherwise(0.0) + F.when(first.isNotNull(), 0.35).otherwise(0.0) + more)
    reasons = F.array_compact(F.array(F.when(shared, "shared_entity"), F.when(same, "same_country"), F.concat(F.lit("phrase:"), first), F.when(more > 0, "token_overlap")))
    return rows.select("cause", "effect", F.round(score, 3).alias("score"), reasons.alias("reasons"), score.alias("_s")).filter(F.col("_s") >= least).drop("_s")


def canonical_match(stories: DataFrame, events: DataFrame, days: int = 3, cap: int = 100, least: float = 0.25) -> DataFrame:
    """(story, event, score): the event whose text is most like the story's.

    Candidates are events of the same country within ``days``, the ``cap`` most important of
    them; those of the story's admin area where both are known, or all where none is left.
    The best token overlap of at least ``least`` wins, then the smaller event.
    """
    span = F.sequence(F.date_sub("day", days), F.date_add("day", days))
    left = stories.select("story", "country", F.col("admin1").alias("admin_s"), F.col("words").alias("words_s"), F.explode(span).alias("day"))
    rows = left.join(events.select("event", "country", "day", "importance", "admin1", "words"), ["country", "day"])
    order = Window.partitionBy("story").orderBy(F.desc("importance"), "event")
    rows = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap)
    fits = F.coalesce(F.col("admin1") == F.col("admin_s"), F.lit(True))
    rows = rows.withColumn("_fits", fits).withColumn("_any", F.max("_fits").over(Window.partitionBy("story"))).filter("_fits OR NOT _any")
    rows = rows.withColumn("score", S.jaccard("words_s", "words")).filter(F.col("score") >= least)
    best = F.struct(-F.col("score"), F.col("event"))
    return rows.groupBy("story").agg(F.min_by("event", best).alias("event"), F.max("score").alias("score"))


def pair_quality(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, predicted, expected, tp) pairs of members (case_id, item, cluster) that share a
    cluster, counted from cluster sizes and the sizes of their intersections, so no pair is formed."""
    two = lambda n: n * (n - 1) / 2
    count = lambda df, keys, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).groupBy("case_id").agg(F.sum(two(F.col("n"))).cast("bigint").alias(name))
    both = predicted.join(expected.withColumnRenamed("cluster", "other"), ["case_id", "item"])
    out = count(predicted, ["case_id", "cluster"], "predicted")
    return out.join(count(expected, ["case_id", "cluster"], "expected"), "case_id", "full").join(count(both, ["case_id", "cluster", "other"], "tp"), "case_id", "left").fillna(0)


def case_outcome(rows: DataFrame) -> DataFrame:
    """Metrics of each case (with ``reason`` and ``generated``): perfect F1 passes; a known limit passes
    while it fails; a generated case that states a reason is invalid and fails."""
    p, r = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(1.0), F.when(F.col("expected") > 0, F.col("tp") / F.col("expected")).otherwise(1.0)
    rows = rows.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    invalid, right = F.col("generated") & F.col("reason").isNotNull(), F.col("f1") == 1.0
    passed = F.when(invalid, False).when(F.coalesce(F.col("reason") == "known_architectural_limit", F.lit(False)), ~right).otherwise(right)
    return rows.select("case_id", *[F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")], invalid.alias("invalid"), passed.alias("passed"))


def adjudicated(a: Column, b: Column) -> Column:
    """the source of the better tier of two reports (structs of r, published_at, source), else of the
    later one where both times are known and differ, else 'unresolved'."""
    later = lambda x, y: (x["r"] > y["r"]) | ((x["r"] == y["r"]) & F.coalesce(x["published_at"] > y["published_at"], F.lit(False)))
    return F.when(later(a, b), a["source"]).when(later(b, a), b["source"]).otherwise("unresolved")
