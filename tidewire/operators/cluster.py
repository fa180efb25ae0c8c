"""Pair scores, clustering, canonical identity and claim resolution."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.functions import texts as X
from tidewire.operators import graph as G
from tidewire.operators.nearest import rule_links

# fixed values: thresholds and factors of the semantic pair score
RELATED, GEO_MISMATCH, TOPICAL, LOW_OVERLAP, CONTEXT_FLOOR = 0.38, 0.5, 0.78, 0.92, 0.95
ABSTRACT, THEATRES, BRIDGE, CONTINUITY, STRONG, LONG_WAR = 0.45, 0.35, 0.24, 0.06, 0.24, 0.08
CONTEXT_TERMS = ("iran", "war", "hormuz", "ceasefire", "trump", "oil", "talk", "talks", "diplomatic", "diplomacy")
ANALYSIS_TERMS = ("analysis", "takeaway", "takeaways", "overview", "explainer", "interview", "opinion")
INCIDENT_ANCHORS = ("strike", "detention", "filing", "aid", "vote")
BROAD_PLACES = ("Iran", "Israel", "US", "United States", "Tehran", "Washington")
IDENTITY_FROM = 0.62


def _lit(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def semantic_score(p: str = "_a", q: str = "_b") -> Column:
    """Score of a pair from columns text, embedding, entities, places, actors, anchors,
    keywords (suffixed) and hours apart in ``hours``."""
    both = lambda c: F.size(F.array_intersect(f"{c}{p}", f"{c}{q}"))
    has = lambda c, terms: F.lower(F.col(c)).rlike(r"\b(" + "|".join(terms) + r")\b")
    hours = F.col("hours")
    lp, lq = F.col(f"places{p}"), F.col(f"places{q}")
    geo = F.when((F.size(lp) > 0) & (F.size(lq) > 0) & ~F.arrays_overlap(lp, lq), GEO_MISMATCH).otherwise(1.0)
    context = [F.lower(F.col(f"text{p}")).rlike(rf"\b{t}\b") & F.lower(F.col(f"text{q}")).rlike(rf"\b{t}\b") for t in CONTEXT_TERMS]
    shared_context = reduce(lambda a, b: a + b, [c.cast("int") for c in context])
    topical = F.when((both("entities") > 0) & (both("actors") == 0) & (both("entities") <= 2), TOPICAL).otherwise(1.0)
    topical = topical * F.when((both("entities") <= 1) & (both("anchors") == 0) & (both("keywords") < 3), LOW_OVERLAP).otherwise(1.0)
    topical = F.when((hours <= 96) & (shared_context >= 2), F.greatest(topical, F.lit(CONTEXT_FLOOR))).otherwise(topical)
    sp, sq = F.array_except(lp, _lit(BROAD_PLACES)), F.array_except(lq, _lit(BROAD_PLACES))
    strikes = F.array_contains(f"anchors{p}", "strike") & F.array_contains(f"anchors{q}", "strike")
    topical = topical * F.when(strikes & (F.size(sp) > 0) & (F.size(sq) > 0) & ~F.arrays_overlap(sp, sq), THEATRES).otherwise(1.0)
    incident = lambda s: F.arrays_overlap(F.col(f"anchors{s}"), _lit(INCIDENT_ANCHORS))
    abstract = (has(f"text{p}", ANALYSIS_TERMS) != has(f"text{q}", ANALYSIS_TERMS)) & (both("actors") == 0) & (incident(p) != incident(q)) & (both("places") <= 1)
    topical = topical * F.when(abstract, ABSTRACT).otherwise(1.0)
    front = lambda s: has(f"text{s}", ("iran",)) & has(f"text{s}", ("war", "oil", "trump", "ceasefire", "talks?"))
    strait = lambda s: has(f"text{s}", ("hormuz",))
    boost = F.greatest(
        F.when((hours <= 72) & ((strait(p) & front(q)) | (strait(q) & front(p))), BRIDGE).otherwise(0.0),
        F.when(hours.between(72, 144) & (both("keywords") >= 3) & (both("entities") >= 1), CONTINUITY).otherwise(0.0),
        F.when((hours <= 192) & (both("actors") > 0) & (both("anchors") > 0) & (both("keywords") >= 4), STRONG).otherwise(0.0),
        F.when((hours > 72) & (hours <= 192) & (both("entities") >= 1) & context[0] & (context[1] | context[5]), LONG_WAR).otherwise(0.0),
    )
    score = S.cosine(f"embedding{p}", f"embedding{q}") * S.temporal_weight(hours) * geo * topical + F.when(abstract, 0.0).otherwise(boost)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3)


def first_fit(rows: pd.DataFrame, related: dict[int, set[int]]) -> list[int]:
    """C4, exact form for one block: groups in input order; a row joins the first group
    with a related member.  Returns the group number of each row."""
    groups: list[set[int]] = []
    out = []
    for i in range(len(rows)):
        at = next((g for g, members in enumerate(groups) if members & related.get(i, set())), None)
        if at is None:
            groups.append(set())
            at = len(groups) - 1
        groups[at].add(i)
        out.append(at)
    return out


def structured_score() -> Column:
    """Score of two events of one country and type (columns suffixed _a and _b)."""
    same = lambda c: F.coalesce((F.col(f"{c}_a") != "") & (F.col(f"{c}_a") == F.col(f"{c}_b")), F.lit(False))
    exact = F.size(F.array_intersect("actors_a", "actors_b"))
    tokens = F.size(F.array_intersect("actor_tokens_a", "actor_tokens_b"))
    part = lambda c, v: F.when(same(c), v).otherwise(0.0)
    score = part("sub_event_type", 1.6) + part("admin1", 1.4) + part("admin2", 1.2) + part("location", 2.2) + exact * 2.0 + F.least(tokens, F.lit(3)) * 0.8
    score = score + F.when(F.col("gap_days") <= 1, 1.0).when(F.col("gap_days") <= 2, 0.5).otherwise(0.0)
    lone = (exact == 0) & (tokens == 0) & ~same("admin1") & ~same("location")
    return F.round(score - F.when(lone, 1.5).otherwise(0.0), 3)


def structured_related(score: Column) -> Column:
    same = lambda c: F.coalesce((F.col(f"{c}_a") != "") & (F.col(f"{c}_a") == F.col(f"{c}_b")), F.lit(False))
    return (same("location") & same("sub_event_type")) | (score >= 3.4) | (F.arrays_overlap("actors_a", "actors_b") & same("admin1"))


def structured_rules(days: float) -> list[tuple[list[str], int]]:
    """C5 as rules (columns, gap in seconds): two events are related if they are equal in the columns of one of them.

    For events with one actor at most, who is their only token.  The score only rises with what is equal.
    """
    worth = {"sub_event_type": 1.6, "admin1": 1.4, "admin2": 1.2, "location": 2.2, "actor": 2.8}
    bands = [(g, v) for g, v in ((1.0, 1.0), (2.0, 0.5)) if g < days] + [(days, 1.0 if days <= 1 else 0.5 if days <= 2 else 0.0)]
    found: list[tuple[set[str], int]] = []
    for n in range(len(worth) + 1):
        for some in combinations(worth, n):
            s = set(some)
            base = sum(worth[c] for c in s) - (0.0 if s & {"actor", "admin1", "location"} else 1.5)
            ruled = {"location", "sub_event_type"} <= s or {"actor", "admin1"} <= s
            gap = max((int(g * 86400) for g, v in bands if ruled or round(base + v, 3) >= 3.4), default=-1)
            if gap >= 0 and not any(t <= s and h >= gap for t, h in found):
                found.append((s, gap))
    return [(sorted(s), gap) for s, gap in found]


def structured_links(events: DataFrame, order: list[Column], days: float = 3.0) -> DataFrame:
    """(a, b): links with the same components, and the same first-fit groups in the ``order`` by day, as all related pairs within ``days``."""
    one = (F.size("actors") <= 1) & F.col("actors").eqNullSafe(F.col("actor_tokens")) & ~F.exists("actors", lambda x: x.isNull())
    if events.filter(~F.coalesce(one, F.lit(False))).isEmpty():
        rows = events.withColumn("actor", F.get("actors", F.lit(0)))
        return rule_links(rows, "event_id", order, ["country", "event_type"], F.unix_seconds(F.col("event_date").cast("timestamp")), structured_rules(days))
    # several actors or other tokens: all pairs
    columns = ["event_id", "sub_event_type", "admin1", "admin2", "location", "actors", "actor_tokens"]
    pairs = G.bucket_pairs(events, ["country", "event_type"], "event_date", days, columns).filter("event_id_a <> event_id_b")
    return pairs.filter(structured_related(structured_score())).select(F.col("event_id_a").alias("a"), F.col("event_id_b").alias("b"))


def structured_clusters(events: DataFrame, days: float = 3.0) -> DataFrame:
    """Events joined by related pairs of one country and type within three days."""
    links = structured_links(events, [F.col("event_date")], days)
    return G.assign(events, "event_id", links)


def identity_score() -> Column:
    """Score of an observation (o_*) against a candidate (c_*): 0.93 for a shared URL, 0.9
    for a shared structured id, else entities and label with their boosts."""
    overlap = lambda k: F.arrays_overlap(f"o_{k}", f"c_{k}")
    entity, label = S.jaccard("o_entities", "c_entities"), S.jaccard("o_tokens", "c_tokens")
    shared = F.size(F.array_intersect("o_entities", "c_entities"))
    soft = entity * 0.4 + label * 0.2
    boost = F.when((shared >= 4) & (label >= 0.2), 0.74).when((shared >= 3) & (label >= 0.28), 0.68).when((shared >= 2) & (label >= 0.4), 0.64).otherwise(0.0)
    return F.when(F.coalesce(overlap("urls"), F.lit(False)), 0.93).when(F.coalesce(overlap("ids"), F.lit(False)), 0.9).otherwise(F.round(F.greatest(soft, boost), 4))


def resolve_identity(observations: DataFrame, candidates: DataFrame, threshold: float = IDENTITY_FROM) -> DataFrame:
    """The best candidate of each observation of its topic, or a new event id from the key.

    Pairs meet only on something they share (a URL, a structured id, an entity or a label
    word): a pair without any scores 0.
    """
    marked = lambda p, k: F.transform(f"{p}_{k}", lambda x: F.concat(F.lit(k[0]), x))
    keys = lambda p: F.explode(F.array_distinct(F.concat(*[marked(p, k) for k in ("urls", "ids", "entities", "tokens")])))
    o = observations.select("topic", "observation_key", keys("o").alias("_k"))
    c = candidates.select("topic", "event_id", keys("c").alias("_k"))
    met = o.join(c, ["topic", "_k"]).select("observation_key", "event_id").distinct()
    scored = met.join(observations.drop("topic"), "observation_key").join(candidates.drop("topic"), "event_id").withColumn("score", identity_score())
    w = Window.partitionBy("observation_key").orderBy(F.desc("score"), "event_id")
    ranked = scored.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    best = ranked.groupBy("observation_key").agg(F.max_by("event_id", -F.col("_n")).alias("best"), F.max("score").alias("score"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("runner_up"))
    out = observations.select("observation_key").join(best, "observation_key", "left")
    mapped = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select(
        "observation_key", F.when(mapped, F.col("best")).otherwise(F.concat(F.lit("evt-"), F.substring(F.sha2("observation_key", 256), 1, 16))).alias("event_id"),
        F.when(mapped, "mapped").otherwise("created").alias("action"), "score", "runner_up",
        (mapped & F.coalesce(F.col("score") - F.col("runner_up") < 0.05, F.lit(False))).alias("ambiguous"),
    )


def direct_claim_status(claims: DataFrame, key: list[str], value: str) -> DataFrame:
    """Within a group the value with most distinct sources dominates (ties: the earliest,
    then the smallest); alone it is unresolved.  Others contradict it, unless the dominant
    value came at least six hours after them from other sources' later reports."""
    by = claims.groupBy(*key, value).agg(F.countDistinct("source_name").alias("sources"), F.min("published_at").alias("first_at"))
    top = by.groupBy(*key).agg(F.min_by(F.struct(value, "sources", "first_at"), F.struct(-F.col("sources"), F.col("first_at"), F.col(value))).alias("top"), F.count(F.lit(1)).alias("versions"))
    rows = by.join(top, key)
    own = F.col(value) == F.col(f"top.{value}")
    late = F.unix_seconds("top.first_at") - F.unix_seconds("first_at")
    status = (
        F.when(own & (F.col("sources") >= 2), F.when((F.col("versions") > 1) & (-late >= 21600), "vindicated_later").otherwise("corroborated"))
        .when(own | (F.col("top.sources") < 2), "unresolved").otherwise("contradicted")
    )
    return rows.select(*key, value, "sources", "first_at", status.alias("status"))


def dispute_rows(disputes: DataFrame) -> DataFrame:
    """C11: two rows for each dispute, each with the opposing claim."""
    side = lambda a, b: F.struct(F.col(f"source_{a}").alias("source_name"), F.col(f"claim_{a}").alias("claim_text"), F.col(f"claim_{b}").alias("opposing_claim_text"))
    status = F.when(F.col("credible_source").isNull(), "unresolved").when(F.col("credible_source") == F.col("side.source_name"), "corroborated").otherwise("contradicted")
    return disputes.withColumn("side", F.explode(F.array(side("a", "b"), side("b", "a")))).select("event_key", "side.*", status.alias("resolution_status"))


def fractures(signals: DataFrame, key: str, limit: int = 4) -> DataFrame:
    """Pairs of frames of one subject carried by different sets of sources."""
    by = signals.groupBy(key, "dominant_frame").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    other = by.select(key, F.col("dominant_frame").alias("other_frame"), F.col("sources").alias("other_sources"))
    pairs = by.join(other, key).filter("dominant_frame < other_frame AND sources <> other_sources")
    pairs = pairs.withColumn("weight", F.size("sources") + F.size("other_sources"))
    w = Window.partitionBy(key).orderBy(F.desc("weight"), "dominant_frame", "other_frame")
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select(key, "dominant_frame", "other_frame", "weight", "place")


def number_disputes(claims: DataFrame, key: list[str]) -> DataFrame:
    """Claims of one event by different sources whose numbers differ by half or more.

    Only the smallest and largest value of each source count, so an event gives at most
    the pairs of its sources' extremes against the event's extremes.
    """
    by = claims.groupBy(*key, "source_name").agg(F.min("claim_value").alias("low"), F.max("claim_value").alias("high"))
    edge = by.groupBy(*key).agg(F.min_by("source_name", F.struct("low", "source_name")).alias("low_source"), F.min("low").alias("low"), F.max_by("source_name", F.struct("high", "source_name")).alias("high_source"), F.max("high").alias("high"))
    return edge.filter("low_source <> high_source AND low > 0 AND high >= low * 1.5")


def greedy_dedupe(rows: DataFrame, key: str, rank: str, links: DataFrame) -> DataFrame:
    """Rows by descending rank, each dropped if it overlaps a kept one.

    Decided in rounds over the overlap edges: a row that outranks all its undecided neighbours stays, its
    neighbours go; so no component is gathered in one task.
    """
    G.use_checkpoints(rows.sparkSession)
    order = F.struct(F.col(rank), F.col(key))
    names = rows.select(F.col(key).alias("n"), order.alias("o"))
    both = links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct()
    edges = both.join(names.select(F.col("n").alias("a"), F.col("o").alias("oa")), "a").join(names.select(F.col("n").alias("b"), F.col("o").alias("ob")), "b")
    edges = G.written(edges)
    dropped = None
    while not edges.isEmpty():
        best = edges.groupBy("a").agg(F.max("ob").alias("m"), F.first("oa").alias("o")).filter("o > m").select(F.col("a").alias("kept"))
        gone = G.written(edges.join(best, edges["a"] == best["kept"], "left_semi").select(F.col("b").alias("gone")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        edges = G.written(edges.join(gone, edges["a"] == gone["gone"], "left_anti").join(gone, F.col("b") == gone["gone"], "left_anti"))
    return rows if dropped is None else rows.join(dropped.withColumnRenamed("gone", key), key, "left_anti")


def roots(merges: DataFrame) -> DataFrame:
    """The root id of each merged event, chains followed to their end: (id, root)."""
    G.use_checkpoints(merges.sparkSession)
    step = merges.groupBy(F.col("event_b_id").alias("id")).agg(F.min("event_a_id").alias("root")).filter("id <> root")
    step = G.written(step)
    for _ in range(40):  # doubling: chains of up to 2**40 merges; a cycle keeps its smallest label
        up = step.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        moved = G.written(step.join(up, "root", "left").select("id", F.coalesce("higher", "root").alias("next"), "root"))
        if moved.filter("next <> root AND next <> id").isEmpty():
            return step
        step = moved.select("id", F.col("next").alias("root"))
    return step


def similar_claim_status(claims: DataFrame, key: list[str]) -> DataFrame:
    """(key, source_name, published_at, claim_text, claim_group, status) of claims by event.

    The different texts of an event, in order of their first time, each join the first group
    whose first text is similar (F21), or start one.  The group with most sources (the first
    of equal ones) dominates: by two sources or more it is corroborated, or vindicated later
    where its times span 12 hours (6 where it is the only group); else it is unresolved.  All
    other groups are contradicted.  The greedy pass runs over different texts, not rows.
    """
    texts = claims.groupBy(*key, "claim_text").agg(F.min("published_at").alias("first_at")).withColumn("tokens", X.content_tokens("claim_text"))
    in_order = texts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("first_at", "claim_text", "tokens"))).alias("t"))
    both = lambda a, b: F.size(F.array_intersect(a, b))
    alike = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ((both(a, b) >= 4) | (both(a, b) >= F.least(F.size(a), F.size(b)) * 0.6))
    none = F.struct(F.array().cast("array<array<string>>").alias("seeds"), F.array().cast("array<int>").alias("labels"))

    def put(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc["seeds"], lambda s: alike(s, x["tokens"])), F.lit(True)).cast("int")
        fresh = at == 0
        return F.struct(
            F.when(fresh, F.concat(acc["seeds"], F.array(x["tokens"]))).otherwise(acc["seeds"]).alias("seeds"),
            F.concat(acc["labels"], F.array(F.when(fresh, F.size(acc["seeds"]) + 1).otherwise(at))).alias("labels"),
        )

    labelled = in_order.withColumn("g", F.aggregate("t", none, put)["labels"]).select(*key, F.explode(F.arrays_zip("t", "g")).alias("z")).select(*key, F.col("z.t.claim_text").alias("claim_text"), F.col("z.g").alias("claim_group"))
    rows = claims.join(labelled, [*key, "claim_text"])
    by = rows.groupBy(*key, "claim_group").agg(F.countDistinct(F.lower("source_name")).alias("sources"), (F.unix_micros(F.max("published_at")) - F.unix_micros(F.min("published_at"))).alias("span"))
    top = by.groupBy(*key).agg(F.min_by(F.struct("claim_group", "sources", "span"), F.struct(-F.col("sources"), F.col("claim_group"))).alias("top"), F.count(F.lit(1)).alias("groups"))
    hours = F.when(F.col("groups") == 1, 6).otherwise(12)
    won = F.when(F.col("top.sources") < 2, "unresolved").when(F.col("top.span") >= hours * 3_600_000_000, "vindicated_later").otherwise("corroborated")
    return rows.join(top, key).select(*key, "source_name", "published_at", "claim_text", "claim_group", F.when(F.col("claim_group") == F.col("top.claim_group"), won).otherwise("contradicted").alias("status"))
