"""The golden cases of identity and adjudication, retyped as small tables."""

import re

from pyspark.sql import functions as F

from tidewire.operators import materialize
from tidewire.operators.cluster import resolve_identity
from tidewire.operators.stories import adjudicated

STOP = set("the a an and or to of in on for with as by from at after before over under amid into is are was were be been it its their his her they them this that these those".split())
# fixed values: the golden cases of identity
CASES = {
    "shared link": (
        ("Kyiv missile strike kills civilians", ["Kyiv", "Ukraine", "Russia"], ["https://reuters.com/article/kyiv-strike-01", "https://apnews.com/article/kyiv-02"], []),
        [("canon-001", "Russian missile attack on Kyiv", ["Ukraine", "Russia", "Kyiv", "Putin"], ["https://reuters.com/article/kyiv-strike-01", "https://bbc.com/kyiv-01"], []), ("canon-002", "North Korea ballistic missile test", ["North Korea", "Kim Jong Un", "Japan"], ["https://bbc.com/nk-missile-01"], [])],
        ("canon-001", 0.9, 1.0),
    ),
    "shared structured event": (
        ("Sudan RSF advances in Khartoum fighting", ["Sudan", "RSF", "SAF", "Khartoum", "Omdurman"], ["https://reuters.com/sudan-03", "https://apnews.com/sudan-04"], ["ACLED-SDN-2024-001", "ACLED-SDN-2024-002"]),
        [("canon-010", "Sudan civil war: RSF vs SAF in Khartoum", ["Sudan", "RSF", "SAF", "Khartoum", "Burhan"], ["https://bbc.com/sudan-01", "https://reuters.com/sudan-02"], ["ACLED-SDN-2024-001"]), ("canon-011", "Gaza conflict: Hamas and Israeli forces", ["Gaza", "Hamas", "Israel", "IDF", "Netanyahu"], ["https://reuters.com/gaza-01"], [])],
        ("canon-010", 0.62, 1.0),
    ),
    "same country, another event": (
        ("Cairo economic protests clash with police", ["Egypt", "Cairo", "protesters", "police"], ["https://apnews.com/cairo-protest-01"], []),
        [("canon-020", "Egypt election results disputed by opposition", ["Egypt", "Cairo", "Sisi", "election", "opposition"], ["https://reuters.com/egypt-election-01"], [])],
        (None, 0.0, 0.62),
    ),
    "no candidates": (("Coup attempt in Burkina Faso", ["Burkina Faso", "military", "Traore"], ["https://reuters.com/burkina-01"], []), [], (None, None, None)),
}


def tokens(label):
    return sorted({t for t in (re.sub("[^a-z0-9]+", "", w.lower()) for w in label.split()) if len(t) >= 3 and t not in STOP})


def test_identity_cases(spark):
    row = lambda case, key, label, ents, urls, ids: (case, key, sorted({e.lower() for e in ents}), tokens(label), urls, ids)
    schema = "topic string, {k} string, {p}_entities array<string>, {p}_tokens array<string>, {p}_urls array<string>, {p}_ids array<string>"
    seen = spark.createDataFrame([row(c, c, *o) for c, (o, _, _) in CASES.items()], schema.format(k="observation_key", p="o"))
    known = spark.createDataFrame([row(c, *x) for c, (_, xs, _) in CASES.items() for x in xs], schema.format(k="event_id", p="c"))
    got = {r.observation_key: r for r in resolve_identity(seen, known).collect()}
    for case, (_, _, (event, low, high)) in CASES.items():
        r = got[case]
        assert (r.action == "mapped") == (event is not None) and (event is None or r.event_id == event)
        assert low is None or low <= r.score <= high


def test_adjudication_cases(spark):
    rows = [
        ("tier wins", (3, "2026-04-07 08:00:00", "Reuters"), (1, "2026-04-07 10:00:00", "Local War Blog"), "Reuters"),
        ("later wins", (2, "2026-04-07 12:00:00", "Metro Times"), (2, "2026-04-07 06:00:00", "Global Ledger"), "Metro Times"),
        ("unresolved", (3, "2026-04-07 09:30:00", "Reuters"), (3, "2026-04-07 09:30:00", "Associated Press"), "unresolved"),
        ("no time", (2, None, "A"), (2, "2026-04-07 09:30:00", "B"), "unresolved"),
    ]
    side = "struct<r:int,published_at:string,source:string>"
    out = spark.createDataFrame(rows, f"id string, a {side}, b {side}, expected string").withColumn("actual", adjudicated(F.col("a"), F.col("b")))
    assert all(r.actual == r.expected for r in out.collect())


# fixed values: the golden cases of importance: label, entities, (source, domain, language), anchors, deaths of linked events, articles seen before
IMPORTANCE = {
    "mass_casualty_plateau": (
        (["Sudan", "RSF", "Khartoum"], [("Reuters", "reuters.com", "en"), ("BBC", "bbc.com", "en"), ("AP", "apnews.com", "en")], ["strike", "attack"], [5000], None),
        (["Sudan", "RSF"], [("Reuters", "reuters.com", "en")], ["attack"], [50], None),
        {}, "a",
    ),
    "new_twitter_storm_vs_ongoing_humanitarian_crisis": (
        (["South Sudan", "UN", "UNHCR", "famine", "displacement"], [("Reuters", "reuters.com", "en"), ("BBC", "bbc.com", "en"), ("Al Jazeera", "aljazeera.com", "en"), ("AFP", "afp.com", "fr")], [], [200, 150], 12),
        (["USA", "China", "tariffs"], [("Reuters", "reuters.com", "en"), ("Bloomberg", "bloomberg.com", "en")], ["sanctions"], [], None),
        {}, "a",
    ),
    "tier1_sources_vs_high_volume_low_tier": (
        (["Syria", "chemical weapons", "OPCW"], [("Reuters", "reuters.com", "en"), ("BBC", "bbc.com", "en"), ("AP", "apnews.com", "en")], ["strike", "attack"], [], None),
        (["India", "Pakistan", "border"], [(f"Blog {c}", f"blog-{c.lower()}.com", "en") for c in "ABCDEFGHIJ"], [], [], None),
        {"reuters.com": ("tier_1", "global"), "bbc.com": ("tier_1", "global"), "apnews.com": ("tier_1", "global")}, "a",
    ),
}


def test_importance_cases(spark):
    """The event that should rank higher does; the scores are those of the formula written out."""
    found, grouped, linked, registry, last = [], [], [], [], []
    for case, (a, b, known, _) in IMPORTANCE.items():
        for side, (entities, articles, anchors, deaths, seen) in (("a", a), ("b", b)):
            story = f"{case}/{side}"
            found.append((story, entities, anchors, None, 0))
            grouped += [(story, s, f"{case}/{d}", lang) for s, d, lang in articles]
            linked += [(story, f"{story}{i}", n) for i, n in enumerate(deaths)]
            last += [(story, seen, 0, 0)] if seen is not None else []
        registry += [(f"{case}/{d}", *v) for d, v in known.items()]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = materialize.importance_rows(
        # the cases' articles have no link, so their number counts as 0
        table(found, "story string, entity_focus array<string>, anchor_focus array<string>, latest timestamp, article_count int"), table(grouped, "story string, source string, source_domain string, language string"),
        table(linked, "story string, event_id string, fatalities int"), table(registry, "source_domain string, trust_tier string, region string"), table(last, "story string, last_articles int, last_sources int, last_contradictions int"), F.lit(None).cast("timestamp"),
    )
    score = {r.story: r.importance for r in got.collect()}
    for case, (*_, expected) in IMPORTANCE.items():
        a, b = score[f"{case}/a"], score[f"{case}/b"]
        assert ("a" if a > b else "b") == expected
    # 3 sources at 0.5 * 0.45, diversity 3, 3 entities, severity capped at 25, new: 9.6 + 4.05 + 3 + 4.2 + 25 + 6
    assert score["mass_casualty_plateau/a"] == 51.85
    assert score["mass_casualty_plateau/b"] == 34.06
