"""Links to the nearest related rows against all pairs: the same components, the same first-fit groups, few links."""

import datetime
import random

from pyspark.sql import functions as F

from tidewire.operators import cluster as C
from tidewire.operators import firstfit
from tidewire.operators import graph as G
from tidewire.operators import stories as O


def both(links, rows, key, order):
    comp = {r[key]: r.component for r in G.assign(rows, key, links).collect()}
    return comp, {r[key]: r.group for r in firstfit.first_fit(rows, key, order, links).collect()}


def test_structured_links(spark):
    rng = random.Random(4)
    day = datetime.date(2024, 1, 1)
    schema = "event_id bigint, country string, event_type string, event_date date, sub_event_type string, admin1 string, admin2 string, location string, actors array<string>, actor_tokens array<string>"
    for several in (False, True):
        some = lambda c, n: rng.choice([*(f"{c}{i}" for i in range(n)), "", None])
        data = []
        for i in range(150):
            who = [[f"p{rng.randrange(5)}"], []][rng.randrange(5) == 0] if not several else [f"p{x}" for x in rng.sample(range(5), rng.randrange(3))]
            data.append((i, rng.choice("AB"), "T", day + datetime.timedelta(rng.randrange(12)), some("s", 3), some("a", 3), some("b", 3), some("l", 6), who, who))
        rows = spark.createDataFrame(data, schema)
        pairs = G.bucket_pairs(rows, ["country", "event_type"], "event_date", 3.0, ["event_id", "sub_event_type", "admin1", "admin2", "location", "actors", "actor_tokens"]).filter("event_id_a <> event_id_b")
        pairs = pairs.filter(C.structured_related(C.structured_score())).select(F.col("event_id_a").alias("a"), F.col("event_id_b").alias("b"))
        rows = rows.withColumn("old", F.datediff("event_date", F.lit("2024-01-01")))
        links = C.structured_links(rows, [F.col("old")])
        assert both(links, rows, "event_id", ["old"]) == both(pairs, rows, "event_id", ["old"])
    # a block of equal events costs a link for each rule at most, not one for each pair
    many = spark.range(300).select(F.col("id").alias("event_id"), *[F.lit(x).alias(c) for c, x in (("country", "A"), ("event_type", "T"), ("event_date", day), ("sub_event_type", "s"), ("admin1", "a"), ("admin2", ""), ("location", "l"))], F.array(F.lit("p")).alias("actors"), F.array(F.lit("p")).alias("actor_tokens"))
    assert C.structured_links(many, [F.col("event_date")]).count() < 300 * len(C.structured_rules(3.0))


def test_lexical_links(spark):
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    words = ["strike", "port", "talks", "vote", "market", "aid", "border", "court"]
    schema = "id bigint, actor string, topic string, published_at timestamp, entities array<string>, keywords array<string>, anchors array<string>"
    data = [
        (i, rng.choice("XY"), "t", start + datetime.timedelta(minutes=rng.randrange(14 * 1440)), rng.choice([["e1"], ["e1", "e2"], [], ["e3"]]), sorted(rng.sample(words, rng.randrange(1, 3))), rng.choice([[], ["strike"], ["ceasefire"], ["aid"], ["vote"]]))
        for i in range(220)
    ]
    rows = spark.createDataFrame(data, schema).withColumn("newest", -F.unix_micros("published_at"))
    pairs = O.lexical_pairs(rows, ["actor", "topic"], 3.0).filter("related").select("a", "b")
    links = O.lexical_links(rows, ["actor", "topic"], 3.0)
    assert both(links, rows, "id", ["newest"]) == both(pairs, rows, "id", ["newest"])
    assert links.join(pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")), (F.greatest("a", "b") == F.col("x")) & (F.least("a", "b") == F.col("y")), "left_anti").isEmpty()
    # of alike reports each is linked with the one before alone
    alike = spark.range(300).select("id", F.lit("X").alias("actor"), F.lit("t").alias("topic"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("published_at"), F.array(F.lit("e1")).alias("entities"), F.array(F.lit("port")).alias("keywords"), F.array(F.lit("strike")).alias("anchors"))
    assert O.lexical_links(alike, ["actor", "topic"], 3.0).count() == 299
