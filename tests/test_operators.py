import math
import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tidewire.functions import scalars as S
from tidewire.functions import texts as X
from tidewire.operators import aggregates as A
from tidewire.operators import cluster as C
from tidewire.operators import graph as G
from tidewire.operators import joins as J
from tidewire.operators import merge as M


def test_merge_twice_equals_once(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "", 7), (3, "c", 1)], "k int, s string, n int")
    rules = {"s": "new_unless_empty", "n": "old_or_new"}
    once = M.merge_upsert(old, new, ["k"], rules)
    assert sorted(map(tuple, once.collect())) == [(1, "a", 5, "kept"), (2, "b", 7, "updated"), (3, "c", 1, "inserted")]
    twice = M.merge_upsert(once.drop("_action"), new, ["k"], rules).drop("_action")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.drop("_action").collect()))


def test_merge_of_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, s string")
    assert M.merge_upsert(empty, empty, ["k"]).count() == 0


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_nearest_join_is_brute_force_at_poles_and_date_line(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)

    def side(n, base):
        out = []
        for i in range(n):
            lat, lon = rng.choice([(rng.uniform(89, 90), rng.uniform(-180, 180)), (rng.uniform(-1, 1), rng.choice([179.9, -179.9]) + rng.uniform(-0.1, 0.1)), (rng.uniform(50, 51), rng.uniform(10, 11))])
            out.append((base + i, start + timedelta(hours=rng.uniform(0, 60)), rng.choice(["x", None]), lat, lon))
        return out

    left, right = side(120, 1000), side(120, 0)
    schema = "id bigint, ts timestamp, country string, latitude double, longitude double"
    got = {r.id: r.superseded_by for r in J.nearest_within(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    want = {}
    for b in left:
        near = [(km(b[3], b[4], a[3], a[4]), a[0]) for a in right if abs((a[1] - b[1]).total_seconds()) <= 86400 and (a[2] is None or b[2] is None or a[2] == b[2])]
        near = [x for x in near if x[0] <= 50]
        if near:
            want[b[0]] = min(near)[1]
    assert got == want


def union_find(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    ids = {x for p in links for x in p}
    got = {r.id: r.component for r in G.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == union_find(ids, links)


def test_greedy_dedupe_is_the_plain_loop(spark):
    rng = random.Random(2)
    ranks = {f"e{i}": rng.randrange(10) for i in range(80)}
    links = [(f"e{rng.randrange(80)}", f"e{rng.randrange(80)}") for _ in range(120)]
    links = [(a, b) for a, b in links if a != b]
    rows = spark.createDataFrame(list(ranks.items()), "event string, rank int")
    got = {r.event for r in C.greedy_dedupe(rows, "event", "rank", spark.createDataFrame(links, "a string, b string")).collect()}
    near = {e: set() for e in ranks}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    kept = set()
    for e in sorted(ranks, key=lambda e: (ranks[e], e), reverse=True):
        if not near[e] & kept:
            kept.add(e)
    assert got == kept


def test_structured_clusters(spark):
    day = datetime(2024, 1, 1).date()
    rows = [(i, "x", "Battles", day + timedelta(days=d), "s", "a", "", loc, [act], [act]) for i, (d, loc, act) in enumerate([(0, "p", "m"), (2, "p", "n"), (4, "p", "m"), (9, "p", "m"), (0, "q", "z")])]
    df = spark.createDataFrame(rows, "event_id bigint, country string, event_type string, event_date date, sub_event_type string, admin1 string, admin2 string, location string, actors array<string>, actor_tokens array<string>")
    got = {r.event_id: r.component for r in C.structured_clusters(df).collect()}
    assert got[0] == got[1] == got[2] and got[3] == 3


def test_first_fit_keeps_order():
    assert C.first_fit(pd.DataFrame({"i": range(4)}), {0: {2}, 2: {0, 3}, 3: {2}}) == [0, 1, 0, 0]


def test_identity_rules(spark):
    o = spark.createDataFrame([("t", "o1", ["u1"], ["s"], ["a", "b"], ["fire"]), ("t", "o2", ["u9"], [], ["p", "q", "r", "s"], ["port", "strike", "day"]), ("t", "o3", ["u8"], [], ["zz"], ["none"])], "topic string, observation_key string, o_urls array<string>, o_ids array<string>, o_entities array<string>, o_tokens array<string>")
    c = spark.createDataFrame([("t", "e1", ["u1"], [], ["x"], ["y"]), ("t", "e2", ["u7"], [], ["p", "q", "r", "s"], ["port", "strike"])], "topic string, event_id string, c_urls array<string>, c_ids array<string>, c_entities array<string>, c_tokens array<string>")
    got = {r.observation_key: (r.event_id, r.action, r.score) for r in C.resolve_identity(o, c).collect()}
    assert got["o1"] == ("e1", "mapped", 0.93) and got["o2"][:2] == ("e2", "mapped") and got["o2"][2] >= 0.74
    assert got["o3"][1] == "created" and got["o3"][0].startswith("evt-")


def test_soft_identity_tops_out_below_the_threshold():
    assert 0.4 + 0.2 < C.IDENTITY_FROM


def test_text_rules(spark):
    row = spark.range(1).select(
        X.number(F.lit("about 1,250 people")).alias("n"), X.number(F.lit("dozens hurt")).alias("w"), X.date(F.lit("on 3 March 2024")).alias("d"), X.date(F.lit("April 31, 2024")).alias("bad"),
        X.claim_type(F.lit("Talks with the envoy")).alias("t"), X.dominant(X.frame_counts(X.matched_terms(F.lit("rebels and insurgents fight the government")))).alias("f"),
        S.country(F.lit("The UAE (Gulf)")).alias("c"), S.timestamp(F.lit("20240102T030405Z")).alias("ts"), S.trimmed(F.lit("One sentence here. And another one"), 22).alias("cut"), S.canonical_url(F.lit("HTTPS://A.b/C/?q#f")).alias("u"),
    ).first()
    assert (row.n, row.w, str(row.d), row.bad, row.t, row.f) == (1250.0, 24.0, "2024-03-03", None, "diplomacy", "rebellion")
    assert row.c == "united arab emirates" and row.ts == datetime(2024, 1, 2, 3, 4, 5) and row.cut == "One sentence here.\u2026" and row.u == "https://a.b/C"


def test_summaries_are_cut_as_described(spark):
    """A plain form of the rule: a sentence mark in the last 40 characters (not before the 120th), else the last space."""

    def cut(text, limit):
        if len(text) <= limit:
            return text
        for mark in (". ", "! ", "? ", "; "):
            at = text.rfind(mark, 0, limit + 1)
            if at >= max(120, limit - 40):
                return text[: at + 1].strip()
        at = text.rfind(" ", 0, limit - 1)
        return text[: at if at > 0 else limit - 1].rstrip(" ,;:") + "\u2026"

    rng = random.Random(2)
    texts = ["".join(rng.choice(["word", "a", ". ", "! ", "; ", ", ", " ", "long" * 9]) for _ in range(rng.randrange(5, 90))) for _ in range(300)] + ["x" * 300, "x" * 200, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.trimmed("t", 200).alias("cut")).collect()
    assert all(r.cut == cut(texts[r.i], 200) for r in rows)


def test_importance_grows_with_deaths_and_is_capped(spark):
    z = F.lit(0.0)
    r = spark.range(1).select(*[X.importance(F.lit(f), z, z, z, z).alias(f"f{f}") for f in (0, 50, 5000, 10**9)]).first()
    assert r.f0 == 0 and r.f0 < r.f50 < r.f5000 <= 25 and r.f1000000000 == 25


def test_same_result_at_any_partitioning(spark):
    rows = spark.createDataFrame([(f"E{i % 7}", "GPE", datetime(2024, 1, 28) + timedelta(minutes=i)) for i in range(300)], "entity string, entity_type string, mentioned_at timestamp")
    a = A.entity_spikes(rows, "2024-01-30 00:00:00").collect()
    b = A.entity_spikes(rows.repartition(50), "2024-01-30 00:00:00").collect()
    assert a == b


def test_a_stopped_stream_goes_on_from_its_folder(spark, tmp_path):
    from tidewire.streaming import streams as T

    files, state, seen = str(tmp_path / "files"), str(tmp_path / "job"), []

    def step(batch):
        seen.append(batch.count())
        return batch.groupBy("k").agg(F.sum("v").alias("v"))

    def run():
        rows = T.upsert_stream(T.file_stream(spark, files), "job", step, ["k"], {"v": "sum"}, folder=state)
        return {r.k: r.v for r in rows.collect()}

    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long").coalesce(1).write.parquet(files)
    assert run() == {"a": 1, "b": 2}
    spark.createDataFrame([("a", 10), ("c", 3)], "k string, v long").coalesce(1).write.mode("append").parquet(files)
    assert run() == {"a": 11, "b": 2, "c": 3} and seen == [2, 2]
    assert run() == {"a": 11, "b": 2, "c": 3} and seen == [2, 2]


def test_top_k_meets_all_vectors(spark):
    import numpy as np

    from tidewire.operators.joins import top_k_cosine

    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    m[7] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)], "vec_id long, embedding array<float>, label int")
    unit = m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-300)
    for same in (None, "label"):
        asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
        got = {(r.query_id, r.rank): r.vec_id for r in top_k_cosine(asked, rows, 5, same, block=16).collect()}
        for q in range(0, 300, 50):
            order = sorted((i for i in range(300) if i != q and (same is None or i % 3 == q % 3)), key=lambda i: (-float(unit[i] @ unit[q]), i))
            assert [got[q, r] for r in range(1, 6)] == order[:5]


def test_zones_are_single_linkage(spark):
    from tidewire.operators.stories import zones

    points = [("a", 89.5, 0.0), ("b", 89.5, 180.0), ("c", 0.0, 179.5), ("d", 0.0, -179.0), ("e", 0.0, -176.5), ("f", 40.0, 10.0)]
    got = {r.id: r.zone for r in zones(spark.createDataFrame(points, "id string, lat double, lon double")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f"}


def test_merge_roots_over_gaps_and_repeats(spark):
    import duckdb

    from tidewire.plans import clusters

    ids = [1, 2, 2, 3, 5, 9, 10, 11, 11, None, 40]
    customer = spark.createDataFrame([(i,) for i in ids], "c_custkey bigint")
    got = {(r.id, r.root) for r in clusters.c18(customer).collect()}
    assert got == {(2, 1), (3, 1), (10, 9), (11, 9)}
    con = duckdb.connect()
    con.execute("CREATE TABLE customer (c_custkey BIGINT)")
    con.executemany("INSERT INTO customer VALUES (?)", [[i] for i in ids])
    from tidewire.plans import registry

    assert set(con.execute(registry.oracle_sql()["C18_merge_roots"]).fetchall()) == got
    assert clusters.c18(customer.limit(0)).count() == 0
