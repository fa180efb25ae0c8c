"""Incremental tables and stateful trends against batch forms."""

import os
import random
from datetime import datetime, timedelta

import pytest

from tidewire.operators.merge import RULES, merge_upsert
from tidewire.streaming import streams as T
from tidewire.streaming import tables


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.startswith("part-"))


def batches(rng, n, keys):
    pick = lambda *xs: rng.choice([None, *xs])
    return [[(k, pick("", "a", "b", "{}"), pick(1, 5, 9), rng.choice([["x"], ["y", "z"], []])) for k in rng.sample(keys, 3)] for _ in range(n)]


@pytest.mark.parametrize("rule", [r for r in RULES if r != "union"])
def test_deltas_fold_like_merges_one_after_the_other(spark, tmp_path, monkeypatch, rule):
    monkeypatch.setattr(tables, "FAN", 3)
    schema = "k string, s string, n int, l array<string>"
    rules = {"s": "new" if rule in ("sum", "least", "greatest") else rule, "n": rule, "l": "union"}
    table, old = tables.DeltaTable(spark, str(tmp_path / "t"), ["k"], rules), None
    for number, rows in enumerate(batches(random.Random(7), 11, list("abcdef"))):
        new = spark.createDataFrame(rows, schema).coalesce(1)
        table.write(new, number)
        if number == 6:
            table.write(new, number)  # again, after a failure
        old = new if old is None else spark.createDataFrame(merge_upsert(old, new, ["k"], rules).drop("_action").collect(), schema)
    plain = lambda df: sorted((r.k, r.s, r.n or (0 if rule == "sum" else r.n), sorted(set(r.l))) for r in df.collect())
    assert plain(table.read()) == plain(old)
    assert any(d[0] > 0 for d in table.live()) and len(table.live()) < 11


def test_a_batch_writes_only_its_keys(spark, tmp_path, monkeypatch):
    """What a batch writes doesn't grow with the table; a failed write is no part of it."""
    monkeypatch.setattr(tables, "FAN", 1000)
    table = tables.DeltaTable(spark, str(tmp_path / "t"), ["k"], {"v": "sum"})
    table.write(spark.range(200_000).selectExpr("id AS k", "id AS v"), 0)
    big = size(tmp_path / "t")
    for n in (1, 2, 3):
        table.write(spark.range(10).selectExpr("id AS k", "1L AS v").coalesce(1), n)
    assert size(tmp_path / "t") - big < big / 50
    os.makedirs(tmp_path / "t" / "d0-4-4")  # no _SUCCESS
    assert table.read().selectExpr("sum(v)", "count(*)").first() == (200_000 * 199_999 // 2 + 30, 200_000)


def trend_by_loop(rows, step, back=24, keep=48):
    out = []
    for k, at, score in rows:
        target = at - timedelta(hours=back)
        kept = [(abs(t - target), t, s) for k2, t, s in rows if k2 == k and t < at and t >= at - timedelta(hours=keep)]
        near = min(kept, default=None)
        label = "new" if near is None or near[0] > timedelta(hours=back / 2) else "rising" if score - near[2] > step else "falling" if score - near[2] < -step else "stable"
        out.append((k, at, score, label))
    return sorted(out)


def test_trends_over_files(spark, tmp_path):
    """Several files, an earlier job's scores, and keys that are forgotten."""
    rng, start = random.Random(4), datetime(2024, 1, 5)
    rows = [(k, start + timedelta(hours=6 * i), float(rng.randrange(30))) for k in ("a", "b") for i in range(24)]
    rows += [("gone", start, 3.0), ("gone", start + timedelta(hours=6), 4.0), ("back", start, 10.0), ("back", start + timedelta(hours=120), 50.0), ("kept", start, 40.0)]
    earlier = [("kept", start - timedelta(hours=24), 1.0), ("a", start - timedelta(hours=20), 7.0)]
    schema = "k string, t timestamp, v double"
    for day in range(6):
        part = [r for r in rows if start + timedelta(days=day) <= r[1] < start + timedelta(days=day + 1)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "files"))
    stream = T.trends(T.file_stream(spark, str(tmp_path / "files"), 1), "k", "v", "t", 5.0, initial=spark.createDataFrame(earlier, schema))
    got = [(r.k, r.at, r.score, r.trend) for r in T.run_available(stream, "trend").collect()]
    want = [r for r in trend_by_loop(sorted(earlier + rows, key=lambda r: r[1]), 5.0) if (r[0], r[1]) not in {e[:2] for e in earlier}]
    assert sorted(r for r in got if r[3] != "expired") == want
    assert {r[3] for r in got} == {"new", "rising", "falling", "stable", "expired"}
    assert ("gone", start + timedelta(hours=6), 4.0, "expired") in got and ("back", start, 10.0, "expired") in got
    assert ("back", start + timedelta(hours=120), 50.0, "new") in got and ("kept", start, 40.0, "rising") in got
