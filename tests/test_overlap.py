"""Overlap joins and prediction outcomes against plain loops."""

import random
from datetime import datetime, timedelta
from math import ceil

import pytest
from pyspark.sql import functions as F

from tidewire.operators import overlap
from tidewire.plans import more


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("kind", ["half", "two"])
def test_overlaps(spark, seed, kind):
    """Two members are in most sets, one in all that have more than one."""
    rng = random.Random(seed)
    sets = {}
    for e in range(90):
        own = {f"m{rng.randrange(60)}" for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 9)))}
        sets[f"e{e}"] = own | ({"hot"} if len(own) > 1 else set()) | ({"warm"} if own and rng.random() < 0.5 else set())
    rows = [(e, m, 1) for e, s in sets.items() for m in s]
    members = spark.createDataFrame(rows + rows[:30] + [("e1", None, 1), (None, "hot", 1)], "event string, member string, n int").repartition(4)
    got = {(r.event, r.other): r.shared for r in overlap.overlapping(members, overlap.half_of if kind == "half" else overlap.at_least(2), kind == "half").collect()}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])):
                least = min(len(sets[a]), len(sets[b]))
                if (n >= 2) if kind == "two" else (least == 1 or n >= max(2, ceil(least / 2))):
                    want[a, b] = n
    assert got == want and want


def test_no_pair_on_a_common_member_alone(spark):
    """Sets that share only a frequent member are never joined: the candidate rows stay few."""
    rows = [(f"e{i}", m) for i in range(400) for m in ("everywhere", f"own{i // 2}", f"more{i}")]
    members = spark.createDataFrame(rows, "event string, member string")
    found = overlap.overlapping(members, overlap.at_least(2), False)
    assert found.count() == 200
    met = members.join(members.withColumnRenamed("event", "o"), "member").filter("event < o").count()
    assert met > 70_000  # what the plain self-join makes


def test_outcomes_of_predictions(spark):
    now, day = datetime(2024, 1, 31), timedelta(days=1)
    words = {"hit": ["port", "strike"], "weak": ["vote", "bill"], "miss": ["talks", "zzzz"], "expired": ["qqqq", "wwww"], "late": ["aaaa", "bbbb", "cccc", "talks"], "pending": ["port", "strike"], "old": ["grain", "xxxx"]}
    start = {k: now - 9 * day for k in words} | {"pending": now - timedelta(hours=2)}
    preds = spark.createDataFrame([(k, start[k], start[k] + day, w) for k, w in words.items()], "prediction_key string, created_at timestamp, horizon_at timestamp, subjects array<string>")
    found = [("hit", "s1"), ("hit", "s2"), ("weak", "s1"), ("weak", "s1")]
    matches = spark.createDataFrame(found, "prediction_key string, source string")
    articles = spark.createDataFrame([(now - day, ["talks", "other"]), (now + day, ["qqqq"]), (now - 20 * day, ["grain"])], "published_at timestamp, words array<string>")
    got = {r.prediction_key: r.status for r in more.outcomes(preds, matches, articles, F.lit(str(now)).cast("timestamp")).collect()}
    assert got == {k: k if k not in ("late", "old") else "expired" for k in words}
