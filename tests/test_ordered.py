"""Parallel greedy groups, ordered passes and ordered identity against plain loops."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import firstfit, ordered, stories


def greedy(ids, related):
    groups = []
    for i in ids:
        at = next((g for g in groups if any(j in related[i] for j in g)), None)
        if at is None:
            groups.append([i])
        else:
            at.append(i)
    return {i: g[0] for g in groups for i in g}


@pytest.mark.parametrize("seed, n, m, parts", [(1, 30, 25, 1), (2, 60, 90, 200), (3, 80, 60, 4), (4, 40, 39, 4)])
def test_first_fit_is_the_greedy_pass(spark, seed, n, m, parts):
    rng = random.Random(seed)
    order = {i: rng.randrange(n // 2) for i in range(n)}  # with ties
    links = {(i, i + 1) for i in range(n - 1)} if seed == 4 else {tuple(rng.sample(range(n), 2)) for _ in range(m)}
    related = defaultdict(set)
    for a, b in links:
        related[a].add(b)
        related[b].add(a)
    want = greedy(sorted(range(n), key=lambda i: (order[i], i)), related)
    rows = spark.createDataFrame([(i, order[i], "x") for i in range(n)], "id int, day int, first string")
    pairs = spark.createDataFrame([*links, (3, 3), *list(links)[:5]], "a int, b int").repartition(parts)
    got = {r.id: r.group for r in firstfit.first_fit(rows, "id", ["day"], pairs).collect()}
    assert got == want
    assert len(set(want.values())) > 1


def test_first_fit_differs_from_components(spark):
    """A row that bridges two groups joins the first and leaves the other alone."""
    rows = spark.createDataFrame([(i,) for i in range(4)], "id int")
    links = spark.createDataFrame([(0, 2), (1, 2), (1, 3)], "a int, b int")
    assert {r.id: r.group for r in firstfit.first_fit(rows, "id", [], links).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    none = firstfit.first_fit(rows, "id", [], links.limit(0)).collect()
    assert all(r.id == r.group for r in none) and len(none) == 4


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_sessions_over_pieces(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), None if rng.random() < 0.03 else datetime(2024, 1, 1) + timedelta(hours=rng.randrange(900))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, place string, t timestamp").repartition(5)
    want = {r.id: r.seed for r in stories.sessions(df, ["place"], "t", "id", 0.2).collect()}
    got = {r.id: r.seed for r in ordered.sessions(df, ["place"], "t", "id", 0.2, parts).collect()}
    assert got == want and len(set(want.values())) > 20


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_last_before(spark, parts):
    rng = random.Random(parts)
    members = [(rng.choice("kkkl"), rng.randrange(200), i, i) for i in range(150)]
    asks = [(rng.choice("kklm"), rng.randrange(200), i, f"q{i}") for i in range(150)]
    m = spark.createDataFrame(members, "k string, t int, i int, v int").repartition(4)
    a = spark.createDataFrame(asks, "k string, t int, i int, name string").repartition(4)
    got = {r.name: r.v for r in ordered.last_before(m, a, "k", ["t", "i"], "v", parts).collect()}
    for k, t, i, name in asks:
        before = [x for x in members if x[0] == k and x[1:3] < (t, i)]
        assert got[name] == (max(before, key=lambda x: x[1:3])[3] if before else None)


def score_of(o, c):
    """(score, shared entities, shares a link or id) of two rows (urls, ids, entities, tokens)."""
    cut = lambda k: set(o[k]) & set(c[k])
    part = lambda k: len(cut(k)) / len(set(o[k]) | set(c[k])) if o[k] and c[k] else 0.0
    n, label = len(cut(2)), part(3)
    if cut(0):
        return 0.93, n, True
    if cut(1):
        return 0.9, n, True
    boost = 0.74 if n >= 4 and label >= 0.2 else 0.68 if n >= 3 and label >= 0.28 else 0.64 if n >= 2 and label >= 0.4 else 0.0
    return round(max(0.4 * part(2) + 0.2 * label, boost), 4), n, False


def resolve_one_by_one(observations, stored, new_id):
    listed = [(event, fields) for event, fields in stored]
    out, merges = {}, set()
    for key, fields in observations:
        scored = [(*score_of(fields, f), event) for event, f in listed]
        order = sorted(range(len(scored)), key=lambda i: (-scored[i][0], i))
        best = scored[order[0]] if order and scored[order[0]][0] >= 0.54 else None
        second = scored[order[1]][0] if best and len(order) > 1 and scored[order[1]][0] >= 0.54 else None
        if best and best[0] >= 0.62:
            ambiguous = second is not None and second >= 0.62 and best[0] - second < 0.07
            weak = best[0] < 0.7 and best[1] <= 2 and not best[2]
            event = best[3]
            out[key] = (event, "mapped_existing", best[0], round(best[0] - (0.08 if ambiguous else 0), 4), ambiguous, "weak_existing_match" if weak else None, event if weak else None)
            for e in {s[3] for s in scored if s[0] >= 0.62 and s[3] != event}:
                merges.add((key, event, e, max(s[0] for s in scored if s[3] == e)))
        else:
            event = new_id(key)
            out[key] = (event, "created_new", best and best[0], None, False, "new_event_near_existing_threshold" if best else None, best and best[3])
        listed.insert(0, (event, fields))
    return out, merges


@pytest.mark.parametrize("seed, links", [(1, 40), (2, 300), (3, 4)])
def test_identity_in_order(spark, seed, links):
    """Decisions and merge candidates against the loop; with 4 links most rows share one."""
    import hashlib

    from tidewire.operators.identity import listed_links, resolve_in_order

    rng = random.Random(seed)
    some = lambda pool, least, most: sorted({rng.choice(pool) for _ in range(rng.randint(least, most))})
    urls, ids, ents, words = ([f"{p}{i}" for i in range(n)] for p, n in (("u", links), ("s", 5 * links), ("e", 9), ("w", 7)))
    draw = lambda: (some(urls, 0, 1) if links < 10 or rng.random() < 0.4 else [], some(ids, 0, 1) if rng.random() < 0.3 else [], some(ents, 0, 5), some(words, 0, 5))
    rows = {t: [(f"{t}{i}", draw()) for i in range(70)] for t in ("a", "b")}
    rows["a"] += [(f"again{i}", rows["a"][i][1]) for i in range(20)]  # equal signatures
    stored = {t: [(f"evt-{t}{i}", draw()) for i in range(8)] for t in ("a", "b")}
    table = lambda data, name: spark.createDataFrame([(t, k, float(i * 3), *f) for t, xs in data.items() for i, (k, f) in enumerate(xs)], f"topic string, {name} string, position double, urls array<string>, ids array<string>, entities array<string>, tokens array<string>").repartition(4)
    seen, known = table(rows, "observation_key"), table(stored, "event_id")
    decided, merged = resolve_in_order(seen, known, listed_links(seen, "observation_key"), listed_links(known, "event_id"))
    got = {r.observation_key: (r.event_id, r.action, r.score, r.confidence, r.ambiguous, r.split_reason, r.split_event_id) for r in decided.collect()}
    want, merges = {}, set()
    for t in rows:
        w, m = resolve_one_by_one(rows[t], stored[t], lambda k: "evt-" + hashlib.sha256(k.encode()).hexdigest()[:16])
        want |= w
        merges |= m
    assert got == want
    assert {(r.observation_key, r.event_id, r.candidate_event_id, r.score) for r in merged.collect()} == merges
    assert {v[1] for v in want.values()} == {"mapped_existing", "created_new"} and merges
    assert links < 10 or {v[5] for v in want.values()} == {None, "weak_existing_match", "new_event_near_existing_threshold"}


def test_identity_without_rows(spark):
    from tidewire.operators.identity import listed_links, resolve_in_order

    schema = "topic string, {} string, position double, urls array<string>, ids array<string>, entities array<string>, tokens array<string>"
    none, lone = spark.createDataFrame([], schema.format("event_id")), spark.createDataFrame([("t", "k", 0.0, None, ["s"], None, ["w"])], schema.format("observation_key"))
    links = listed_links(lone, "observation_key"), listed_links(none, "event_id")
    decided, merged = resolve_in_order(lone, none, *links)
    assert [(r.observation_key, r.action, r.score) for r in decided.collect()] == [("k", "created_new", None)] and merged.count() == 0
    assert resolve_in_order(lone.limit(0), none, *links)[0].count() == 0
