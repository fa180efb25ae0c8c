"""Prefix trie, pivot search and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from tidewire.llm import periodic_runs, pivot_search, prefix_trie
from tidewire.llm.queries import ORACLE_SQL, QUERIES, crc, repeated_tails

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_pivot_search"])
def test_query_agrees_with_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), connect(sf).execute(ORACLE_SQL[name]).df())


# --- prefix trie


def trie_by_force(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = {}
    for k, m in members.items():
        under = [x for x in members if x[: len(k)] == k]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in under)
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in under if x)
        rows[(min(m), len(k))] = (min(members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in under), leaves, saved)
    return rows


def conversations(rng, n, depth):
    said = [("user", "a b"), ("user", "a  b"), ("assistant", "one\ttwo three"), ("", ""), ("user", "é ö"), ("user a", " b")]
    return {c: [rng.choice(said[: rng.choice((1, 2, 6))]) for _ in range(rng.randrange(depth))] for c in range(-5, n)}


@pytest.mark.parametrize("seed, n, depth, parts", [(1, 40, 6, 1), (2, 90, 8, 7), (3, 3, 14, 5), (4, 120, 3, 60)])
def test_trie(spark, monkeypatch, seed, n, depth, parts):
    monkeypatch.setattr(prefix_trie, "partitions", lambda _: parts)  # many tasks share prefixes
    convs = conversations(random.Random(seed), n, depth)
    rows = [(c, None if d == 0 else d, r or None, t or None, "x") for c, turns in convs.items() for d, (r, t) in enumerate(turns)] + [(None, 1, "user", "lost", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node string").repartition(3)
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id bigint")
    paths = prefix_trie.paths(prefix_trie.digested(turns), ids)
    nodes = prefix_trie.trie(paths)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in nodes.collect()}
    assert got == trie_by_force(convs)
    ended = defaultdict(list)
    for c in sorted(convs):
        ended[tuple(convs[c])].append(str(c))
    digests = prefix_trie.digest_ids(prefix_trie.members(paths)).join(nodes, "node").select("conv_id", "depth", "ids_sha256")
    names = {(min(map(int, v)), len(k)): v for k, v in ended.items()}
    found = {(r.conv_id, r.depth): r.ids_sha256 for r in digests.collect()}
    assert sorted(found.values()) == sorted(hashlib.sha256(",".join(v).encode()).hexdigest() for v in names.values())


def test_trie_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    paths = prefix_trie.paths(prefix_trie.digested(none))
    assert prefix_trie.trie(paths).count() == 0
    assert prefix_trie.digest_ids(prefix_trie.members(paths)).count() == 0


def test_ids_are_digested_in_order_over_chunks(spark):
    ids = [-9000, -4096, -1, 0, 3, 4095, 4096, 10**12]
    rows = spark.createDataFrame([(i, bytearray(b"n")) for i in reversed(ids)], "conv_id bigint, node binary").repartition(4)
    assert prefix_trie.digest_ids(rows).first().ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_rebuilt_conversations(spark, tmp_path):
    """The query against a plain loop, with ties, repeated rows, nulls and conversations left without turns."""
    rng = random.Random(8)
    rows = [(c, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a b", "c"])) for c in [*range(-25, 70), *range(200, 240)] for _ in range(rng.randrange(1, 6)) if c % 20 != 0 or rng.random() < 0.6]
    rows += rows[:40]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + turns[h:]
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in QUERIES["op11_prefix_trie"](spark, str(tmp_path)).collect()}
    assert got == trie_by_force(built)


# --- pivot search


def search_by_force(rows, asks, k):
    vectors = [(i, tuple(int(np.clip(np.floor(64 * float(np.float64(x))), -(2.0**62), 2.0**62)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    vectors = sorted(set(vectors))
    out = []
    for q, v in vectors:
        if asks(q):
            found = {(-max(min(sum(a * b for a, b in zip(v, w)), (1 << 63) - 1), -(1 << 63) + 1), i) for i, w in vectors if i != q}
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies", "odd"])
def test_search(spark, monkeypatch, kind):
    monkeypatch.setattr(pivot_search, "BLOCK", 16)
    monkeypatch.setattr(pivot_search, "BATCH", 5)
    rng = np.random.default_rng(len(kind))
    n, d = 300, 6
    x = rng.normal(size=(n, d)) * (rng.choice([0.1, 1, 30], size=(n, 1)) if kind == "spread" else 1)
    if kind == "clusters":
        x = rng.normal(size=(5, d))[rng.integers(0, 5, n)] + rng.normal(size=(n, d)) * 0.02
    if kind == "copies":
        x[rng.random(n) < 0.5] = 1.0
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    if kind == "odd":
        rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (305, [2.0]), (306, [0.5] * 9), (7, rows[7][1]), (7, [3.0] * 6), (None, [1.0] * 6), (320, [1e30] * 6), (340, [-1e30] * 6)]
    vectors = spark.createDataFrame([(i, v, 1, "p") for i, v in rows], "vec_id bigint, embedding array<double>, label int, pivot string").repartition(6)
    got = pivot_search.top_k(pivot_search.quantised(vectors, "embedding", F.col("vec_id") % 20 == 0), 7)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == search_by_force(rows, lambda i: i % 20 == 0, 7)


def test_search_of_few_rows(spark):
    rows = lambda v: pivot_search.quantised(spark.createDataFrame(v, "vec_id bigint, embedding array<double>"), "embedding", F.col("vec_id") % 20 == 0)
    assert pivot_search.top_k(rows([]), 20).count() == 0
    assert pivot_search.top_k(rows([(20, [1.0])]), 20).count() == 0
    assert pivot_search.top_k(rows([(1, [1.0])]), 20).count() == 0
    assert [tuple(r) for r in pivot_search.top_k(rows([(20, [1.0]), (3, [0.5])]), 20).collect()] == [(20, 1, 3, 64 * 32)]


def test_bounds_hold():
    """No inner product passes the bound of its annulus, and far annuli have bounds below near ones."""
    rng = np.random.default_rng(4)
    x, q = rng.integers(-90, 90, (400, 8)), rng.integers(-90, 90, (30, 8))
    pivots = pivot_search.fit_pivots(x[:100], 6)
    d = pivot_search.distances(x, pivots)
    near = d.argmin(axis=1)
    annuli = []
    for p in range(len(pivots)):
        for ring, own in enumerate(np.array_split(np.flatnonzero(near == p)[np.argsort(d[near == p, p])], 3)):
            if len(own):
                annuli.append((p, ring, 1, d[own, p].min(), d[own, p].max(), np.sqrt((x[own] ** 2).sum(axis=1)).max(), own))
    high = pivot_search.Bounds(pivots, annuli).highest(q)
    s = q @ x.T
    for a, row in enumerate(annuli):
        assert (s[:, row[-1]] <= high[:, [a]]).all()
    assert (high < s.max(axis=1)[:, None]).any()


# --- periodic runs


def runs_by_force(w):
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


def odd_texts(rng):
    out = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x y x y " * 4, "a " * 500, "a b " * 300 + "a", "a a b " * 90 + "b a a b " * 40]
    for _ in range(120):
        k = rng.choice((1, 2, 2, 3, 5))
        parts = []
        for _ in range(rng.randrange(1, 7)):
            unit = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randrange(1, 9))]
            parts += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
        out.append(rng.choice([" ", "\n", " \t"]).join(parts))
    flip = "ab"
    for _ in range(7):  # Thue-Morse: squares, no cubes
        flip += "".join("b" if c == "a" else "a" for c in flip)
    fib, last = "ab", "a"
    for _ in range(9):
        fib, last = fib + last, fib
    out += [" ".join(flip), " ".join(fib), " ".join(fib * 4)]
    common = [rng.choice("abcdefghijkl") for _ in range(2500)]
    common[700:1500] = (common[700:711] * 80)[:800]
    return [*out, " ".join(common)]


def test_runs(spark):
    texts = list(enumerate(odd_texts(random.Random(5))))
    docs = spark.createDataFrame([(i, t, "en", [1]) for i, t in texts] + [(None, "q q q q q q q", "en", [1]), (3, "b b b b b b", "en", [1])], "doc_id bigint, text string, lang string, runs array<int>").repartition(4)
    rows = periodic_runs.periodic_runs(docs).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r for r in rows if r.doc_id not in (3,)}
    for i, t in [*texts, (None, "q q q q q q q")]:
        if i == 3:
            continue
        w = WORD.findall(t or "")
        runs = runs_by_force(w)
        assert [tuple(r) for r in got[i].runs] == runs, (i, t)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert (got[i].n_words, got[i].collapsed) == (len(w), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_grammar_spells_the_words():
    rng = np.random.default_rng(2)
    ids = np.r_[np.tile(rng.integers(0, 9, 13), 30), rng.integers(0, 4, 400)]
    g = periodic_runs.Grammar(ids, np.zeros(len(ids), int))
    spell = lambda s: [s] if s < g.first else spell(g.left[s - g.first]) + spell(g.right[s - g.first])
    assert spell(int(g.symbol[0])) == ids.tolist() and len(g.symbol) == 1
    assert len(g.left) < len(ids) // 2  # pairs that repeat share a symbol
    for symbols, places in g.made:
        for s, at in zip(symbols.tolist(), places.tolist()):
            said = spell(s)
            assert ids[at : at + len(said)].tolist() == said


def test_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(periodic_runs.Words, "hash", property(lambda self: np.zeros(len(self), np.uint64)))
    raw = np.frombuffer(b"ab cd ab e", np.uint8)
    words = periodic_runs.Words(raw, np.array([0, len(raw)]))
    assert periodic_runs.word_ids(words).tolist() == [0, 1, 0, 2]


def test_query_of_runs(spark, tmp_path):
    """The query with its repeated tails against a plain loop over whole documents."""
    rng = random.Random(6)
    texts = [None, "", "  "] + [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(3)) for _ in range(rng.randrange(1, 200))) for _ in range(150)]
    rows = [(i * 7 - 20, t) for i, t in enumerate(texts)] + [(None, "z z z z z z z")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    repeated = 0
    for i, t in rows:
        w = WORD.findall(t or "")
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + k % p] for k in range(n - a)]
            repeated += 1
        runs = runs_by_force(w)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4))
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert repeated > 5
    assert crc and repeated_tails
