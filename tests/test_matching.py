"""Names in texts and vector searches against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import joins as J
from tidewire.operators import matching
from tidewire.operators import vectors as V

NAMES = ["us", "u.s.", "usa", "south korea", "korea", "the united republic of lower north arm", "republic of", "arm", "a", ""]
TEXTS = ["the us and the u.s. met usa", "South Korea", "korea south korea korea", "focus on arms", "the united republic of lower north arm wrestled", "", None, "a", "éa a_a aé"]


@pytest.mark.parametrize("words", [False, True])
def test_matches(spark, words):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abus. k") for _ in range(40)) for _ in range(30)]
    rows = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "id int, t string, matches array<int>").repartition(3)
    got = {r.id: [(m.name, m.at, m.hits) for m in r.matches] for r in matching.with_matches(rows, F.col("t"), NAMES, words=words).collect()}
    names = [n for n in NAMES if n]
    for i, t in enumerate(texts):
        t = t or ""
        if words:
            pattern = r"\b(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")\b"
            spans = [(m.start(), m.group()) for m in re.finditer(pattern, t, re.ASCII)]
        else:
            spans = sorted((s, n) for n in names for s in range(len(t)) if t.startswith(n, s))
        want = {}
        for s, n in spans:
            want.setdefault(n, [n, s, 0])[2] += 1
        assert got[i] == [tuple(v) for v in want.values()], (t, words)


@pytest.mark.parametrize("bound", [1 << 20, 3])
def test_tags_of_any_length(spark, monkeypatch, bound):
    """A dictionary below and above what is broadcast; names of up to seven tokens."""
    monkeypatch.setattr(matching, "BOUND", bound)
    names = [(n, k) for n in NAMES if n for k in ("ORG", "GPE")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = {tuple(r) for r in matching.tag_names(rows, "id", F.col("t"), spark.createDataFrame(names, "name string, type string")).collect()}
    spaced = [" " + " ".join(re.findall("[a-z0-9.]+", (t or "").lower())) + " " for t in TEXTS]
    assert got == {(i, n, k) for i, t in enumerate(spaced) for n, k in names if f" {n} " in t}
    assert (4, "the united republic of lower north arm", "ORG") in got


def test_an_oversized_dictionary_is_refused(spark):
    with pytest.raises(ValueError):
        matching.with_matches(spark.range(1), F.lit("x"), ["x" * (matching.BOUND + 1)])


def test_first_and_longest_names(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    place = {"korea": 3, "us": 2, "south korea": 5, "arm": 1}
    first = {r.id: r.country for r in matching.first_in_list(rows, F.col("t"), place, "country").collect()}
    assert first == {i: min((n for n in place if n in (t or "")), key=place.get, default=None) for i, t in enumerate(TEXTS)}
    found = matching.with_matches(rows, F.col("t"), NAMES)
    longest = {r.id: r.n for r in found.select("id", matching.longest_name("matches").alias("n")).collect()}
    assert longest == {i: min((n for n in NAMES if n and n in (t or "")), key=lambda n: (-len(n), n), default=None) for i, t in enumerate(TEXTS)}


def vectors_of(spark, x):
    rows = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>, cell int").repartition(5)
    return rows, rows.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def test_index_recall_and_cost(spark, monkeypatch):
    """Clustered vectors: nine tenths of the true neighbours from a small part of the cells; one cluster holds a third of all."""
    monkeypatch.setattr(V, "BLOCK", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 16))
    which = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 25, 1500))
    rows, queries = vectors_of(spark, centres[which] + rng.normal(size=(1500, 16)) * 0.25)
    index = V.build(rows)
    probes = V.probes_for(index, queries, 8)
    exact, found = J.top_k_cosine(queries, rows, 8), V.search(index, queries, 8, probes)
    r = V.recall(exact, found).first()
    assert (r.queries, r.wanted) == (150, 1200) and r.hits >= 0.9 * r.wanted
    assert probes <= len(index.centroids) // 2
    sizes = {b.cell: 0 for b in index.blocks.collect()}
    for b in index.blocks.collect():
        assert len(b.ids) < 120
        sizes[b.cell] += len(b.ids)
    assert sum(sizes.values()) == 1500


def test_all_probes_are_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (200, 4)).astype(float)  # with ties and zero vectors
    rows, queries = vectors_of(spark, x)
    index = V.build(rows, cells=7)
    plain = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())
    assert plain(V.search(index, queries, 5, 7)) == plain(J.top_k_cosine(queries, rows, 5))


def test_index_of_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    index = V.build(none)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, query array<double>")
    assert V.search(index, queries, 3, 2).count() == 0
    some = spark.createDataFrame([(None, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in V.search(V.build(some), queries, 3, 9).collect()] == [(1, 3, 0.0)]
