"""Each operator against brute force on small tables with odd rows."""

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.llm import chat_format, decontaminate, exact_dedup, html_extract, jaccard_join, masked_lm, quality, sentencepiece_fst, substring_dedup, suffix_dedup, words
from tidewire.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, score string, fp string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "the", "OF"]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    out = ["", None, " \n\t ", "one", "two words", "a\x00b c", passage, passage.replace(" ", "\n"), passage]
    for _ in range(60):
        own = [rng.choice(vocab) + str(rng.randrange(900)) for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.5:
            cut = rng.randrange(0, 40)
            own[rng.randrange(len(own)) : 0] = passage.split(" ")[cut : cut + rng.randrange(5, 40)]
        out.append(rng.choice([" ", "\n", "  "]).join(own))
    base = [f"b{i}" for i in range(120)]
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(120)] = f"x{rng.randrange(99)}"
        out.append(" ".join(near))
    out += ["Shti " * 60, "Shti " * 61, "ab" * 80, "x " * 3000 + passage]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "z", "q") for i, t in texts], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, texts, none):
    got = {r.doc_id: r for r in substring_dedup.repeated_windows(docs).collect()}
    first: dict = {}
    for d, t in texts:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), d) < d:
                gone[p : p + 13] = [True] * 13
        kept = " ".join(x for x, m in zip(w, gone) if not m)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.repeated_windows(none).count() == 0


def test_suffix_dedup(docs, texts, none):
    got = {r.doc_id: r for r in suffix_dedup.repeated_bytes(docs).collect()}
    first: dict = {}
    for d, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], d) < d:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(b, gone) if not m)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.repeated_bytes(none).count() == 0


@pytest.mark.parametrize("operator", [substring_dedup.repeated_windows, suffix_dedup.repeated_bytes])
def test_dedup_of_null_and_repeated_ids(spark, operator, monkeypatch):
    from tidewire.llm import exchange

    monkeypatch.setattr(exchange, "BUCKET_BYTES", 100)
    line = " ".join(f"word{i}" for i in range(40))
    rows = [(None, line, 1), (4, line, 2), (4, line, 3), (9, "x " + line, 4), (5, None, 5), (6, "", 6), (7, "own words " * 3, 7)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed > 0) for r in operator(spark.createDataFrame(rows, "doc_id bigint, text string, bucket int")).collect()))
    assert got == [(False, 4, True), (False, 4, True), (False, 5, False), (False, 6, False), (False, 7, False), (False, 9, True), (True, 0, False)]


def test_dedup_of_a_hot_passage_sends_one_suffix_a_slice(spark):
    rec = np.zeros(5, suffix_dedup._record(50))
    rec["owner"], rec["rs"], rec["right"][:, 0] = [3, 1, 2, 1, 9], 50, [7, 7, 7, 7, 8]
    sent, known = suffix_dedup._combined(rec)
    assert sent.tolist() == [False, True, False, True, True] and known.tolist() == [True, False, True, False, False]


def test_interval_tree_holds_all_occurrences():
    lcp = np.array([0, 3, 3, 1, 5, 0])
    assert sorted(suffix_dedup.intervals(lcp)) == [(1, 0, 4, 0), (3, 0, 2, 1), (5, 3, 4, 1)]


def test_jaccard_join(docs, texts, none):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in texts:
        w = WORD.findall((t or "").translate(low))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(docs).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}
    kept = {r.doc_id for r in jaccard_join.keep_one_of_each(docs).collect()}
    assert kept == {d for d in sets if root(d) == d}
    assert jaccard_join.join_components(none).count() == 0


def test_jaccard_join_by_the_last_step_alone(docs, texts, none, monkeypatch):
    """Without rounds of leaders, and with fewer carried keys than sets share."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "FIRST", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    test_jaccard_join(docs, texts, none)


def test_long_texts_in_the_last_step(spark, monkeypatch):
    """Two groups of texts of 10^5 words that no leader round settles; a row of the last step stays small."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(100_000)]
        for k in range(3):
            near = list(base)
            near[k * 5000 : k * 5000 + 400] = [f"d{g}{k}x{i}" for i in range(400)]
            rows.append((g * 10 + k, " ".join(near)))
        rows.append((g * 10 + 5, " ".join(base[:60_000] + [f"o{g}w{i}" for i in range(40_000)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in jaccard_join.join_components(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 5: 5, 10: 10, 11: 10, 12: 10, 15: 15}


def test_jaccard_join_of_null_and_repeated_ids(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(None, line, 1), (4, line, 1), (4, line, 2), (9, line.upper(), 3), (5, None, 4), (6, "", 5), (7, "a b", 6)], "doc_id bigint, text string, component int")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.join_components(rows).collect()))
    assert got == [(0, 26, 0), (4, 26, 4), (4, 26, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (9, 26, 4)]
    assert sorted(r.doc_id or 0 for r in jaccard_join.keep_one_of_each(rows).collect()) == [0, 4, 4, 5, 6, 7]


def test_jaccard_join_of_a_large_group_uses_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(9)
    rows = []
    for i in range(60):
        w = [f"a{k}" for k in range(50)] + [f"u{i}-{k}" for k in range(rng.randrange(0, 12))]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    up = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = a, b
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    assert got == {i: root(i) for i in sets}


def test_exact_dedup(docs, texts, none):
    groups = defaultdict(list)
    for d, t in texts:
        groups["".join(WORD.findall(t or ""))].append((-len(t or ""), d))
    got = {r.doc_id: r for r in exact_dedup.assign_groups(docs).collect()}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, d in members:
            assert (got[d].keep_id, got[d].group_size, got[d].kept, got[d].text_sha256) == (keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup.deduplicate(docs).columns == docs.columns and exact_dedup.deduplicate(docs).count() == len(groups)
    assert exact_dedup.assign_groups(none).count() == 0


def test_exact_dedup_of_repeated_rows(spark):
    rows = spark.createDataFrame([(5, "a b"), (5, "a b"), (3, "ab"), (None, "q")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.assign_groups(rows).filter("doc_id > 0").collect())
    assert got == [(3, 5, 3), (5, 5, 3), (5, 5, 3)]
    assert exact_dedup.deduplicate(rows).count() == 2


def test_collisions_are_split(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_hash", lambda norm: F.unhex(F.md5(F.substring(norm, 1, 1))))
    rows = spark.createDataFrame([(1, "ab"), (2, "a b"), (3, "ac"), (None, "a c"), (5, "b"), (6, "a")], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign_groups(rows).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 2, True), None: (3, 2, False), 5: (5, 1, True), 6: (6, 1, True)}


def test_exact_dedup_of_null_ids(spark):
    rows = spark.createDataFrame([(None, "q"), (None, " q"), (None, "a b"), (7, "ab"), (4, "ab"), (8, None), (9, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id is None, r.group_size) for r in exact_dedup.assign_groups(rows).collect())
    assert got == [(False, 4, False, 3), (False, 7, False, 3), (False, 8, False, 2), (False, 9, False, 2), (True, 0, False, 3), (True, 0, True, 2), (True, 0, True, 2)]
    kept = exact_dedup.deduplicate(rows).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 4, 8] and len(kept) == 3


def test_heavy_keys_with_large_payloads_are_salted(spark, monkeypatch):
    from tidewire.llm import skew

    monkeypatch.setattr(skew, "BROADCAST_BYTES", 10)
    rows = spark.range(3000).select((F.col("id") % 2 * F.col("id") % 900).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max(F.repeat(F.lit("x"), 50)).alias("pay"))
    assert skew.join_on_key(rows, groups, "k", weight="n").count() == 3000
    assert skew.join_on_key(rows, groups.filter("k < 100"), "k", weight="n", how="left").count() == 3000


def test_masks_meet_every_two_substitutions():
    for gone in itertools.combinations(range(decontaminate.WINDOW), decontaminate.ALLOWED):
        assert any(all(o + p not in gone for p in m) for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - max(m)))


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"q{rng.randrange(3000)}" for _ in range(rng.randrange(3, 40)))) for i in range(25)] + [(90, None), (91, "")]
    rows = []
    for i in range(80):
        w = [f"q{rng.randrange(3000)}" for _ in range(rng.randrange(0, 60))]
        t = items[rng.randrange(25)][1].split()
        cut = t[rng.randrange(len(t)) :][: rng.randrange(1, 40)]
        for _ in range(rng.randrange(0, 4)):
            cut[rng.randrange(len(cut))] = "zz"
        rows.append((i, " ".join(w + [x.upper() + "," for x in cut] + w[:5])))
    rows += [(98, None), (99, "")]
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.overlaps(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = {}
    for d, t in rows:
        a = words(t)
        for i, u in items:
            b = words(u)
            if len(b) >= 12:
                n = sum(sum(a[p + k] == b[q + k] for k in range(12)) >= 10 for p in range(len(a) - 11) for q in range(len(b) - 11))
            else:
                n = sum(sum(x == y for x, y in zip(a[p : p + len(b)], b)) >= len(b) - len(b) // 6 for p in range(len(a) - len(b) + 1)) if b else 0
            if n:
                want[d, i] = n
    assert got == want and want


def overlaps_by_force(docs, items):
    """Windows that agree, for each document and item, counted over all places of both."""
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = {}
    for d, t in docs:
        a = words(t)
        for i, u in items:
            b = words(u)
            size = min(12, len(b))
            least = size - (2 if size == 12 else size // 6)
            hits = [(p, e) for p in range(len(a) - size + 1) for q in range(len(b) - size + 1) for e in [sum(x == y for x, y in zip(a[p : p + size], b[q : q + size]))] if e >= least] if b else []
            if hits:
                want[d, i] = (len(hits), min(p for p, _ in hits), max(p for p, _ in hits) + size, max(e for _, e in hits))
    return want


def test_decontamination_gives_every_item_of_a_shared_window(spark):
    rng = random.Random(14)
    shared = [f"s{k}" for k in range(15)]
    items = [(i, " ".join([f"a{i}x{k}" for k in range(rng.randrange(6))] + shared[rng.randrange(3) :] + [f"b{i}x{k}" for k in range(rng.randrange(6))])) for i in range(12)]
    items += [(20, " ".join(shared + ["mid"] + shared)), (21, "the"), (22, "the"), (23, "of the"), (24, "one two three four five six"), (25, "one two three four five six")]
    docs = [(i, " ".join(["the"] * rng.randrange(40) + shared[: rng.randrange(16)] + [f"d{i}", "of", "the", "one", "two", "zz", "four", "five", "six"] + shared[rng.randrange(4) :])) for i in range(30)]
    docs += [(100, "the " * 3_000), (101, "nothing of it")]
    rows, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = overlaps_by_force(docs, items)
    for threshold in ("10MB", "-1"):  # seeds sent to all tasks, and shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = {(r.doc_id, r.item_id): (r.n_windows, r.first_word, r.last_word, r.most_equal) for r in decontaminate.overlaps(rows, bench).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == want and len({i for _, i in want}) == len(items)
    dirty = {d for d, _ in want}
    assert {r.doc_id for r in decontaminate.remove_contaminated(rows, bench).collect()} == {d for d, _ in docs} - dirty


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"k{i}" for i in range(20))
    items = spark.createDataFrame([(None, item, 1), (3, "one two three", 1), (4, "", 1), (5, None, 1), (6, item, 1), (7, "a b c d e f g", 1)], "item_id bigint, text string, bucket int")
    docs = [(None, "x " + item, 1), (None, "clean words", 2), (1, "one, TWO three!", 3), (1, "nothing", 4), (2, "a b c X e f g", 5), (2, "a b X X e f g", 6), (8, "one two", 7), (9, ("pad " * 40000) + item, 8)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.most_equal) for r in decontaminate.overlaps(rows, items).collect()}
    assert got == {(None, None): (9, 12), (None, 6): (9, 12), (1, 3): (1, 3), (2, 7): (1, 6), (9, None): (9, 12), (9, 6): (9, 12)}
    assert decontaminate.overlaps(rows, items, shortest=4).filter("doc_id = 1").count() == 0
    assert sorted(r.item_id for r in decontaminate.remove_contaminated(rows, items).collect()) == [2, 4, 6, 7]
    assert decontaminate.overlaps(rows.limit(0), items).count() == 0 and decontaminate.overlaps(rows, items.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(rows, items.limit(0)).columns == rows.columns


def test_halves_meet_every_substitution():
    for size in range(1, decontaminate.WINDOW):
        for gone in itertools.combinations(range(size), size // 6):
            assert any(all(before + p not in gone for p in mask) for _, before, mask, _ in decontaminate.kind_of(size))


def test_pieces_equal_the_library(docs, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    got = {r.doc_id: r for r in sentencepiece_fst.encode_documents(docs).collect()}
    for d, t in texts:
        assert list(got[d].ids) == lib.encode(t or "") and got[d].round_trip
    fst = sentencepiece_fst.PieceTransducer(sentencepiece_fst.vocabulary(sentencepiece_fst.MODEL))
    rng = random.Random(0)
    for _ in range(3000):
        s = "".join(rng.choice("aábß \n\t日本x\U0001f600<s>!!1123 the ing     ﬁ") for _ in range(rng.randrange(30)))
        assert fst.encode(s) == lib.encode(s) and fst.decode(fst.encode(s)) == s


def test_pieces_of_odd_rows(spark, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    rng = random.Random(5)
    texts = ["\u2581 a \u2581", "x" * 3000, "日本語" * 700, " " * 500, "\n\n \t\r\n a\x0b\x0c", "", None, "<s></s><unk>", "\x00", "a  b", " lead", "trail "]
    texts += ["".join(rng.choice("ab \n日\U0001f600é") for _ in range(rng.randrange(200))) for _ in range(200)]
    rows = [(None if i % 3 else i, t, 0) for i, t in enumerate(texts)] * 2
    got = sentencepiece_fst.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string, ids int").coalesce(1)).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, (_, t, _) in zip(got, rows):
        assert list(r.ids) == lib.encode(t or "") and r.n_pieces == len(r.ids) and r.round_trip == ("\u2581" not in (t or ""))
        back = (t or "").replace("\u2581", " ")
        assert r.decoded_sha256 == hashlib.sha256((back if r.round_trip else sentencepiece_fst.PieceTransducer.decode(FST(), list(r.ids))).encode()).hexdigest()
    assert sentencepiece_fst.encode_documents(none).count() == 0


def FST(made=[]):
    if not made:
        made.append(sentencepiece_fst.PieceTransducer(sentencepiece_fst.vocabulary(sentencepiece_fst.MODEL)))
    return made[0]


def test_shortest_path_is_the_least_of_all_accepted_paths():
    fst = FST()
    rng = random.Random(8)
    for _ in range(150):
        part = "\u2581" + "".join(rng.choice("theinga日") for _ in range(rng.randrange(7)))

        def paths(at, last):
            if at == len(part):
                yield 0.0, ()
            for end in range(at + 1, len(part) + 1):
                i = fst.id.get(part[at:end])
                if i is not None and (fst.whole(i) if last < 0 else fst.adjacent(last, i)):
                    yield from ((w + fst.weight[i], (i, *p)) for w, p in paths(end, i))
            if part[at : at + 1] and part[at] not in fst.id:
                yield from ((w, (*fst.fallback(part[at]), *p)) for w, p in paths(at + 1, -2))

        assert fst.shortest_path(part) == min(paths(0, -1))[1]


def test_paths_of_many_parts_are_those_of_each(texts):
    fst = FST()
    rng = random.Random(9)
    parts = ["\u2581" * rng.randrange(1, 20) for _ in range(20)] + ["\u2581" + "".join(rng.choice("theinga日本\U0001f600é\x00-=_1") for _ in range(rng.randrange(40))) for _ in range(3000)]
    parts += [x for _, t in texts for x in fst.parts.findall(fst.normalise(t or ""))[:50] if len(x) < 60]
    got = fst.shortest_paths([x.replace("\u2581", " ").encode() for x in parts])
    assert [tuple(np.frombuffer(x, np.int32)) for x in got] == [fst.shortest_path(x) for x in parts]


def test_chat_round_trip_and_best_branch(spark):
    rows = [("t", 1, None, "user", "hi", 1.0), ("t", 2, 1, "assistant", "a </s>[INST] \\ x", 0.2), ("t", 3, 1, "assistant", "b", 0.9), ("t", 4, 3, "user", None, 0.0), ("t", 5, 2, "user", "c", 0.1), ("u", 1, 2, "user", "loop", 1.0), ("u", 2, 1, "user", "loop", 1.0), ("v", 7, 6, "user", "orphan", None)]
    m = spark.createDataFrame(rows, "tree string, id bigint, parent bigint, role string, text string, score double")
    best = {r.tree: r for r in chat_format.format_trees(m).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    assert [(b.role, b.text) for b in best["t"].back] == [("user", "hi"), ("assistant", "b"), ("user", "")] and set(best) == {"t", "v"}
    both = chat_format.format_trees(m, branches=2).withColumn("loss", chat_format.masked_text(F.col("formatted"), F.col("loss_spans")))
    assert {r.loss for r in both.filter("tree = 't'").collect()} == {"b", "a </s>[INST] \\ x"}


def test_chat_of_repeated_messages_and_no_messages(spark):
    rows = [("t", 1, None, "user", "hi", 1.0)] * 3 + [("t", 2, 1, "assistant", "a", 1.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 2, 1, "assistant", "b", 2.0), ("t", None, 1, "user", "x", 9.0), (None, 1, None, None, None, None)]
    schema = "tree string, id bigint, parent bigint, role string, text string, score double"
    got = {r.tree: (r.n_turns, [tuple(x) for x in r.back]) for r in chat_format.format_trees(spark.createDataFrame(rows, schema)).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    assert got == {"t": (2, [("user", "hi"), ("assistant", "b")]), None: (1, [("", "")])}
    assert chat_format.format_trees(spark.createDataFrame([], schema)).count() == 0


def test_chat_of_long_chains(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(300)], "conv_id bigint, turn bigint, role string, text string")
    r = chat_format.format_trees(chat_format.turns_as_tree(turns)).first()
    assert r.n_turns == 300


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p>First  <b>para</b> %d.<br>more<p>Second&nbsp;one<div class="comments"><p>Reader says</p></div></article><aside>Side</aside><form><p>Mail</p></form><footer>&copy;</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % i) for i in range(6)] + [(10, None, None), (11, "http://lone.example/", "<p>Only text"), (12, "bad", ""), (13, "http://h.example/odd", "<div><p>No article here</p></div>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"Head & line\nFirst para {i}. more\nSecond one" for i in range(6))
    assert got[10] == "" and got[11] == "Only text" and got[12] == "" and got[13] == "No article here"


def test_classes_share_occurrence_vectors(spark):
    pages = spark.createDataFrame([(i, f"h{i}", PAGE % i, "h") for i in range(4)], "page_key bigint, url string, html string, host string")
    by = {r.token: r["class"] for r in html_extract.equivalence_classes(pages).collect()}
    assert by["html/body/article"] == by["html/body/nav"] == by["html/body/footer"] and by["html/body/article/p"] != by["html/body/article"]


def test_conversation_without_an_id_is_kept(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (1, 0, "user", "a"), (1, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.tree: (r.n_turns, r.formatted) for r in chat_format.format_trees(chat_format.turns_as_tree(turns)).collect()}
    assert set(got) == {None, 1} and got[None] == (2, "<s>user[INST]hi[/INST]</s>\n<s>assistant[INST]yes[/INST]</s>\n")


def test_html_keeps_headings_and_drops_text_of_another_class(spark):
    body = '<html><body><div class="menu">Menu</div><article><div class="article-header"><h1>Head %d</h1></div><p>Own text %d.</p><div class="box"><p>Same words</p></div><p>%s</p></article><footer>F</footer></body></html>'
    rows = [(i, f"http://k.example/{i}", body % (i, i, "Now and then" if i % 2 else f"Other {i}")) for i in range(8)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(table).collect()}
    # "Same words" is on all pages, so of the class of its box: template.  "Now and then" is on half of them, a class
    # that no element of its own encloses: it stays
    assert all(got[i] == f"Head {i}\nOwn text {i}.\n" + ("Now and then" if i % 2 else f"Other {i}") for i in range(8))
    keyed = spark.createDataFrame([(i, "k.example", h) for i, _, h in rows], "page_key bigint, host string, html string")
    by = {(r.path.split("/")[-1], r.mark == 0): r for r in html_extract.equivalence_classes(keyed).filter("mark IS NOT NULL").collect()}
    assert by["article", True]["class"] == by["div.box", True]["class"] and by["article", True].support == 8
    rare = [r for r in html_extract.equivalence_classes(keyed).filter("support = 4").collect()]
    assert len(rare) == 1 and rare[0]["class"] != by["article", True]["class"]


def test_html_of_odd_tables(spark):
    long = "<html><body><article><p>" + "many words here " * 100000 + "</p></article></body></html>"
    rows = [(None, None, None, "a"), (1, "http://x.example/1", long, "b"), (1, "http://x.example/1", long, "c"), (2, "http://x.example/2", "<div><p>Tie one</p></div><div><p>Tie two</p></div>", "d")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1599999), (1, 1599999), (2, 15)]
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


UNNAMED = """<html><body><div class="k1"><p>Start</p><p>Shop</p></div><div class="k2"><p>Seen %d times</p></div><form><div class="widget">
<h2>Title %d</h2><p>Long varying text number %d of the page.</p><p>More of it, %d.</p><div class="k8">Always here</div></div></form><div class="k3">A fixed notice that is longer than all the varying text of any page of this host, so that length alone would choose it over the article.</div></body></html>"""


def test_html_slot_comes_from_classes_not_names(spark):
    rows = [(i, f"http://n.example/{i}", UNNAMED % (i, i, i, i)) for i in range(5)] + [(9, "http://n.example/0", UNNAMED % (0, 0, 0, 0))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Title {i % 9}\nLong varying text number {i % 9} of the page.\nMore of it, {i % 9}." for i in (0, 1, 2, 3, 4, 9)}


def test_classifier_on_held_out_labels(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    scored = quality.score(docs, labels.filter(~fold)).join(quality.grades(labels.filter(fold)), "doc_id")
    rows = scored.select("grade", "p_ge_2", "p_ge_1").collect()
    right = sum((r.p_ge_2 >= quality.KEEP_AT) == (r.grade == 2) for r in rows)
    assert right >= 0.93 * len(rows) and all(r.p_ge_1 >= r.p_ge_2 for r in rows)


def test_classifier_finds_the_optimum_of_the_likelihood():
    rng = np.random.default_rng(1)
    kinds = [[5, 6], [5], [7], [7, 8], [6, 8], [8]]
    feats, grade = [], []
    for k in rng.integers(0, 6, 900):
        feats.append(np.array(sorted({*kinds[k], 20 + int(rng.integers(0, 9))}), np.int32))
        grade.append(int(np.clip(k // 2 + rng.integers(-1, 2) * (rng.random() < 0.3), 0, 2)))
    grade = np.array(grade)
    weights, theta = quality.fit(grade, feats, rounds=3000)
    col, row = np.concatenate(feats), np.repeat(np.arange(900), [len(f) for f in feats])
    used = np.flatnonzero(weights)
    assert set(used) >= {5, 7, 8} and len(used) < 15
    keep = np.isin(col, used)
    col, row, have = np.searchsorted(used, col[keep]), row[keep], np.bincount(col, minlength=40)[used]
    whole = np.concatenate(feats)
    odds = quality.doubt(grade, np.bincount(whole, minlength=40), whole, np.repeat(np.arange(900), [len(f) for f in feats]))
    ridge = quality.RIDGE * np.maximum(odds[used], 1) ** 1.5 / have
    # plain gradient descent from another start, with the likelihood written out
    w, t = np.ones(len(used)), np.array([-1.0, 1.0])
    for _ in range(6000):
        _, gw, gt = quality.loss(w, t, grade, col, row, ridge)
        w, t = w - 2 * gw, t - 2 * gt
    said = lambda w, t: -sum(
        np.log((1 if g == 2 else 1 / (1 + np.exp(-(t[g] - s)))) - (0 if g == 0 else 1 / (1 + np.exp(-(t[g - 1] - s))))) for g, s in zip(grade, np.bincount(row, weights=w[col], minlength=900))
    ) / 900 + (ridge * w * w).sum() / 1800
    assert abs(said(weights[used], theta) - said(w, t)) < 1e-4
    sums = [np.bincount(row, weights=x[col], minlength=900) - y[1] for x, y in ((weights[used], theta), (w, t))]
    assert np.abs(sums[0] - sums[1]).max() < 0.01  # all noise words together can be shifted against the thresholds


def test_classifier_judges_each_row_by_its_text(spark):
    good, bad = "clean calm words of use " * 3, "vile crude words of none " * 3
    rows = [(i, bad + str(i) if i % 2 else good + str(i), "x") for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (None, bad, "a"), (None, good, "b"), (0, bad, "c"), (300, None, "d"), (301, "", "e"), (302, (good + " ") * 2000, "f")], "doc_id bigint, text string, score string")
    kept = {(r.doc_id, r.score) for r in quality.select_good(docs, labels).collect()}
    assert {(None, "b"), (302, "f"), (0, "x")} <= kept and not kept & {(None, "a"), (0, "c"), (1, "x")} and sum(x == "x" for _, x in kept) == 100
    assert quality.score(docs, labels).filter("doc_id IS NULL").count() == 2
    assert quality.select_good(docs.limit(0), labels.limit(0)).count() == 0


def test_classifier_without_labels_keeps_all(docs, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.select_good(docs, labels).count() == docs.count()


def test_language_model_learns_and_scores_every_row(spark, sf):
    big = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    mean = lambda rounds: masked_lm.score(big, rounds).agg(F.sum("log_prob") / F.sum("n_words")).first()[0]
    assert mean(2) > mean(0) + 0.2


def test_language_model_on_odd_rows(docs, texts, none):
    got = {r.doc_id: r for r in masked_lm.score(docs).collect()}
    assert {d: got[d].n_words for d, _ in texts} == {d: len(WORD.findall(t or "")) for d, t in texts}
    assert all((r.log_prob < 0) == (r.n_words > 0) for r in got.values()) and masked_lm.score(none).count() == 0


def test_language_model_grows_with_the_corpus(spark):
    rows = [(i, " ".join(f"v{(7 * i + k) % 70000}" for k in range(7))) for i in range(0, 10000)]
    counts = masked_lm.word_counts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert counts.count() == 70000 - len(set(range(70000)) - {int(w[1:]) for _, t in rows for w in t.split()})
    assert masked_lm.sizes(10**8)[0] > masked_lm.sizes(10**6)[0] and masked_lm.sizes(10**8)[1] > masked_lm.sizes(10**6)[1]


def test_language_model_masks_every_position_once():
    place = np.arange(5, 105)
    for rounds in (1, 2, 3, 16):
        seen = np.concatenate([masked_lm.masked(place, k, rounds) for k in range(rounds)])
        assert sorted(seen) == list(range(100))


def test_untrained_word_probabilities_come_from_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "KNOWN", 50)
    monkeypatch.setattr(masked_lm, "start", lambda shapes: np.zeros(masked_lm.size_of(shapes), np.float32))
    rows = [(i, " ".join(f"x{j}" for j in range(400) if i % (j % 9 + 1) == 0)) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, "x0"), (None, "x0")], "doc_id bigint, text string")
    vocabulary = masked_lm.vocabulary_of(masked_lm.word_counts(docs))
    count = {r.word: r.n for r in masked_lm.word_counts(docs).collect()}
    _, cls, _ = vocabulary.look(np.array(list(count), np.int64))
    total = defaultdict(int)
    for k, n in zip(cls, count.values(), strict=True):
        total[k] += n
    share = {w: np.log(n / total[k]) - np.log(vocabulary.classes) for (w, n), k in zip(count.items(), cls, strict=True)}
    got = masked_lm.score(docs, rounds=0).collect()
    assert len(got) == 62
    text = dict(rows)
    for r in got:
        raw = text.get(r.doc_id, "x0").encode()
        w = masked_lm.words_of(masked_lm.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True))
        assert abs(r.log_prob - sum(share[x] for x in w)) < 1e-3 * max(1, len(w))


def test_gradient_is_the_difference_quotient():
    rng = np.random.default_rng(0)
    flat = masked_lm.start().astype(np.float64)
    ctx, target = rng.integers(0, masked_lm.INPUTS, (8, 4)), rng.integers(0, masked_lm.CLASSES, 8)

    def loss(w):
        m = masked_lm.views(w)
        z = masked_lm.hidden(m, ctx) @ m["out"] + m["out_bias"]
        return -(z[np.arange(8), target] - np.log(np.exp(z).sum(axis=1))).mean()

    moved = flat.copy()
    seen = np.zeros_like(flat)
    masked_lm.step(masked_lm.views(moved), masked_lm.views(seen), ctx, target)
    for k in np.flatnonzero(seen)[:: max(1, np.count_nonzero(seen) // 25)]:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert abs(abs((loss(up) - loss(down)) / 2e-5) - np.sqrt(seen[k])) < 1e-4


def test_very_long_texts_and_words(spark):
    words = " ".join(f"w{i % 5000}" for i in range(600_000))  # about 3.5 MB
    rows = [(1, words, 0), (2, "start " + words, 0), (3, "x" * 150_000, 0), (4, "short text of a few words", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bucket int")
    assert {r.doc_id: r.n_removed for r in substring_dedup.repeated_windows(docs).collect()} == {1: 0, 2: 600_000, 3: 0, 4: 0}
    assert {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.repeated_bytes(docs).filter("doc_id <> 1").collect()} == {2: 5, 3: 150_000, 4: 25}
    assert {r.doc_id: r.group_size for r in exact_dedup.assign_groups(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert {r.doc_id: r.component_id for r in jaccard_join.join_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert all(r.round_trip for r in sentencepiece_fst.encode_documents(docs).select("round_trip").collect())
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100, 120)))], "item_id bigint, text string")
    assert {r.doc_id: r.n_windows for r in decontaminate.overlaps(docs, items).collect()} == {1: 9 * 120, 2: 9 * 120}
    assert {r.doc_id: r.n_words for r in masked_lm.score(docs).collect()} == {1: 600_000, 2: 600_001, 3: 1, 4: 6}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= before, name
    labels = quality.grades(spark.read.parquet(f"{sf}/labels.parquet"))
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf).join(labels, "doc_id").groupBy("grade").count().collect()
    by = {r.grade: r["count"] for r in kept}
    total = {r.grade: r["count"] for r in labels.groupBy("grade").count().collect()}
    assert by[2] >= 0.95 * total[2] and by.get(0, 0) <= 0.2 * total[0]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_equals_brute_force(spark, sf):
    """Every stage after the classifier again in plain Python, over all documents."""
    import corpus_pipeline

    sentencepiece = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter(F.col("p_ge_2") >= quality.KEEP_AT).select("doc_id").collect()}
    left = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect() if r.doc_id in good}
    groups = defaultdict(list)
    for d, t in left.items():
        groups["".join(WORD.findall(t))].append((-len(t), d))
    left = {d: left[d] for d in (min(g)[1] for g in groups.values())}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in left.items():
        w = WORD.findall(t.translate(low))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            up[max(root(a), root(b))] = min(root(a), root(b))
    left = {d: t for d, t in left.items() if root(d) == d}
    plain = str.maketrans({chr(c): " " for c in range(33, 127) if not chr(c).isalnum()} | {chr(c): chr(c + 32) for c in range(65, 91)})
    number: dict = {}
    words = lambda t: np.array([number.setdefault(w, len(number)) for w in WORD.findall(t.translate(plain))], np.int64)
    items = [words(r.text or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert min(map(len, items)) >= decontaminate.WINDOW

    def leaks(a):
        for b in items:
            equal = a[:, None] == b[None, :]
            for shift in range(-len(b) + 12, len(a) - 11):
                run = np.diagonal(equal, -shift)
                if len(run) >= 12 and np.convolve(run, np.ones(12, int), "valid").max() >= 10:
                    return True
        return False

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    want = {d: lib.encode(t) for d, t in left.items() if not leaks(words(t))}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(want) < len(good)


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op8_exact_dedup"])
def test_agrees_with_sql(spark, sf, name):
    from oracle import assert_same, connect

    from tidewire.llm.queries import ORACLE_SQL

    assert_same(QUERIES[name](spark, sf).toPandas(), connect(sf).execute(ORACLE_SQL[name]).df())


def test_encoder_works_in_little_memory_whatever_the_batch():
    """Two tasks of an executor encode at once; a batch of 2 MB once took 159 MB in each, now 43."""
    pytest.importorskip("sentencepiece")
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(vocab, k=300)) for _ in range(1400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    fst = sentencepiece_fst.PieceTransducer(sentencepiece_fst.vocabulary(sentencepiece_fst.MODEL))
    tracemalloc.start()
    try:
        done = 0
        for rows, raw, off in words.slices([batch], size=sentencepiece_fst.SLICE):
            *_, back, at = fst.encode_slice(raw, off)
            assert [back[a + (b > a) : b].tobytes().decode() for a, b in itertools.pairwise(at.tolist())] == texts[done : done + len(rows)]
            done += len(rows)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert done == len(texts)
    assert peak < 80, peak


def test_tasks_hand_memory_back_also_when_they_end_early(monkeypatch):
    ended = []
    monkeypatch.setattr(words, "release_memory", lambda: ended.append(1))
    task = words.handing_back(lambda batches: (x + 1 for x in batches))
    assert list(task(iter([1, 2]))) == [2, 3] and ended == [1]
    some = task(iter([1, 2]))
    assert next(some) == 2 and ended == [1]
    some.close()
    assert ended == [1, 1]
