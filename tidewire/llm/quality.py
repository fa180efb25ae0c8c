"""Ordinal quality classifier: cumulative-link regression on hashed text.

Ratings are ordered grades: 0 toxic, 1 poor, 2 good.  One weight vector over hashed
features is shared by all thresholds: P(grade <= k) = sigmoid(theta_k - w.x), with
theta_0 < theta_1.  The score gives tail probabilities P(grade >= k) and the expected
grade.  A document is kept when P(grade >= 2) is at least ``keep_at``.

Features are presences: lower-cased words, runs of punctuation inside words, and binned
shape statistics (share of distinct words, of words equal to the one before, of words
without a letter, mean word length), taken from the whole text.  Features whose presence does not
differ between grades beyond chance get no weight (:func:`doubt`), so the length of a text
does not move its score; the others are shrunk the more the rarer and the more doubtful they are.

The model is fitted on at most ``sample`` labelled documents, those with the smallest
hash of their id (a documented bound: feature lists of the sample go to the driver, and
the weights, of fixed size, are broadcast).  Every row is scored over its whole text.

Null or empty text has shape features only.  Labels with a null grade are skipped; of
repeated labels for one document the lowest grade counts; of documents that repeat a
labelled id one is fitted on.  Without labels every document scores 0 and is kept.  Each row
is judged by its own text, so rows with a null or a repeated id are kept or rejected like any
other.  An empty table gives an empty result.  Extra columns pass through
:func:`select_good` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import Words, handing_back, mix, slices

BITS = 20
SAMPLE = 8_000
KEEP_AT = 0.5
#: features that may be taken in full by chance, how doubtful one may be, and the ridge of a feature of one document
CHANCE, DOUBTFUL, RIDGE = 10, 10.0, 0.3
PUNCT = np.zeros(256, dtype=bool)
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[c for c in range(256) if c > 127 or chr(c).isalpha()]] = True
SCORED = "doc_id bigint, score double, p_ge_1 double, p_ge_2 double, expected_grade double"


def _runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hash and row of each run of ASCII punctuation of at least two characters or a bar."""
    inside = PUNCT[raw]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = (end - start >= 2) | (raw[np.minimum(start, len(raw) - 1)] == 0x7C) if len(start) else np.zeros(0, bool)
    start, end = start[long], end[long]
    size = np.minimum(end - start, 3)
    h = np.zeros(len(start), np.uint64)
    for k in range(3):
        has = size > k
        h[has] = h[has] * np.uint64(257) + raw[start[has] + k] + np.uint64(1)
    return mix(h + np.uint64(0x51ED270B)), np.searchsorted(off, start, "right") - 1


def _bins(words: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Binned shape statistics of each row as feature hashes."""
    n = np.diff(words.at).astype(float)
    most = np.maximum(n, 1)
    same = np.zeros(rows)
    letters = np.zeros(rows)
    length = np.zeros(rows)
    if len(words):
        h, doc = words.hash, words.doc
        twin = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        same = np.bincount(doc[1:][twin], minlength=rows) / most
        ends = np.concatenate([[0], np.cumsum(LETTER[words.raw])])
        letters = np.bincount(doc[ends[words.end] == ends[words.start]], minlength=rows) / most
        length = np.bincount(doc, weights=(words.end - words.start).astype(float), minlength=rows) / most
    values = [np.digitize(same, [1e-9, 0.02, 0.1, 0.3]), np.digitize(letters, [1e-9, 0.05, 0.2, 0.5]), np.digitize(length, [2, 3, 4, 5, 6, 7, 8, 10, 15]), np.digitize(n, [1, 3, 6, 12, 25, 50])]
    hashes = [mix(np.uint64(1000 * (k + 1)) + v.astype(np.uint64)) for k, v in enumerate(values)]
    return np.concatenate(hashes), np.tile(np.arange(rows), len(values))


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of a slice, not distinct."""
    words = Words(raw, off, lower=True)
    rows = len(off) - 1
    parts = [(words.hash, words.doc), _runs(raw, off), _bins(words, rows)]
    return (np.concatenate([p[0] for p in parts]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([p[1] for p in parts])


def _distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row << BITS) | feature)
    return key & ((1 << BITS) - 1), key >> BITS


def _sample_features(docs: DataFrame) -> pd.DataFrame:
    @handing_back
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw, off in slices(batches):
            f, r = _distinct(*features(raw, off))
            cut = np.searchsorted(r, np.arange(len(ids) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(lists, "doc_id bigint, features binary").toPandas()


def doubt(grade: np.ndarray, have: np.ndarray, col: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each feature, how many as one-sided would be expected by chance, in units of CHANCE.

    By the Chernoff bound a feature of h documents that has nothing to do with a threshold is
    as one-sided as its share r with a probability of at most exp(-h KL(r, share)); this is
    multiplied by the number of features tested.  Features of one document count as infinite.
    """
    best = np.zeros(len(have))
    tested = np.count_nonzero(have > 1)
    h = np.maximum(have, 1)
    for k in (1, 2):
        top = grade >= k
        share = top.mean()
        if 0 < share < 1:
            r = np.bincount(col[top[row]], minlength=len(have)) / h
            kl = r * np.log(np.maximum(r, 1e-300) / share) + (1 - r) * np.log(np.maximum(1 - r, 1e-300) / (1 - share))
            best = np.maximum(best, h * kl)
    return np.where(have > 1, tested / CHANCE * np.exp(-best), np.inf)


def loss(w: np.ndarray, theta: np.ndarray, grade: np.ndarray, col: np.ndarray, row: np.ndarray, ridge: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalised negative log-likelihood a document, and its gradients by weights and thresholds."""
    cut = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    n = len(grade)
    s = np.bincount(row, weights=w[col], minlength=n)
    low = np.where(grade > 0, cut(theta[np.maximum(grade - 1, 0)] - s), 0.0)
    high = np.where(grade < 2, cut(theta[np.minimum(grade, 1)] - s), 1.0)
    p = np.maximum(high - low, 1e-9)
    dh, dl = high * (1 - high) / p, low * (1 - low) / p
    gw = (np.bincount(col, weights=(dh - dl)[row], minlength=len(w)) + ridge * w) / n
    gt = np.array([dl[grade == 1].sum() - dh[grade == 0].sum(), dl[grade == 2].sum() - dh[grade == 1].sum()]) / n
    return float((-np.log(p).sum() + (ridge * w * w).sum() / 2) / n), gw, gt


def fit(grade: np.ndarray, features_of: list[np.ndarray], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights over all features and the two thresholds.  The ridge of a feature grows
    with its rarity and its doubt; features whose doubt is over DOUBTFUL get no weight."""
    weights, theta = np.zeros(1 << BITS), np.array([-40.0, -20.0])
    if not len(grade):
        return weights, theta
    size = np.array([len(f) for f in features_of])
    col = np.concatenate(features_of) if size.sum() else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(grade)), size)
    have = np.bincount(col, minlength=1 << BITS)
    odds = doubt(grade, have, col, row)
    keep = odds[col] <= DOUBTFUL
    names, col = np.unique(col[keep], return_inverse=True)
    row = row[keep]
    ridge = RIDGE * np.maximum(odds[names], 1.0) ** 1.5 / have[names]
    w, theta = np.zeros(len(names)), np.array([-2.0, -1.0])
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros(2), np.zeros(2)
    for step in range(1, rounds + 1):
        _, gw, gt = loss(w, theta, grade, col, row, ridge)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mt, vt = 0.9 * mt + 0.1 * gt, 0.999 * vt + 0.001 * gt**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.1 * (mw / c1) / (np.sqrt(vw / c2) + 1e-9)
        theta -= 0.1 * (mt / c1) / (np.sqrt(vt / c2) + 1e-9)
        theta[1] = max(theta[1], theta[0] + 1e-3)
    weights[names] = w
    return weights, theta


def grades(labels: DataFrame) -> DataFrame:
    """Grade of each labelled document: 0 if toxic, else 1 + quality."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)
    return labels.select(F.col("doc_id").alias("doc_id"), grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rated = chosen.toPandas()  # at most `sample` rows of two numbers
    wanted = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    found = _sample_features(wanted).drop_duplicates("doc_id").merge(rated, on="doc_id").sort_values("doc_id")
    return fit(found["grade"].to_numpy(), [np.frombuffer(x, np.int32) for x in found["features"]])


def _model(docs: DataFrame, labels: DataFrame, sample: int):
    """Broadcast weights (at most 2**BITS) and thresholds, and the function that scores a slice."""
    weights, theta = train(docs, labels, sample)
    used = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((used, weights[used], theta))

    def scorer():
        at, value, (t0, t1) = model.value
        w = np.zeros(1 << BITS)
        w[at] = value

        def rate(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            f, r = features(raw, off)
            hit = w[f] != 0
            f, r = _distinct(f[hit], r[hit])
            s = np.bincount(r, weights=w[f], minlength=len(off) - 1).astype(float)
            return s, 1 / (1 + np.exp(np.clip(t0 - s, -40, 40))), 1 / (1 + np.exp(np.clip(t1 - s, -40, 40)))

        return rate

    return scorer


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, score, tail probabilities and expected grade."""
    scorer = _model(docs, labels, sample)

    @handing_back
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer()
        for batch in batches:
            at = 0
            for ids, raw, off in slices([batch]):
                s, ge1, ge2 = judge(raw, off)
                own = batch.column("doc_id").slice(at, len(ids)).cast(pa.int64())
                at += len(ids)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x) for x in (s, ge1, ge2, ge1 + ge2))], names=["doc_id", "score", "p_ge_1", "p_ge_2", "expected_grade"])

    return docs.select("doc_id", "text").mapInArrow(rate, SCORED)


def select_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns; rows are judged where they are read."""
    scorer = _model(docs, labels, sample)

    @handing_back
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer()
        for batch in batches:
            good = [judge(raw, off)[2] >= keep_at for _, raw, off in slices([batch])]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(keep, docs.schema)
