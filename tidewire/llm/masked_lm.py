"""Masked pseudo-likelihood scores from a bidirectional window network.

Every word is predicted from the two words before and the two after it.  Words are
lower-cased and known by a 64-bit hash.  Their counts over all documents are a Spark table
with one row for each distinct word.  The number of distinct words sets the number of
classes and of input embeddings, both with its square root.  The most frequent words have
an output class and an input embedding of their own; the others are dealt to the remaining
classes and embeddings by hash.  Inside a class a word has its share of the class's count:

    log P(word | both sides) = log P(class | both sides) + log(count / count of class)

with P(class | both sides) a softmax over a tanh layer that sums one embedding for each
of the four places.  A document's score is the sum over all its words, whole text.
Counts of at most KNOWN frequent words are broadcast; all others are joined to the words
of the documents by a shuffle.

Training masks positions by offset modulo MASK, each round its share of the offsets, so
that every position of every document is a target once.  Each task trains a copy of the
weights on its partition in numpy; copies are averaged, weighted by masked positions, in
two levels of grouping, so no task meets more than the square root of their number.  Only
the averaged weights and the frequent words go to the driver and are broadcast.

A document without words scores 0 over 0 words; null text counts as empty; a null id stays
null; repeated rows are scored one by one; an empty table trains on nothing.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import NO_ID, Words, slices

KNOWN, SLOT_BITS, HELD = 1 << 18, 21, 1 << 21
# sizes for a small corpus, and the least for any
INPUTS, CLASSES, OWN, WIDTH = 2048, 128, 96, 24
PLACES = (-2, -1, 1, 2)
MASK, ROUNDS, BATCH, BLOCK, RATE = 16, 2, 1024, 4096, 0.15
CHUNK = 8192
NAMES = ["row", "word", "doc_id", "n_words", "log_prob"]



def shapes_of(inputs: int, classes: int) -> dict[str, tuple[int, ...]]:
    return {"embed": (len(PLACES), inputs, WIDTH), "bias": (WIDTH,), "out": (WIDTH, classes), "out_bias": (classes,)}


def size_of(shapes: dict[str, tuple[int, ...]]) -> int:
    return sum(int(np.prod(s)) for s in shapes.values())


SHAPES = shapes_of(INPUTS, CLASSES)


def sizes(distinct: int) -> tuple[int, int]:
    """Numbers of input embeddings and of classes for a corpus of so many distinct words."""
    root = distinct**0.5
    return max(INPUTS, 256 * int(root / 128)), max(CLASSES, 16 * int(root / 192))


def views(flat: np.ndarray, shapes: dict[str, tuple[int, ...]] = SHAPES) -> dict[str, np.ndarray]:
    at, found = 0, {}
    for name, shape in shapes.items():
        n = int(np.prod(shape))
        found[name] = flat[at : at + n].reshape(shape)
        at += n
    return found


def start(shapes: dict[str, tuple[int, ...]] = SHAPES) -> np.ndarray:
    return np.random.default_rng(7).normal(0, 0.1, size_of(shapes)).astype(np.float32)


class Vocabulary:
    """Input and class of each word, and the logarithm of its share as far as its count is known here."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, distinct: int) -> None:
        self.inputs, self.classes = sizes(distinct)
        self.own = self.classes * OWN // CLASSES
        order = np.lexsort((words, -counts))
        words, counts = words[order], counts[order]
        # a word whose slot is taken by a more frequent one is not known
        _, first = np.unique(slot_of(words), return_index=True)
        first.sort()
        self.words, self.counts = words[first], counts[first].astype(float)
        self.slot = np.full(1 << SLOT_BITS, len(self.words), np.int32)
        self.slot[slot_of(self.words)] = np.arange(len(self.words), dtype=np.int32)
        self.log_count = np.log(np.append(self.counts, 1.0)).astype(np.float32)
        self.log_total = np.zeros(self.classes, np.float32)

    def dealt(self, words: np.ndarray) -> np.ndarray:
        """Class by hash, of words without their own."""
        return self.own + words % (self.classes - self.own)

    def set_totals(self, total: np.ndarray) -> None:
        """total: by class dealt by hash, the count of all words."""
        own, counts = self.words[: self.own], self.counts[: self.own]
        total = total - np.bincount(self.dealt(own), weights=counts, minlength=self.classes)
        total[: len(own)] = counts
        self.log_total = np.log(np.maximum(total, 1.0)).astype(np.float32)

    def look(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input, class and place of each word; the place of a word that is not known is their number."""
        place = self.slot[slot_of(words)]
        miss = np.append(self.words, 0)[place] != words
        place[miss] = len(self.words)
        known = len(self.words)
        cls = np.where((place < self.own) & (place < known), place, self.dealt(words)).astype(np.int32)
        held = (self.inputs - 1) * 3 // 4
        ids = np.where((place < held) & (place < known), place, held + words % (self.inputs - 1 - held)).astype(np.int32)
        return ids, cls, place


def slot_of(words: np.ndarray) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def words_of(w: Words) -> np.ndarray:
    return w.hash.view(np.int64)


def masked(place: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """Positions that round ``number`` masks: over all rounds, each one once."""
    return np.flatnonzero(place % MASK % min(rounds, MASK) == number)


def contexts(inputs: np.ndarray, doc: np.ndarray, at: np.ndarray, beyond: int = INPUTS - 1) -> np.ndarray:
    """Input ids at the four places around each position; ``beyond`` past a document's ends."""
    n = len(inputs)
    found = np.full((len(at), len(PLACES)), beyond, np.int32)
    for k, p in enumerate(PLACES):
        q = at + p
        ok = (q >= 0) & (q < n)
        ok[ok] = doc[q[ok]] == doc[at[ok]]
        found[ok, k] = inputs[q[ok]]
    return found


def hidden(model: dict[str, np.ndarray], ctx: np.ndarray) -> np.ndarray:
    total = model["bias"] + model["embed"][0][ctx[:, 0]]
    for k in range(1, len(PLACES)):
        total += model["embed"][k][ctx[:, k]]
    return np.tanh(total, out=total)


def step(model: dict[str, np.ndarray], seen: dict[str, np.ndarray], ctx: np.ndarray, target: np.ndarray) -> None:
    """AdaGrad steps of the output weights for each BATCH masked positions, and one step of the embeddings for all of them."""
    back = []
    for k in range(0, len(target), BATCH):
        aim = target[k : k + BATCH]
        n = np.float32(len(aim))
        h = hidden(model, ctx[k : k + BATCH])
        z = h @ model["out"]
        z += model["out_bias"]
        np.exp(z, out=z)  # scores stay far below overflow: tanh units and trained weights are small
        z *= (1 / (z.sum(axis=1) * n))[:, None]
        z[np.arange(len(z)), aim] -= 1 / n
        dh = z @ model["out"].T
        dh *= 1 - h * h
        back.append(dh)
        for name, g in (("out", h.T @ z), ("out_bias", z.sum(axis=0)), ("bias", dh.sum(axis=0))):
            seen[name] += g * g
            model[name] -= RATE * g / np.sqrt(seen[name] + 1e-6)
    # the embeddings of all four places in one table, each row's gradients summed
    dh = np.concatenate(back)
    embed, squares = (x["embed"].reshape(-1, dh.shape[1]) for x in (model, seen))
    ids = (ctx + np.arange(ctx.shape[1], dtype=np.int32) * model["embed"].shape[1]).T.ravel()
    order = np.argsort(ids.astype(np.uint16) if len(embed) <= 1 << 16 else ids, kind="stable")  # 16-bit keys are sorted by radix
    ids = ids[order]
    first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    g = np.add.reduceat(dh[order % len(dh)], first, axis=0)
    ids = ids[first]
    total = squares[ids]
    total += g * g
    squares[ids] = total
    total += 1e-6
    g *= RATE
    g /= np.sqrt(total, out=total)
    embed[ids] -= g


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): count of each distinct word over all words of all documents."""

    def merged(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        w, n = np.concatenate(words), np.concatenate(counts)
        order = np.argsort(w, kind="stable")
        w, n = w[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
        return w[first], np.add.reduceat(n, first) if len(w) else n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, raw, off in slices(batches):
            w, n = np.unique(words_of(Words(raw, off, lower=True)), return_counts=True)
            words.append(w)
            counts.append(n)
            if sum(map(len, words)) > HELD:
                w, n = merged(words, counts)
                if len(w) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], names=["word", "n"])
                    w, n = w[:0], n[:0]
                words, counts = [w], [n]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(words, counts)], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The vocabulary sized by the counts; at most KNOWN frequent words come to the driver."""
    grade = F.floor(F.log2("n") * 16)
    by = counts.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("grade")).collect()
    distinct, held, least = sum(r.words for r in by), 0, None
    for r in by:
        held += r.words
        if held > KNOWN:
            break
        least = r.grade
    known = counts.filter(grade >= least if least is not None else F.lit(False)).toPandas()
    v = Vocabulary(known["word"].to_numpy(np.int64), known["n"].to_numpy(np.int64), distinct)
    rest = F.pmod(F.col("word"), F.lit(v.classes - v.own))
    total = np.zeros(v.classes)
    for r in counts.groupBy(rest.alias("k")).agg(F.sum("n").alias("n")).collect():
        total[v.own + r.k] = r.n
    v.set_totals(total)
    return v


def train_round(docs: DataFrame, vocabulary, weights, number: int, rounds: int = ROUNDS) -> np.ndarray | None:
    """Averaged weights after each task has trained on its partition's masked positions."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = vocabulary.value, weights.value.copy()
        shapes = shapes_of(v.inputs, v.classes)
        model, seen, size = views(flat, shapes), views(np.zeros(len(flat), np.float32), shapes), len(flat)
        n = 0
        for ids, raw, off in slices(batches):
            w = Words(raw, off, lower=True)
            b, cls, _ = v.look(words_of(w))
            at = masked(np.arange(len(b)) - w.at[w.doc] + ids[w.doc] % MASK, number, rounds)
            at = np.random.default_rng(n).permutation(at)
            ctx, target = contexts(b, w.doc, at, v.inputs - 1), cls[at]
            for k in range(0, len(at), BLOCK):
                step(model, seen, ctx[k : k + BLOCK], target[k : k + BLOCK])
            n += len(at)
        if n:
            part = TaskContext.get().partitionId()
            cut = range(0, size, CHUNK)
            cols = [pa.array([k // CHUNK for k in cut], pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array([float(n)] * len(cut)), pa.array([(flat[k : k + CHUNK] * np.float32(1)).tobytes() for k in cut], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["chunk", "part", "n", "weights"])

    def average(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["n"].to_numpy()
        total = sum(k * np.frombuffer(x, np.float32).astype(float) for k, x in zip(n, frame["weights"], strict=True)) / n.sum()
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "n": [n.sum()], "weights": [total.astype(np.float32).tobytes()]})

    kind = "chunk int, n double, weights binary"
    local = docs.select("doc_id", "text").mapInArrow(learn, "chunk int, part int, n double, weights binary")
    half = local.groupBy("chunk", F.pmod(F.xxhash64("part"), F.lit(64)).alias("part")).applyInPandas(lambda _, f: average(f), kind)
    found = half.groupBy("chunk").applyInPandas(average, kind).orderBy("chunk").collect()  # the weights, of fixed size
    return np.frombuffer(b"".join(r["weights"] for r in found), np.float32).copy() if found else None


def log_probs(model: dict[str, np.ndarray], v: Vocabulary, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conditional log-probability of each word given both sides, and the positions of words whose log(count) is still to be added."""
    found = np.empty(len(words), np.float32)
    inputs, cls, place = v.look(words)
    share = v.log_count[place] - v.log_total[cls]
    for k in range(0, len(words), 2048):
        at = np.arange(k, min(k + 2048, len(words)))
        z = hidden(model, contexts(inputs, doc, at, v.inputs - 1)) @ model["out"]
        z += model["out_bias"]
        own = z[np.arange(len(at)), cls[at]]
        np.exp(z, out=z)
        found[at] = own - np.log(z.sum(axis=1)) + share[at]
    return found, np.flatnonzero(place == len(v.words))


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, n_words, log_prob, mean_log_prob."""
    sc = docs.sparkSession.sparkContext
    counts = word_counts(docs).checkpoint()
    known = vocabulary_of(counts)
    vocabulary = sc.broadcast(known)
    flat = start(shapes_of(known.inputs, known.classes))
    for number in range(rounds):
        weights = sc.broadcast(flat)
        trained = train_round(docs, vocabulary, weights, number, rounds)
        flat = flat if trained is None else trained
    weights = sc.broadcast(flat)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        model = views(weights.value, shapes_of(v.inputs, v.classes))
        first = TaskContext.get().partitionId() << 40
        for ids, raw, off in slices(batches):
            w = Words(raw, off, lower=True)
            words = words_of(w)
            p, rare = log_probs(model, v, words, w.doc)
            total = np.bincount(w.doc, weights=p, minlength=len(ids)).astype(float)
            row, none = first + np.arange(len(ids)), pa.nulls(len(rare), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.nulls(len(ids), pa.int64()), pa.array(ids), pa.array(np.diff(w.at)), pa.array(total)], names=NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(row[w.doc[rare]]), pa.array(words[rare]), none, none, pa.nulls(len(rare), pa.float64())], names=NAMES)
            first += len(ids)

    rated = docs.select("doc_id", "text").mapInArrow(rate, "row bigint, word bigint, doc_id bigint, n_words bigint, log_prob double")
    # a document's own row meets no word: it keeps its place by its row number
    rated = rated.withColumn("key", F.coalesce("word", F.xxhash64("row")))
    found = rated.join(counts.select(F.col("word").alias("key"), "n"), "key", "left")
    added = F.when(F.col("word").isNull(), F.col("log_prob")).otherwise(F.log("n"))
    found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum(added).alias("log_prob"))
    return found.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", "log_prob", (F.col("log_prob") / F.greatest("n_words", F.lit(1))).alias("mean_log_prob"))
