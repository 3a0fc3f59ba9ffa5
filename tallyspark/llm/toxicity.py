"""Convolutional toxicity classifier (dealt operator 5).

A text's words are embedded by hashing: the vector of a word is the sum of the
table rows of the word, of its first and of its last letters, so words that
were never seen share what their parts taught.  Filters of several widths slide
over the words, each keeps its largest value over the whole text (max
pooling), and a linear layer gives the score.  Training is numpy with AdaGrad
inside Spark's tasks.

Every allowed labelled row is learnt from, whole: the odds of words by class
are counted over all of them, one pass goes over all of them, the scores of
all of them are scaled to probabilities, and per language a threshold is set
on all of them.  Only where the pass starts comes from a bounded sample:
``per_class`` rows of each class (parameters of ``Settings``), in the order of
a hash of their keys among rows of at most ``train_words`` words and
``train_bytes`` bytes, as words are counted at spaces only.

The score depends on the text alone: languages only choose thresholds.
Scoring reads whole texts of any length.  A null or empty text has one empty
window.  Labels other than 0 and 1 and rows without a label are not learnt
from.  If one class has no row, every score is the share of the other one (0.5
without labels).
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tallyspark.llm.common import arrow_batches, process_cache, shuffle_partitions, written

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
CUTOFF = 0.3


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    size: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    part: int = 4  # letters of a word's beginning and end
    epochs: int = 6  # at least; small samples are read until `steps` batches are done
    steps: int = 600
    batch: int = 32
    rate: float = 0.1
    decay: float = 1e-3
    hide: float = 0.9  # at most
    smooth: float = 3.0
    per_class: int = 1500
    train_words: int = 2000
    train_bytes: int = 1 << 15
    seed: int = 5


def word_rows(word: str, s: Settings) -> tuple[int, int, int]:
    """Table rows of a word, its beginning and its end; row 0 is padding and what has no letter or digit."""
    if not word:
        return 0, 0, 0
    data = word.encode()
    return tuple(1 + zlib.crc32(tag + part) % (s.buckets - 1) for tag, part in
                 ((b"w", data), (b"b", word[:s.part].encode()), (b"e", word[-s.part:].encode())))


class Words:
    """Table rows of words as they stand between white space; starts afresh when it is full."""

    def __init__(self, settings: Settings, limit: int = 400_000):
        self.settings, self.limit = settings, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.rows = np.zeros((1, 3), np.int64)

    def find(self, words: list[str]) -> np.ndarray:
        """Table rows of each word; case and the marks around a word don't count."""
        if len(self.number) > self.limit:
            self.clear()
        number = self.number
        new = [w for w in words if w not in number]
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new))))
            self.rows = np.concatenate([self.rows, [word_rows(EDGES.sub("", w.lower()), self.settings) for w in new]])
        return self.rows[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]

    def texts(self, texts: Iterable[str]):
        """Table rows of the distinct words (the first: padding), the words of all texts as numbers of those
        with padding after each text, the texts' first places, and their numbers of windows."""
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = lists.flatten().dictionary_encode()
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        pad = max(self.settings.widths)
        starts = np.cumsum(sizes + pad) - sizes - pad
        # one place more, so that the last text has all its windows too
        words = np.zeros(int((sizes + pad).sum()) + 1, np.int64)
        words[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)) * pad, sizes)] = numbered.indices.to_numpy() + 1
        rows = np.concatenate([np.zeros((1, 3), np.int64), self.find(list(dict.fromkeys(numbered.dictionary.to_pylist())))])
        return rows, words, starts, sizes + 1


class Model:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.table = rng.normal(0, 0.1, (s.buckets, s.size)).astype(np.float32)
        self.table[0] = 0
        self.taps = [rng.normal(0, 0.3, (w, s.size, s.filters)).astype(np.float32) for w in s.widths]
        self.offsets = [np.zeros(s.filters, np.float32) for _ in s.widths]
        self.out = np.abs(rng.normal(0, 0.3, len(s.widths) * s.filters)).astype(np.float32)
        self.bias = -2.0
        self.scale, self.shift, self.thresholds, self.constant = 1.0, 0.0, {}, None
        self.counts = None
        self.seen = {"table": np.full(s.buckets, 1e-3, np.float32), "out": np.full(len(self.out), 1e-3), "bias": 1e-3}
        self.seen |= {f"tap{k}": np.full(t.shape, 1e-3, np.float32) for k, t in enumerate(self.taps)}

    def windows(self, vectors: np.ndarray, words: np.ndarray, tap: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """By filter, its value on the window that starts at each word (the last windows lack their end)."""
        n = len(words) - len(tap) + 1
        out = np.take((vectors @ tap[0] + offset).T, words[:n], axis=1)
        for j in range(1, len(tap)):
            out += np.take((vectors @ tap[j]).T, words[j:n + j], axis=1)
        return out

    def pooled(self, vectors, words, starts, sizes, places: bool = False):
        """Largest filter values of each text, and their places if asked for."""
        edges = np.stack([starts, starts + sizes], 1).ravel()
        values, at = [], []
        for tap, offset in zip(self.taps, self.offsets):
            x = self.windows(vectors, words, tap, offset)
            if places:
                at.append(np.stack([a + x[:, a:a + n].argmax(1) for a, n in zip(starts, sizes)]))
                values.append(np.take_along_axis(x, at[-1].T, 1).T)
            else:
                values.append(np.maximum.reduceat(x, np.minimum(edges, x.shape[1] - 1), axis=1)[:, ::2].T)
        return np.maximum(np.concatenate(values, 1), 0), at

    def logits(self, rows: np.ndarray, words, starts, sizes) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        return self.pooled(self.table[rows].sum(1), words, starts, sizes)[0] @ self.out + self.bias

    def count(self, rows, words, starts, sizes, labels: np.ndarray) -> np.ndarray:
        """By class (0, 1) and table row, the number of texts that hold it."""
        out = np.zeros((2, self.s.buckets), np.int64)
        for a, n, y in zip(starts, sizes, labels):
            out[int(y)][np.unique(rows[words[a:a + n - 1]])] += 1
        return out

    def start_from_odds(self, counts: np.ndarray, texts: np.ndarray) -> None:
        """Give the first dimension of the table the log odds of its rows, and to a filter of each width the task to read it.

        ``counts`` and ``texts`` are by class.  Max pooling only teaches the window
        that wins; words that start low in every filter would never be learnt.
        """
        a = self.s.smooth
        odds = np.log((counts[1] + a) / (texts[1] + 2 * a)) - np.log((counts[0] + a) / (texts[0] + 2 * a))
        odds[counts.sum(0) == 0] = 0
        self.table[:, 0] = 0.2 * np.maximum(odds, 0)
        self.table[0] = 0
        for k, tap in enumerate(self.taps):
            tap[:, :, 0], tap[:, 0, 0] = 0, 1
            self.out[k * self.s.filters] = 1

    def train(self, texts: list[str], labels: np.ndarray) -> None:
        """Start weights from a list of texts, read several times."""
        s = self.s
        rng, book = np.random.default_rng(s.seed + 1), Words(s, 1 << 40)
        sample = book.texts(texts)
        if self.counts is None:
            n1 = int(labels.sum())
            self.counts = self.count(*sample, labels), np.array([len(labels) - n1, n1])
        self.start_from_odds(*self.counts)
        batches = max(1, len(texts) // s.batch)
        epochs = max(s.epochs, s.steps // batches)
        for epoch in range(epochs):
            for chosen in np.array_split(rng.permutation(len(texts)), batches):
                self.step(*sample, labels, chosen, s.rate * (1 - epoch / epochs), rng)

    def step(self, rows, flat, starts, sizes, labels: np.ndarray, chosen: np.ndarray, rate: float, rng) -> None:
        """One step of AdaGrad on the chosen texts."""
        s, seen, pad = self.s, self.seen, max(self.s.widths)
        parts = [flat[starts[i]:starts[i] + sizes[i] - 1 + pad] for i in chosen]
        words, size = np.concatenate(parts), sizes[chosen]
        # other words are hidden each time, so that every one of a text's telling words is learnt
        hide = np.repeat(rng.uniform(0, s.hide, len(parts)), [len(p) for p in parts])
        words = np.where(rng.random(len(words)) < hide, 0, words)
        start = np.cumsum([0] + [len(p) for p in parts[:-1]])
        used, words = np.unique(words, return_inverse=True)
        vectors = self.table[rows[used]].sum(1)
        pooled, at = self.pooled(vectors, words, start, size, places=True)
        p = 1 / (1 + np.exp(-(pooled @ self.out + self.bias)))
        g = (p - labels[chosen]) / len(chosen)
        inner = g[:, None] * self.out * (pooled > 0)
        grad = pooled.T @ g + s.decay * self.out
        seen["out"] += grad ** 2
        # windows speak for toxicity or not at all: much clean text beside it is no excuse
        self.out = np.maximum(self.out - rate * grad / np.sqrt(seen["out"]), 0).astype(np.float32)
        seen["bias"] += g.sum() ** 2
        self.bias -= rate * g.sum() / np.sqrt(seen["bias"])
        down = np.zeros_like(vectors)
        for k, tap in enumerate(self.taps):
            h = inner[:, k * s.filters:(k + 1) * s.filters]
            change = np.zeros_like(tap)
            for j in range(len(tap)):
                w = words[at[k] + j]
                change[j] = np.einsum("nf,nfd->df", h, vectors[w])
                np.add.at(down, w, h[..., None] * tap[j].T)
            change += s.decay * tap
            seen[f"tap{k}"] += change ** 2
            self.taps[k] = tap - rate * change / np.sqrt(seen[f"tap{k}"])
            self.offsets[k] -= (rate * h.sum(0)).astype(np.float32)
        touched = np.flatnonzero(np.abs(down).sum(1) > 0)
        to = rows[used[touched]]
        step = np.repeat(down[touched], 3, axis=0)
        to = to.ravel()
        np.add.at(seen["table"], to, (step ** 2).mean(1))
        np.add.at(self.table, to, -rate * step / np.sqrt(seen["table"][to])[:, None])
        self.table[0] = 0

    def raw(self, texts: list[str], book: Words | None = None) -> np.ndarray:
        book = book or Words(self.s)
        return self.logits(*book.texts(texts))

    def scores(self, texts: list[str], book: Words | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = np.clip(self.scale * self.raw(texts, book) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))

    def calibrate(self, texts: list[str], labels: np.ndarray, langs: list[str | None]) -> None:
        """Scale scores to probabilities, and set each language's threshold where most rows are right.

        ``toxicity.calibrate`` does the same with Spark; this one is its cross-check in the tests."""
        z, prior = self.raw(texts), 3.0
        a, b, n1 = 1.0, 0.0, labels.sum()
        # targets drawn in from 0 and 1, so that separable rows give finite scales
        target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - target) * z).sum(), (p - target).sum()])
            hess = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -prior, prior)
        if np.isfinite([a, b]).all() and a > 0:
            self.scale, self.shift = float(a), float(b)
        p = self.scores(texts)
        for lang in sorted({x for x in langs if x is not None}):
            mine = np.array([x == lang for x in langs])
            if labels[mine].sum() >= 10:
                tried = np.linspace(0.05, 0.95, 91)
                right = np.array([((p[mine] >= t) == (labels[mine] == 1)).sum() for t in tried])
                best = tried[right == right.max()]
                self.thresholds[lang] = float(best[np.argmin(np.abs(best - CUTOFF))])

    def numbers(self) -> np.ndarray:
        """All weights as rows as wide as the table: its own, then the others."""
        rest = np.concatenate([x.ravel() for x in (*self.taps, *self.offsets, self.out, np.array([self.bias]))])
        rest = np.pad(rest, (0, -len(rest) % self.s.size))
        return np.concatenate([self.table.astype(np.float64), rest.reshape(-1, self.s.size)])

    def take(self, numbers: np.ndarray) -> None:
        """Take all weights from ``numbers``."""
        self.table = numbers[:self.s.buckets].astype(np.float32)
        rest, at = numbers[self.s.buckets:].ravel(), 0
        for x in (*self.taps, *self.offsets, self.out):
            x[...] = rest[at:at + x.size].reshape(x.shape)
            at += x.size
        self.bias = float(rest[at])

    def plain(self) -> "Model":
        """The model without what only training needs."""
        out = copy.copy(self)
        out.counts, out.seen = None, {}
        return out


def in_order(key: Column) -> Column:
    """A fixed mixed order of keys, in which samples are taken."""
    return F.xxhash64(key.cast("string"), F.lit("toxicity"))


def labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Every row with a label, whole: ``(doc_id, text, lang, toxic)``."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(marks, "doc_id")


def dealt(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``labelled`` in a mixed order, dealt by a hash of the keys; texts are shuffled once, before the join.

    Who reads it more than once keeps it on the executors' disks meanwhile (``learn``).
    """
    docs = docs.repartition(shuffle_partitions(docs.sparkSession), "doc_id")
    return labelled(docs, marks).select("doc_id", "text", "toxic").sortWithinPartitions(in_order(F.col("doc_id")), "doc_id", "text")


def marks_of(labels: DataFrame, allowed: Column | None) -> DataFrame:
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    return written((marks if allowed is None else marks.filter(allowed)).dropDuplicates(["doc_id"]), "marks")


def groups(batches: Iterable[pa.RecordBatch], size: int = 1 << 20):
    """Texts and labels of at most ``size`` characters at a time, or one text."""
    texts, labels, held = [], [], 0
    for batch in batches:
        for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            if texts and held + len(t) > size:
                yield texts, np.array(labels, np.float64)
                texts, labels, held = [], [], 0
            texts.append(t)
            labels.append(y)
            held += len(t)
    if texts:
        yield texts, np.array(labels, np.float64)


def class_counts(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """By class, the texts that hold each table row, and all texts; counted over every labelled row."""
    s = model.s

    def run(batches):
        book, counts, texts = Words(s), np.zeros((2, s.buckets), np.int64), np.zeros(2, np.int64)
        for some, y in groups(batches):
            counts += model.count(*book.texts(some), y)
            texts += [int((y == 0).sum()), int((y == 1).sum())]
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), *[pa.array(np.append(c[at], n)) for c, n in zip(counts, texts)]],
                                         ["at", "clean", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(run, "at long, clean long, toxic long").groupBy("at").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    at, *both = [found.column(c).to_numpy() for c in ("at", "clean", "toxic")]
    out = np.zeros((2, s.buckets + 1), np.int64)
    for side, n in zip(out, both):
        side[at] = n
    return out[:, :-1], out[:, -1]


def teach(rows: DataFrame, model: Model) -> None:
    """One pass of the model over every labelled row (``dealt``).

    Each task goes on from the same weights.  A weight becomes the mean over the tasks that
    moved it, which Spark computes: the driver gets one set of weights.
    """
    spark, s = rows.sparkSession, model.s
    shared = spark.sparkContext.broadcast(model)
    names = [f"d{i}" for i in range(s.size)]

    def run(batches):
        model = copy.deepcopy(shared.value)
        before, book, rng = model.numbers(), Words(s), np.random.default_rng(s.seed + 2)
        for texts, y in groups(batches):
            sample = book.texts(texts)
            for chosen in np.array_split(np.arange(len(texts)), -(-len(texts) // s.batch)):
                model.step(*sample, y, chosen, s.rate / 2, rng)
        moved = model.numbers() - before
        at = np.flatnonzero(moved.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(c) for c in np.ascontiguousarray(moved[at].T)]], ["at", *names])

    moved = rows.select("text", "toxic").mapInArrow(run, ", ".join(["at long", *[f"{c} double" for c in names]])).groupBy("at").agg(
        *[F.avg(c).alias(c) for c in names]).toArrow()
    numbers = model.numbers()
    numbers[moved.column("at").to_numpy()] += np.stack([moved.column(c).to_numpy() for c in names], axis=1)
    model.take(numbers)


def calibrate(rows: DataFrame, model: Model) -> None:
    """Scale the scores of all ``rows (z, toxic, lang)`` to probabilities, and set each language's threshold
    where most rows are right.  Only sums reach the driver: a few for each step, and 92 counts a language."""
    n0, n1 = [int(x or 0) for x in rows.agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).first()]
    if not n0 or not n1:
        return
    # targets drawn in from 0 and 1, so that separable rows give finite scales
    target = F.when(F.col("toxic") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
    z, a, b, prior = F.col("z"), 1.0, 0.0, 3.0
    for _ in range(60):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * z + b))))
        at = rows.select(z, p.alias("p"), target.alias("t")).withColumn("w", F.expr("p * (1 - p) + 1e-9"))
        g0, g1, h0, h1, h2 = at.agg(*[F.expr(f"sum({x})") for x in ("(p - t) * z", "p - t", "w * z * z", "w * z", "w")]).first()
        move = np.clip(np.linalg.solve(np.array([[h0, h1], [h1, h2]]) + 1e-6 * np.eye(2), [g0, g1]), -prior, prior)
        a, b = float(a - move[0]), float(b - move[1])
        if np.abs(move).max() < 1e-7:
            break
    if np.isfinite([a, b]).all() and a > 0:
        model.scale, model.shift = a, b
    tried = [float(t) for t in np.linspace(0.05, 0.95, 91)]
    beyond = F.size(F.filter(F.array(*map(F.lit, tried)), lambda t: F.col("p") >= t))
    binned = rows.filter("lang is not null").select("lang", "toxic", probability(model, z).alias("p")).groupBy("lang", beyond.alias("beyond")).agg(
        F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    # clean rows below and toxic rows from each threshold on, and the languages with ten toxic rows
    right = binned.groupBy("lang").agg(F.sum("toxic").alias("n"), *[
        F.sum(F.when(F.col("beyond") > i, F.col("toxic")).otherwise(F.col("clean"))).alias(f"t{i}") for i in range(len(tried))])
    for row in right.filter("n >= 10").collect():
        score = np.array(row[2:])
        best = np.array(tried)[score == score.max()]
        model.thresholds[row["lang"]] = float(best[np.argmin(np.abs(best - CUTOFF))])


def learn(docs: DataFrame, marks: DataFrame, settings: Settings) -> Model:
    """The weights: counts and a pass over every labelled row, from the start that a bounded sample gives."""
    arrow_batches(docs.sparkSession)
    # texts meet their labels once: what is counted stays on disk for the pass
    rows = dealt(docs, marks).persist(StorageLevel.DISK_ONLY)
    try:
        return learn_dealt(rows, docs, marks, settings)
    finally:
        rows.unpersist(blocking=True)


def learn_dealt(rows: DataFrame, docs: DataFrame, marks: DataFrame, settings: Settings) -> Model:
    """``learn`` from ``rows``, which are ``dealt(docs, marks)``."""
    spark, s = docs.sparkSession, settings
    model = Model(s)
    model.counts = class_counts(rows, model)
    texts = model.counts[1]
    if not texts.all():
        model.constant = float(texts[1] / texts.sum()) if texts.sum() else 0.5
    order = in_order(F.col("doc_id"))
    # twice as many as wanted, as long texts are left out of the start; bounded by a parameter
    picked = [[(r["doc_id"], r["toxic"]) for r in marks.filter(f"toxic = {c}").orderBy(order, "doc_id").limit(2 * s.per_class).collect()]
              for c in (0, 1)]
    ids = spark.createDataFrame([(i,) for p in picked for i, _ in p], "doc_id long")
    whole = F.coalesce("text", F.lit(""))
    short = (F.octet_length(whole) <= s.train_bytes) & (F.size(F.split(whole, " ")) <= s.train_words)
    text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").filter(short).join(F.broadcast(ids), "doc_id")
            .dropDuplicates(["doc_id"]).collect()}
    train = [(i, t) for p in picked for i, t in [x for x in p if x[0] in text][:s.per_class]]
    if model.constant is not None:
        return model
    if train:
        model.train([text[i] for i, _ in train], np.array([t for _, t in train], np.float64))
    else:
        model.start_from_odds(*model.counts)
    teach(rows, model)
    return model


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), allowed: Column | None = None) -> Model:
    """Train on ``labels (doc_id, toxic)``; ``allowed`` (on ``doc_id``) says which rows may be learnt from."""
    marks = marks_of(labels, allowed)
    model = learn(docs if allowed is None else docs.filter(allowed), marks, settings).plain()
    if model.constant is None:
        calibrate(written(with_raw(labelled(docs, marks), model).select("z", "toxic", "lang"), "raw"), model)
    return model


def fit_scored(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), allowed: Column | None = None,
               column: str = "score", keep: Sequence[str] | None = None) -> tuple[DataFrame, Model]:
    """``docs`` (the columns ``keep``) with scores, and the model of ``fit``: texts are scored once, for calibration and result."""
    keep = docs.columns if keep is None else list(keep)
    marks = marks_of(labels, allowed)
    model = learn(docs if allowed is None else docs.filter(allowed), marks, settings).plain()
    if model.constant is not None:
        return docs.select(*keep).withColumn(column, F.lit(model.constant)), model
    rows = written(with_raw(docs, model, "__raw").select("doc_id", *[c for c in dict.fromkeys(["lang", *keep]) if c != "doc_id"], "__raw"), "raw")
    calibrate(written(rows.join(marks, "doc_id").select(F.col("__raw").alias("z"), "toxic", "lang"), "marked"), model)
    return rows.select(*keep, probability(model, F.col("__raw")).alias(column)), model


def with_raw(docs: DataFrame, model: Model, column: str = "z", text: str = "text") -> DataFrame:
    """``docs`` with the unscaled score of each whole text, without a shuffle.

    The model's size is fixed by its settings (a few MB), so it is broadcast.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        cache = process_cache("toxicity")
        model = shared.value
        book = cache.setdefault(("toxicity", model.s), Words(model.s))
        texts = [t or "" for t in texts.to_pylist()]
        out, group, size = [], [], 0
        for i, t in enumerate(texts):
            group.append(t)
            size += len(t)
            if size > 1 << 20 or i + 1 == len(texts):
                out.append(model.raw(group, book))
                group, size = [], 0
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(column, run(text))


def probability(model: Model, raw: Column) -> Column:
    """The score of ``Model.scores`` from the unscaled one."""
    if model.constant is not None:
        return F.lit(model.constant)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.scale * raw + model.shift))))


def scored(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, without a shuffle."""
    if model.constant is not None:
        return docs.withColumn(column, F.lit(model.constant))
    return with_raw(docs, model.plain(), column, text).withColumn(column, probability(model, F.col(column)))


def threshold(model: Model, lang: Column, default: float = CUTOFF) -> Column:
    out = F.lit(float(default))
    for name, value in model.thresholds.items():
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out
