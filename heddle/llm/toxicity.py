"""Toxicity (5): a counterfactually regularised classifier.

A logistic model over the presence of words and word beginnings. Identity terms in labelled sentences are swapped for
others of their group, and the loss adds the squared change of the score; so a term by itself cannot move a score, and
neutral mentions of a group are not taken for abuse. Features are chosen by how far their rates in toxic and other
documents differ; counts are map-side sums, and only the chosen features of a bounded sample reach the driver.

Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1, at most about `SAMPLE` of them (the others of
a larger table are left out by hash). Texts only are scored.

Defined cases: null and empty texts get the model's base score; null labels are not learned from; a document labelled
more than once counts each time; without labels of both kinds every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Labelled rows that are learned from at most, as an expected number.
SAMPLE = 20_000
FEATURES = 4096
MIN_DOCS = 4
MIN_DEVIATIONS = 3.5
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6)
L2 = 3e-4
FAIRNESS = 4.0
STEPS = 400
#: Groups of identity terms; a term is swapped for the next of its group.
IDENTITY_GROUPS = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys", "children"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"), ("disabled", "blind", "deaf", "able-bodied"), ("old", "young", "elderly"),
    ("immigrants", "refugees", "natives", "citizens"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}
_EDGE = re.compile(r"^\W+|\W+$")
_SENTENCE = re.compile(r"(?<=[.!?\n])")
CACHE = 300_000


def features_of(word: str) -> tuple[int, ...]:
    """Of one run between blanks: its word and the word's beginnings."""
    w = _EDGE.sub("", word)
    if not w:
        return ()
    keys = ["=" + w, *["^" + w[:k] for k in BEGINNINGS if len(w) > k]]
    return tuple([int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(k)))) for k in keys])


def swapped(text: str) -> str | None:
    """The text with the identity terms of its sentences swapped; None if it has none."""
    out, hit = [], False
    for sentence in _SENTENCE.split(text.lower()):
        words = sentence.split()
        if any(_EDGE.sub("", w) in SWAP for w in words):
            hit = True
            sentence = " " + " ".join(SWAP.get(_EDGE.sub("", w), w) for w in words) + " "
        out.append(sentence)
    return "".join(out) if hit else None


class Featurizer:
    """The distinct features of a text, by a cache of words; chosen: keep these only, as their numbers."""

    def __init__(self, chosen: dict[int, int] | None = None):
        self.chosen, self.cache = chosen, {}

    def word(self, w: str) -> tuple[int, ...]:
        f = features_of(w)
        if self.chosen is not None:
            f = tuple([self.chosen[x] for x in f if x in self.chosen])
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[w] = f
        return f

    def __call__(self, text: str) -> set[int]:
        out: set[int] = set()
        get = self.cache.get
        for w in set(text.lower().split()):
            f = get(w)
            if f is None:
                f = self.word(w)
            if f:
                out.update(f)
        return out


class Model:
    def __init__(self, chosen: dict[int, int], weights: np.ndarray, bias: float, known: bool = True):
        self.chosen, self.weights, self.bias, self.known = chosen, weights, bias, known

    def scorer(self):
        find, weights, bias = Featurizer(self.chosen), self.weights.tolist(), self.bias

        def score(text: str | None) -> float:
            if not self.known:
                return 0.0
            x = bias + math.fsum([weights[k] for k in find(text or "")])
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

        return score


def fit(rows: list[tuple[int, list[int], list[int] | None]], n_features: int, fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """rows: label, features, and features of the swapped text. Full-batch Adam on the balanced logistic loss."""
    y = np.array([r[0] for r in rows], float)
    size = np.array([len(r[1]) for r in rows])
    doc, col = np.repeat(np.arange(len(rows)), size), np.array([k for r in rows for k in r[1]], np.int64)
    swaps = [(set(r[1]) - set(r[2]), set(r[2]) - set(r[1])) for r in rows if r[2] is not None]
    pair = np.array([i for i, (a, b) in enumerate(swaps) for _ in range(len(a) + len(b))], np.int64)
    pcol = np.array([k for a, b in swaps for k in (*sorted(a), *sorted(b))], np.int64)
    sign = np.array([s for a, b in swaps for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(doc, w[col], len(rows)) + b
        error = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.bincount(col, error[doc], n_features) + L2 * w
        if len(swaps):
            change = np.bincount(pair, sign * w[pcol], len(swaps))
            g += 2 * fairness / len(swaps) * np.bincount(pcol, sign * change[pair], n_features)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fairness: float = FAIRNESS) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic."""
    spark = docs.sparkSession
    store.ship(spark)
    store.small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out("doc_id"))
    n = known.count()
    part = min(1.0, sample / n) if n else 0.0
    known = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) < int(part * (1 << 30)))
    # The sample is bounded, so that it may be broadcast; the texts of the sample are then read once more.
    rows = store.keep(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id"), "toxic-sample")
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Model({}, np.zeros(0), 0.0, known=False)

    def counted(batches):
        find = Featurizer()
        for batch in batches:
            keys, toxic = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = find(text)
                keys += f
                toxic += [y] * len(f)
            distinct, at = np.unique(np.array(keys, np.int64), return_inverse=True)
            pos = np.bincount(at, toxic, len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(pos), pa.array(np.bincount(at, minlength=len(distinct)).astype(np.int64))], ["feature", "pos", "n"])

    n1, n0 = total[1], total[0]
    counts = rows.select("text", "toxic").mapInArrow(counted, "feature long, pos long, n long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).filter(F.col("n") >= MIN_DOCS)
    p, q = F.col("pos") / n1, (F.col("n") - F.col("pos")) / n0
    both = F.col("n") / (n1 + n0)
    z = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    identity = [f for t in SWAP for f in features_of(t)]
    top = counts.withColumn("z", z).filter((F.col("z") >= MIN_DEVIATIONS) | F.col("feature").isin(identity)).orderBy(F.col("feature").isin(identity).desc(), F.desc("z"), "feature").limit(FEATURES)
    chosen = {r["feature"]: k for k, r in enumerate(top.select("feature").collect())}

    def found(batches):
        find = Featurizer(chosen)
        for batch in batches:
            a, b = [], []
            for text in batch.column(0).to_pylist():
                a.append(sorted(find(text)))
                other = swapped(text)
                b.append(None if other is None else sorted(find(other)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))], ["toxic", "own", "swapped"])

    data = [(r[0], list(r[1]), None if r[2] is None else list(r[2])) for r in rows.select("text", "toxic").mapInArrow(found, "toxic int, own array<int>, swapped array<int>").collect()]
    data.sort(key=lambda r: (r[0], r[1], r[2] or []))
    weights, bias = fit(data, len(chosen), fairness)
    return Model(chosen, weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row; docs: doc_id, text."""
    store.ship(docs.sparkSession)
    store.small_batches(docs.sparkSession)

    def run(batches):
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
