"""Operator 5, toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its hashed words and word beginnings;
a document's is their noisy-or, 1 - prod(1 - p). The weights are learned from document labels alone, by full-batch
gradient steps on a bounded, documented sample (POSITIVES and NEGATIVES rows by hash order, weighted back to all labelled
rows). Then the sentences that carry a document's score can be located.

Defined cases: a null or empty text has no sentence and score 0; documents labelled more than once count with their
highest label; null labels do not count; if a class is missing all scores are 0; repeated rows give repeated results;
a score of the threshold itself counts as toxic; further columns are carried, but one named score is replaced; an empty
table gives an empty result; very long texts are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, pieces, table
from .textops import LOWER, Rolling, Texts

POSITIVES, NEGATIVES = 1500, 3000
BITS = 18
BEGIN = 6
"""Bytes of a word's beginning that make a second feature."""
STEPS, RATE, DECAY = 90, 0.15, 1e-4
LEAST = 5
"""Documents of the sample that must hold a feature for it to have a weight."""
THRESHOLD = 0.3
HASH = Rolling(505)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?\n"]] = True


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word its two features and its sentence (numbered over all texts), and the text of each sentence.

    Sentences are numbered without gaps, those without a word left out.
    """
    data = LOWER[texts.data]
    inside = LETTER[data]
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    prev = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    nxt = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~prev), np.flatnonzero(inside & ~nxt) + 1
    word = HASH.spans(data, starts, ends) >> np.uint64(64 - BITS)
    begin = (HASH.spans(data, starts, np.minimum(ends, starts + BEGIN)) >> np.uint64(64 - BITS)) + np.uint64(1 << BITS)
    border = STOP[data]
    border[texts.offsets[:-1][texts.offsets[:-1] < n]] = True
    raw = np.cumsum(border)[starts]
    new = np.concatenate([[True], raw[1:] != raw[:-1]]) if len(raw) else np.zeros(0, bool)
    sentence = np.cumsum(new) - 1
    owner = np.searchsorted(texts.offsets, starts[new], "right") - 1
    return word.astype(np.int64), begin.astype(np.int64), sentence, owner


@dataclass
class ToxicityModel:
    weights: np.ndarray | None  # float32, two tables of 2**BITS
    bias: float

    def sentences(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Logit and text of each sentence that has a word."""
        word, begin, sentence, owner = features(texts)
        if self.weights is None or not len(owner):
            return np.full(len(owner), -np.inf), owner
        v = self.weights[word] + self.weights[begin]
        some = np.flatnonzero(np.abs(v) > 1e-9)
        _, once = np.unique(sentence[some] << BITS | word[some], return_index=True)  # a word counts once in a sentence
        some = some[once]
        return np.bincount(sentence[some], v[some], len(owner)) + self.bias, owner

    def score(self, texts: Texts) -> np.ndarray:
        z, owner = self.sentences(texts)
        return -np.expm1(-np.bincount(owner, np.logaddexp(0, z), len(texts))) if len(z) else np.zeros(len(texts))


def train(word, begin, sentence, owner, label: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Adam on the weighted logistic loss of the noisy-or."""
    w = np.zeros(2 << BITS)
    both = np.concatenate([word, begin])
    pairs = np.unique(both.astype(np.int64) * len(label) + np.tile(owner[sentence], 2))
    enough = np.bincount(pairs // len(label), minlength=2 << BITS) >= LEAST
    del pairs
    used = np.unique(both)
    first, second = np.searchsorted(used, word).astype(np.int32), np.searchsorted(used, begin).astype(np.int32)
    del both
    v, n, docs = np.zeros(len(used)), len(owner), len(label)
    bias, m, s, mb, sb = -5.0, np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    weight = weight / weight.sum()
    for t in range(1, STEPS + 1):
        z = np.bincount(sentence, v[first] + v[second], n) + bias
        none = np.bincount(owner, np.logaddexp(0, z), docs)  # -log of the probability that no sentence is toxic
        p = -np.expm1(-none)
        # d loss / d none: 1 for a clean text, -(1 - p) / p for a toxic one
        slope = np.where(label == 1, -(1 - p) / np.maximum(p, 1e-6), 1.0) * weight
        g_z = slope[owner] / (1 + np.exp(-np.clip(z, -50, 50)))
        g = np.bincount(first, g_z[sentence], len(used)) + np.bincount(second, g_z[sentence], len(used)) + DECAY * v
        gb = g_z.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        v -= enough[used] * RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
        bias -= RATE * 0.3 * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-6)
    w[used] = np.where(enough[used], v, 0)
    return ToxicityModel(w.astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from docs (doc_id, text) that labels (doc_id, toxic) marks."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r.toxic): r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel(None, 0.0)
    def first(toxic: int, n: int) -> DataFrame:
        return known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    chosen = F.broadcast(first(1, POSITIVES).union(first(0, NEGATIVES)))  # no more rows than the sample has

    def rows(batches):
        for b in pieces(batches):
            t = Texts(b.column("text"))
            word, begin, sentence, owner = features(t)
            _, once = np.unique(sentence << BITS | word, return_index=True)
            word, begin, sentence = word[once], begin[once], sentence[once]
            cuts = np.searchsorted(owner[sentence], np.arange(len(t) + 1))
            own = [np.stack([word[i:j], begin[i:j], sentence[i:j]]).astype(np.int32).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(own, pa.binary())], ["doc_id", "toxic", "f"])

    sample = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(rows, "doc_id long, toxic int, f binary").collect()
    sample.sort(key=lambda r: r.doc_id)
    label = np.array([r.toxic for r in sample])
    parts = [np.frombuffer(r.f, np.int32).reshape(3, -1) for r in sample]
    del sample
    word, begin = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    sentence, owner, done = [], [], 0
    for d, p in enumerate(parts):
        if p.shape[1]:
            own = p[2] - int(p[2][0])
            sentence.append((own + done).astype(np.int32))
            owner.append(np.full(own[-1] + 1, d))
            done += int(own[-1]) + 1
    if len(set(label.tolist())) < 2 or not sentence:
        return ToxicityModel(None, 0.0)
    weight = np.where(label == 1, counts[1] / (label == 1).sum(), counts[0] / (label == 0).sum())
    return train(word, begin, np.concatenate(sentence), np.concatenate(owner), label, weight)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema if f.name.lower() != "score"]

    def run(batches):
        for b in pieces(batches, text):
            s = shared.value.score(Texts(b.column(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(s, pa.float64())], [*(f.name for f in keep), "score"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "score double"]))


def locate(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Offending sentences: doc_id, sentence (from 0, of those with a word), score, for scores of the threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in pieces(batches, text):
            z, owner = shared.value.sentences(Texts(b.column(text)))
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            at = np.arange(len(owner)) - np.searchsorted(owner, owner)
            hit = np.flatnonzero(p >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner[hit])), pa.array(at[hit], pa.int64()), pa.array(p[hit], pa.float64())], ["doc_id", "sentence", "score"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, sentence long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(fold(labels, 4) != 2))
    out = score(docs.select("doc_id", "text", (F.coalesce(fold(docs, 4), F.lit(-1)) == 2).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
