"""Operator 7, language ID by a string kernel.

Blended-spectrum kernel on presence: k(x, z) = |N(x) & N(z)| / sqrt(|N(x)| |N(z)|), where N(x) is the set of hashed
2-, 3- and 4-byte n-grams of the whole text (ASCII letters in lower case). Nystroem landmarks are labelled documents,
equally many of each language; one-versus-rest kernel ridge regression is fitted in the landmarks' space on a bounded,
documented sample (SAMPLE rows per language by hash order, fewer if there are many languages: ROWS in all, but one row of
every language). Scoring is two batched matrix products: presence rows by landmarks, similarities by weights.

Long texts would fill the hashed space, so a text of more than PART bytes is dealt into equal parts: its scores are the
mean of theirs, and as a row of the fit it has the n-grams that at least half of its parts hold.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text if nothing could be learned;
ties go to the language that sorts first; repeated rows give repeated results (and count once in the fit); further columns
are carried unless they are named like an output, which replaces them; an empty table gives an empty result; very long
texts are read whole, part by part.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fold, pieces, small_batches, table
from .textops import LOWER, Texts, ranges

BITS = 13
DIM = 1 << BITS
SAMPLE = 400
LANDMARKS = 48
"""Per language: labelled rows of the fit, and those of them that are landmarks."""
ROWS = 4800
"""Rows of the fit over all languages; every language has one at least."""
RIDGE = 0.05
SHARPNESS = 4.0
BLOCK = 1 << 20
PART = 1 << 14
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
FACTORS = {2: np.uint32(2654435761), 3: np.uint32(2246822519), 4: np.uint32(3266489917)}


class Parts:
    """The parts of texts: data and offsets as those of Texts, the text that owns each, and where its last n-gram ends."""

    def __init__(self, texts: Texts):
        size = np.diff(texts.offsets)
        count = np.maximum(-(-size // PART), 1)
        self.data, self.owner = texts.data, np.repeat(np.arange(len(size)), count)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.offsets = np.append(texts.offsets[self.owner] + size[self.owner] * ranges(np.zeros_like(count), count) // count[self.owner], texts.offsets[-1])
        self.ends = np.minimum(self.offsets[1:] + 3, texts.offsets[1:][self.owner])  # n-grams over a cut belong to the part they begin in

    def __len__(self) -> int:
        return len(self.owner)


def presence(parts: Parts, lo: int, hi: int) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams the parts lo..hi-1 hold."""
    out = np.zeros((hi - lo) * DIM, np.uint8)
    a, z = int(parts.offsets[lo]), int(parts.offsets[hi])
    while a < z:
        b = min(a + BLOCK, z)
        n = b - a
        seg = LOWER[parts.data[a : b + 3]]
        pad = np.zeros(n + 3, np.uint32)
        pad[: len(seg)] = seg
        four = pad[:-3] << 24 | pad[1:-2] << 16 | pad[2:-1] << 8 | pad[3:]
        row = np.repeat(np.arange(hi - lo), np.diff(np.clip(parts.offsets[lo : hi + 1], a, b)))
        end = parts.ends[lo:hi][row]
        at = np.arange(a, b)
        for k, factor in FACTORS.items():
            ok = at + k <= end
            code = ((four >> np.uint32(8 * (4 - k))) * factor) >> np.uint32(32 - BITS)
            out[(row * DIM + code)[ok]] = 1
        a = b
    return out.reshape(hi - lo, DIM)


def typical(parts: Parts, text: int) -> np.ndarray:
    """The n-grams that at least half of the text's parts hold."""
    lo, hi = int(parts.first[text]), int(parts.first[text + 1])
    held = sum(presence(parts, a, min(a + 64, hi)).sum(0, dtype=np.int64) for a in range(lo, hi, 64))
    return 2 * held >= hi - lo


def row_blocks(texts: Parts, rows: int = 256, size: int = 1 << 20):
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(texts.offsets, texts.offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + rows, len(texts))
        yield i, j
        i = j


def has_letter(texts: Texts) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(LETTERS[texts.data])])
    out = sums[texts.offsets[1:]] > sums[texts.offsets[:-1]]
    for i in np.flatnonzero(~out):
        raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
        if len(raw) and raw.max() >= 128:
            out[i] = any(unicodedata.category(c)[0] == "L" for c in raw.tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class LanguageModel:
    names: list[str]
    landmarks: np.ndarray  # DIM x m, each column divided by the root of its size
    weights: np.ndarray  # m x languages
    bias: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        size = np.maximum(x.sum(1, keepdims=True), 1)
        return (x @ self.landmarks) / np.sqrt(size) @ self.weights + self.bias

    def classify(self, texts: Texts) -> tuple[list[str], np.ndarray]:
        letter = has_letter(texts)
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, score
        parts = Parts(texts)
        s = np.zeros((len(texts), len(self.names)))
        for i, j in row_blocks(parts):
            np.add.at(s, parts.owner[i:j], self.scores(presence(parts, i, j)))
        s *= SHARPNESS / np.diff(parts.first)[:, None]
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        for k in np.flatnonzero(letter):
            names[k], score[k] = self.names[best[k]], float(p[k, best[k]])
        return names, score


def share(languages: int) -> int:
    """Rows of the fit for each of so many languages."""
    return max(min(SAMPLE, ROWS // max(languages, 1)), 1)


def solve(names: list[str], labels: np.ndarray, rows: np.ndarray) -> LanguageModel:
    """Kernel ridge regression on presence rows; labels are positions in names."""
    x = rows.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    marks = np.concatenate([np.flatnonzero(labels == k)[: max(LANDMARKS * share(len(names)) // SAMPLE, 1)] for k in range(len(names))])
    z = x[marks]
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = (x @ z.T) @ root
    mean = phi.mean(0)
    phi = phi - mean
    target = np.where(labels[:, None] == np.arange(len(names)), 1.0, -1.0)
    level = target.mean(0)
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(x) / 100 * np.eye(phi.shape[1]), phi.T @ (target - level))
    weights = root @ w
    return LanguageModel(names, np.ascontiguousarray(z.T.astype(np.float32)), weights.astype(np.float32), (level - mean @ w).astype(np.float32))


def fit(docs: DataFrame) -> LanguageModel:
    """Fit on text and lang of docs (doc_id, text, lang); rows with a null lang or doc_id do not count."""
    small_batches(docs.sparkSession)
    labelled = docs.filter("lang is not null and doc_id is not null").select("doc_id", "lang")
    known = cut(labelled.groupBy("lang").agg(F.count("*").alias("n")))  # one row per language
    most = share(known.count())
    # rows are thinned by a hash of their own first, so that the ranking sees about twice the rows it keeps of a language
    key = F.xxhash64("doc_id")
    near = labelled.join(F.broadcast(known), "lang").filter(F.pmod(key, F.lit(1 << 30)) * F.col("n") < F.lit((2 * most + 64) << 30)).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(key, F.lit(1 << 30)), "doc_id"))
    chosen = near.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("_n", rank).filter(F.col("_n") <= most)

    def rows(batches):
        for b in pieces(batches):
            parts = Parts(Texts(b.column("text")))
            bits = [np.packbits(typical(parts, k)).tobytes() for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(bits, pa.binary())], ["doc_id", "lang", "bits"])

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "lang")), "doc_id").mapInArrow(rows, "doc_id long, lang string, bits binary").dropDuplicates(["doc_id"]).collect()
    sample.sort(key=lambda r: (r.lang, r.doc_id))
    names = sorted({r.lang for r in sample})
    if not names:
        return LanguageModel([], np.zeros((DIM, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    bits = np.unpackbits(np.frombuffer(b"".join(r.bits for r in sample), np.uint8)).reshape(len(sample), DIM)
    return solve(names, np.array([names.index(r.lang) for r in sample]), bits)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema if f.name.lower() not in ("lang_pred", "score")]

    def run(batches):
        for b in pieces(batches, text):
            names, score = shared.value.classify(Texts(b.column(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*(f.name for f in keep), "lang_pred", "score"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "lang_pred string, score double"]))


def accepted(docs: DataFrame, model: LanguageModel, least: float, text: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose text has a letter and a language with a score of `least` or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in pieces(batches, text):
            names, score = shared.value.classify(Texts(b.column(text)))
            yield b.filter(pa.array([n != "und" and s >= least for n, s in zip(names, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold(docs, 5) != 0))
    return predict(docs.select("doc_id", "text", (F.coalesce(fold(docs, 5), F.lit(-1)) == 0).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
