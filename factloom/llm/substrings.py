"""Operator 3, substring dedup by difference-cover anchors.

Words at positions i of a document with i mod 7 in the difference cover {0, 1, 3} are anchors. For any two positions i
and j there is a shift k < 7 that makes both i + k and j + k anchors, so two equal windows of 13 words share an anchor
of 7 words inside them. First only anchors are hashed and those found twice are noted; then the 13-word windows around
noted anchors are hashed in full (96 bits), which extends the match; a window is a copy if a document with a smaller id
starts it too. Every word that a copy covers goes.

Defined cases: a null or empty text has no words; a null doc_id comes after all others; rows with the same doc_id are
one document's rows, and none is a copy of another; repeated rows give repeated results; ties cannot arise (the
smallest doc_id keeps a window); other columns are ignored, whatever their names; very long texts are processed whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as ex
from .common import table
from .textops import BYTES, Rolling, mix

PERIOD, COVER, WINDOW = 7, (0, 1, 3), 13
ANCHOR = WINDOW - PERIOD + 1
U64 = np.uint64
ROLL, ROLL2 = Rolling(606, 0), Rolling(707, 0)
IS_COVER = np.zeros(PERIOD, bool)
IS_COVER[list(COVER)] = True


class Words:
    """Word positions, hashes and documents of a batch."""

    def __init__(self, batch: ex.Batch):
        self.starts, self.ends, self.first = batch.texts.words()
        self.hash = BYTES.spans(batch.texts.data, self.starts, self.ends)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.left = np.repeat(self.first[1:], self.n) - np.arange(len(self.hash))  # words from here to the document's end

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of anchors in documents that have a window, and their keys: bucket above 32 bits of hash."""
        at = np.arange(len(self.hash))
        inside = at - self.first[self.doc] if len(at) else at
        at = at[IS_COVER[inside % PERIOD] & (self.left >= ANCHOR) & (self.n[self.doc] >= WINDOW)] if len(at) else at
        h = ROLL.windows(self.hash, ANCHOR)[at] if len(at) else np.zeros(0, U64)
        return at, ((h >> U64(32)) % U64(buckets)) << U64(32) | (h & U64(0xFFFFFFFF))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of hash of the windows that start at the positions."""
        a = np.zeros(len(at), U64)
        b = np.zeros(len(at), U64)
        other = mix(self.hash + U64(0x9E3779B97F4A7C15))
        for k in range(WINDOW):
            a = a * U64(ROLL2.base) + self.hash[at + k]
            b = b * U64(ROLL.base) + other[at + k]
        return mix(a), (mix(b) >> U64(32)).astype(np.uint32)


def _noted(words: Words, buckets: int, bits: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a noted anchor."""
    at, key = words.anchors(buckets)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    good = at[((count > 1) | (bits if len(bits) else np.zeros(len(count), bool)))[inverse]] if len(at) else at
    mark = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(mark, np.maximum(good - (PERIOD - 1), words.first[words.doc[good]] if len(good) else good), 1)
    np.add.at(mark, good + 1, -1)
    return np.flatnonzero((np.cumsum(mark)[:-1] > 0) & (words.left >= WINDOW))


def _entries(batch: ex.Batch, words: Words, starts: np.ndarray, buckets: int):
    """Distinct windows by (bucket, hashes), the first row that starts each, and each start's entry."""
    h, h2 = words.windows(starts)
    bucket = (h >> U64(32)) % U64(buckets)
    order = np.lexsort((starts, h2, h, bucket))
    h, h2, bucket = h[order], h2[order], bucket[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    entry = np.empty(len(h), np.int64)
    entry[order] = np.cumsum(new) - 1
    return bucket[new], h[new], h2[new], batch.ids[words.doc[starts[order][new]]], entry


def plan(docs: DataFrame, total: int | None = None):
    """The batches, the answers that they get, and the work on a batch: ids, n_words, n_removed, kept bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = ex.text_bytes(docs) if total is None else total
    # about 6 bytes a word: 3 of 7 words are anchors; a third of the words may start noted windows
    buckets = max(total // 6 * 3 // 7 // ex.BUCKET_KEYS, 4)
    batches = ex.batched(docs, total)

    def send_anchors(batch):
        _, key = Words(batch).anchors(buckets)
        key = np.unique(key)
        return ex.send(batch.b, key >> U64(32), [key.astype(np.uint32)])

    def judge_anchors(rows):
        n, (key,), rows = ex.receive(rows, [np.uint32])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        return ex.answer(rows, n, (count > 1)[inverse])

    def send_windows(batch, bits):
        words = Words(batch)
        bucket, h, h2, doc, _ = _entries(batch, words, _noted(words, buckets, bits), buckets)
        return ex.send(batch.b, bucket, [h, doc, h2])

    def judge_windows(rows):
        n, (h, doc, h2), rows = ex.receive(rows, [np.uint64, np.int64, np.uint32])
        order = np.lexsort((doc, h2, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        least = doc[order][new][np.cumsum(new) - 1]
        bits = np.empty(len(h), bool)
        bits[order] = least < doc[order]
        return ex.answer(rows, n, bits)

    noted = ex.ask(batches, send_anchors, judge_anchors, buckets)

    def with_both(batch, bits):
        """bits: first those of the anchors, then those of the windows."""
        words = Words(batch)
        _, key = words.anchors(buckets)
        k = len(np.unique(key))
        starts = _noted(words, buckets, bits[:k])
        _, _, _, least, entry = _entries(batch, words, starts, buckets)
        copy = starts[bits[k:][entry] | (least[entry] < batch.ids[words.doc[starts]])] if len(starts) else starts
        mark = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(mark, copy, 1)
        np.add.at(mark, copy + WINDOW, -1)
        gone = np.cumsum(mark)[:-1] > 0
        # kept words with the separator after each, which becomes a space; a word that ends its text has none
        data, size = batch.texts.data, len(batch.texts.data)
        after = words.ends < batch.texts.offsets[1:][words.doc]
        mark = np.zeros(size + 2, np.int8)
        mark[words.starts[~gone]] = 1
        np.subtract.at(mark, (words.ends + after)[~gone], 1)
        inside = np.cumsum(mark[:size], dtype=np.int8) > 0
        out = data.copy()
        out[words.ends[after]] = 32
        kept = out[inside].tobytes()
        cuts = np.concatenate([[0], np.cumsum(inside)])[batch.texts.offsets]
        texts = [kept[i:j].rstrip(b" ") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        removed = np.bincount(words.doc[gone], minlength=len(batch.ids)) if len(batch.ids) else np.zeros(0, np.int64)
        return batch.rows.column("doc_id"), words.n, removed, texts

    asked = ex.ask_again(batches, noted, send_windows, judge_windows)
    both = noted.union(asked.withColumn("bucket", F.col("bucket") + (1 << 40)))
    return batches, both, with_both


def removed(docs: DataFrame, total: int | None = None, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed and kept, or its digest."""
    batches, answers, work = plan(docs, total)

    def run(batch, bits):
        ids, n, gone, texts = work(batch, bits)
        last = pa.array([hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode("utf-8", "replace") for t in texts], pa.string())
        return pa.table([ids, pa.array(n.astype(np.int64)), pa.array(gone.astype(np.int64)), last], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return ex.finish(batches, answers, run, f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), digest=True)


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w WHERE len(words) >= 13)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM dup),
g2 AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
each AS (SELECT w.doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone USING (doc_id, p) WHERE gone.doc_id IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(g2.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN g2 USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
