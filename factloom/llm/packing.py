"""Operator 6, packing by lexical retrieval.

Each document is its ids and an end id. Documents of a window or more give whole windows; what is left of every document
is an item to pack. Items are dealt to shards by content: of the TELLING terms of the highest BM25 weight
that other documents hold too, the one that hashes lowest decides the place (if many documents hold it, one of several
places), the next one the order there, and a shard is a run of items in that order. So the result does not depend on files or their order. Each shard has a BM25
inverted index over its items (terms are ids, of the whole document; document frequencies and the mean length are the
corpus's). The first unused item seeds a window, the index looks up all its terms and returns its unused neighbours best
first, and they fill the window; the one that does not fit is cut, and its rest seeds the next window. The rest of a task's
last shard is cut into powers of two, which need no padding.

Ids are encoded once, written to the shared folder, and read again for packing, so that the document frequencies (a table
of the vocabulary's size, which the data cannot grow) are known by then. Only items are shuffled.

Defined cases: a null or empty text is the end id alone; a null doc_id is carried; repeated rows are packed each for
itself; ties in BM25 go to the earlier item of the shard; other columns are ignored, whatever their names; an empty table
gives an empty result; a very long text is cut into windows, and all of it is indexed.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, automaton, blocks
from .common import pieces, small_batches, stored, table
from .textops import give_back, mix, ranges

WINDOW = 1024
SHARD, SHARD_IDS = 512, 1 << 19
"""Items of a shard, and ids of their documents; the first that is reached ends it."""
TELLING = 16
"""Terms of the highest weight among which an item's place is drawn (by hash, so like items draw alike)."""
PLACE = 1024
"""A term that more documents hold than this deals them to more than one place."""
K1, B = 1.2, 0.75


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """Words are merged by the library of the rank file's format, whose results are those of the merges."""
    import tiktoken

    a = automaton(path)
    ranks = {b: i for i, b in a.plain.items()}
    core = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def many(words):
        ids = [core.encode_single_piece(w) for w in words]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    return Encoder(a.special, many)


def encoded(docs: DataFrame, path: str, end: int, vocabulary: int) -> DataFrame:
    """Rows (doc_id, ids binary of unsigned 16- or 32-bit numbers, null) and, for each task, (null, null, document frequencies)."""
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(batches):
        own = _encoder(path)
        df = np.zeros(vocabulary, np.int64)
        for b in pieces(batches):
            texts = ["" if x is None else x for x in b.column("text").to_pylist()]
            for i, j in blocks(texts):
                flat, first = own.ids(texts[i:j])
                rows = np.repeat(np.arange(j - i), np.diff(first))
                pairs = np.unique(rows * vocabulary + flat)
                df += np.bincount(pairs % vocabulary, minlength=vocabulary)
                ids = [np.append(flat[first[k] : first[k + 1]], end).astype(kind).tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(ids, pa.binary()), pa.nulls(j - i, pa.binary())], ["doc_id", "ids", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([df.astype(np.int64).tobytes()], pa.binary())], ["doc_id", "ids", "df"])
        own.reset()  # the worker outlives the task
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, df binary")


def _frequencies(parts: DataFrame, vocabulary: int) -> np.ndarray:
    """Sum of the tasks' document frequencies, partly on the executors: one array of the vocabulary's size."""

    def add(batches):
        out = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column("df"):
                out += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["df"])

    rows = parts.filter("df is not null").select("df").mapInArrow(add, "df binary").coalesce(8).mapInArrow(add, "df binary").collect()
    return sum((np.frombuffer(r.df, np.int64) for r in rows), np.zeros(vocabulary, np.int64))


class Corpus(NamedTuple):
    """What shards know of all documents: arrays of the vocabulary's size, and the mean length."""

    df: np.ndarray
    idf: np.ndarray
    mean: float

    @classmethod
    def of(cls, df: np.ndarray, n: int, ids: int) -> Corpus:
        return cls(df, np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), max(ids / max(n, 1), 1.0))

    def weight(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))).astype(np.float32)


class Shard:
    """BM25 inverted index over items: for each the distinct terms of its document, how often it has them, its length."""

    def __init__(self, profiles: list[tuple[np.ndarray, np.ndarray, int]], corpus: Corpus):
        n = len(profiles)
        sizes = np.array([len(t) for t, _, _ in profiles])
        term, tf, owner = np.concatenate([t for t, _, _ in profiles]).astype(np.int64), np.concatenate([c for _, c, _ in profiles]), np.repeat(np.arange(n), sizes)
        weight = corpus.weight(term, tf, np.array([x for _, _, x in profiles])[owner])
        _, code, count = np.unique(term, return_inverse=True, return_counts=True)
        shared = count[code] > 1  # postings of one item find no other
        code, owner, weight = code[shared], owner[shared], weight[shared]
        self.begin = np.searchsorted(owner, np.arange(n + 1))
        self.query = code
        by = np.argsort(code, kind="stable")
        self.owner, self.weight, self.first = owner[by], weight[by], np.searchsorted(code[by], np.arange(len(count) + 1))
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused items, best first; those without a common term come last, in their order."""
        t = self.query[self.begin[seed] : self.begin[seed + 1]]
        at = ranges(self.first[t], self.first[t + 1] - self.first[t])
        score = np.bincount(self.owner[at], self.weight[at], self.n)
        score[~unused] = -1
        return np.argsort(-score, kind="stable")[: int(unused.sum())]


def pack_shard(lengths: list[int], index: Shard, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start in item, length) of items of these lengths."""
    unused = np.ones(len(lengths), bool)
    out, rest, next_seed = [], None, 0
    while True:
        row: list[tuple[int, int, int]] = []
        if rest is not None:
            seed, at = rest
        else:
            while next_seed < len(lengths) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(lengths):
                break
            seed, at = next_seed, 0
            unused[seed] = False
        rest = None
        room = window
        take = min(room, lengths[seed] - at)
        row.append((seed, at, take))
        room -= take
        if at + take < lengths[seed]:
            rest = (seed, at + take)
        elif room:
            for k in index.neighbours(seed, unused):
                unused[k] = False
                take = min(room, lengths[k])
                row.append((int(k), 0, take))
                room -= take
                if take < lengths[k]:
                    rest = (int(k), take)
                if not room:
                    break
        out.append(row)
    last = out.pop() if out else []
    while last:  # only the last window can be short: powers of two need no padding
        size = 1 << (sum(p[2] for p in last).bit_length() - 1)
        row, more, room = [], [], min(size, window)
        for k, at, take in last:
            fit = min(room, take)
            if fit:
                row.append((k, at, fit))
                room -= fit
            if fit < take:
                more.append((k, at + fit, take - fit))
        out.append(row)
        last = more
    return out


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in OUT.split(", ")]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], NAMES)


def whole_windows(parts: DataFrame, kind, window: int) -> DataFrame:
    """The pieces that fill a window by themselves; their sequences have even numbers."""

    def run(batches):
        sequence = TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for doc, blob in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                ids = np.frombuffer(blob.as_buffer(), kind)
                for at in range(0, len(ids) // window * window, window):
                    rows.append((doc, at, window, crc(ids[at : at + window]), len(ids), sequence, 0))
                    sequence += 2
            yield made(rows)

    return parts.filter(F.octet_length("ids") >= window * np.dtype(kind).itemsize).select("doc_id", "ids").mapInArrow(run, OUT)


ITEMS = "doc_id long, skipped long, total long, ids binary, terms binary, counts binary, place long, next long"


def items_of(parts: DataFrame, kind, window: int, corpus) -> DataFrame:
    """What whole windows leave of each document, its terms if they are more than that, and where it goes."""

    def run(batches):
        c: Corpus = corpus.value
        vocabulary = len(c.df)
        for b in pieces(batches, "ids"):
            blobs = [np.frombuffer(x.as_buffer(), kind) for x in b.column("ids")]
            length = np.array([len(x) for x in blobs], np.int64)
            some = np.flatnonzero(length % window)
            key, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *(blobs[i].astype(np.int64) + i * vocabulary for i in some.tolist())]), return_counts=True)
            term, owner = key % vocabulary, key // vocabulary
            first = np.searchsorted(owner, np.arange(len(blobs) + 1))
            long_ = [i if length[i] > window else None for i in some.tolist()]
            terms = [None if i is None else term[first[i] : first[i + 1]].astype(kind).tobytes() for i in long_]
            counts = [None if i is None else tf[first[i] : first[i + 1]].astype(np.int32).tobytes() for i in long_]
            weight = c.weight(term, tf, length[owner])
            shared = np.flatnonzero(c.df[term] > 1)
            shared = shared[np.lexsort((term[shared], -weight[shared], owner[shared]))]
            shared = shared[np.arange(len(shared)) - np.searchsorted(owner[shared], owner[shared]) < TELLING]
            shared = shared[np.lexsort((mix(term[shared].astype(np.uint64)), owner[shared]))]
            cut = np.searchsorted(owner[shared], np.arange(len(blobs) + 1))[some]
            n = np.searchsorted(owner[shared], some, "right") - cut
            padded = np.append(term[shared], [0, 0])
            best, second = np.where(n > 0, padded[cut], 0), np.where(n > 1, padded[cut + 1], 0)
            ids = np.asarray(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), np.int64)[some]
            salt = mix(ids.astype(np.uint64)) % np.maximum(-(-c.df[best] // PLACE), 1).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(some)), pa.array(length[some] // window * window), pa.array(length[some]),
                    pa.array([blobs[i][length[i] // window * window :].tobytes() for i in some.tolist()], pa.binary()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary()),
                    pa.array(best << 32 | salt.astype(np.int64)), pa.array(second),
                ],
                [x.split()[0] for x in ITEMS.split(", ")],
            )

    return parts.mapInArrow(run, ITEMS)


def pack(docs: DataFrame, path: str, end: int = 0, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row per piece of every document of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = automaton(path).tokens
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    parts = stored(encoded(docs, path, end, vocabulary), "packing")
    df = _frequencies(parts, vocabulary)
    parts = parts.filter("ids is not null").select("doc_id", "ids")
    n, size = parts.agg(F.count("*"), F.sum(F.octet_length("ids"))).first()
    corpus = spark.sparkContext.broadcast(Corpus.of(df, n, (size or 0) // np.dtype(kind).itemsize))  # of the vocabulary's size

    def run(batches):
        sequence = (TaskContext.get().partitionId() << 33) + 1
        items, profiles, held = [], [], 0

        def close():
            nonlocal sequence, held
            rows = []
            for row in pack_shard([len(x[2]) for x in items], Shard(profiles, corpus.value), window) if items else []:
                offset = 0
                for k, at, take in row:
                    doc, skipped, ids, total = items[k]
                    rows.append((doc, skipped + at, take, crc(ids[at : at + take]), total, sequence, offset))
                    offset += take
                sequence += 2
            items.clear()
            profiles.clear()
            held = 0
            return made(rows)

        for b in pieces(batches, "ids"):
            columns = (b.column(c).to_pylist() for c in ("doc_id", "skipped", "total", "ids", "terms", "counts"))
            for doc, skipped, total, blob, terms, counts in zip(*columns, strict=True):
                ids = np.frombuffer(blob, kind)
                profiles.append((*(np.unique(ids, return_counts=True) if terms is None else (np.frombuffer(terms, kind), np.frombuffer(counts, np.int32))), total))
                items.append((doc, skipped, ids, total))
                held += len(ids) + 2 * len(profiles[-1][0])
                if len(items) >= shard or held >= SHARD_IDS:
                    yield close()
        yield close()

    dealt = items_of(parts, kind, window, corpus).withColumn("h", F.xxhash64("doc_id")).repartition("place").sortWithinPartitions("place", "next", "h")
    return whole_windows(parts, kind, window).union(dealt.mapInArrow(run, OUT))


def op6_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text")), path or public_tokenizers.path("byte_bpe_50k.json"))
