"""Operator 8, line dedup with sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ASCII white space, A-Z in lower case. Each shard of the key space has a cuckoo
filter (16-bit fingerprints, four to a bucket, deletable) in front of an exact table of reference counts: a key that the
filter does not know is new and needs no look-up; one that it may know is resolved in the table. Keys of at least
MIN_POINTS code points in two or more documents lose their lines everywhere but in the smallest doc_id that holds them.
`LineIndex` keeps shards as tables, so documents can be inserted and deleted later and decisions follow.

Defined cases: a null or empty text is one empty line; a null doc_id comes after all others; rows with the same doc_id
are one document; lines that repeat inside one document only all stay; ties cannot arise (the smallest doc_id keeps a
line); a very long line is one key; other columns are carried by `clean` unless they are named like its outputs (in place,
all of them are); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as ex
from .common import cut, pieces, table
from .textops import BYTES, BYTES2, LOWER, NO_DOC, Texts, mix

U64 = np.uint64
MIN_POINTS = 10


class Lines:
    """Line spans of a batch of texts, and the keys of the lines that count."""

    def __init__(self, texts: Texts):
        data, offsets = texts.data, texts.offsets
        breaks = np.flatnonzero(data == 10)
        own = np.searchsorted(offsets, breaks, "right") - 1
        n = np.bincount(own, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.n = n + 1
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        total = int(self.first[-1])
        self.starts, self.ends = np.empty(total, np.int64), np.empty(total, np.int64)
        is_first = np.zeros(total, bool)
        is_first[self.first[:-1]] = True
        self.starts[is_first], self.starts[~is_first] = offsets[:-1], breaks + 1
        is_last = np.zeros(total, bool)
        is_last[self.first[1:] - 1] = True
        self.ends[is_last], self.ends[~is_last] = offsets[1:], breaks
        self.is_last = is_last
        # strip: from the first word's start to the last word's end inside the line
        ws, we, _ = texts.words()
        a, b = np.searchsorted(ws, self.starts), np.searchsorted(we, self.ends, "right") - 1
        some = a <= b
        s, e = np.where(some, ws[np.minimum(a, max(len(ws) - 1, 0))] if len(ws) else 0, 0), np.where(some, we[b] if len(we) else 0, 0)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.at = np.flatnonzero(some & (points[e] - points[s] >= MIN_POINTS))
        low = LOWER[data]
        self.key, self.key2 = BYTES.spans(low, s[self.at], e[self.at]), BYTES2.spans(low, s[self.at], e[self.at])


class CuckooFilter:
    """Approximate set of 64-bit hashes without false negatives; insertion and lookup of whole arrays, deletion."""

    SLOTS = 4

    def __init__(self, buckets: int = 1 << 10, slots: np.ndarray | None = None):
        self.t = np.zeros((buckets, self.SLOTS), np.uint16) if slots is None else slots
        self.n = int((self.t != 0).sum())

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum((h >> U64(48)).astype(np.uint16), 1), (h & U64(len(self.t) - 1)).astype(np.int64)

    def _other(self, f: np.ndarray, i: np.ndarray) -> np.ndarray:
        return i ^ (mix(f.astype(U64) + U64(77)) & U64(len(self.t) - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        f, i = self._place(h)
        return (self.t[i] == f[:, None]).any(1) | (self.t[self._other(f, i)] == f[:, None]).any(1)

    def insert(self, h: np.ndarray) -> bool:
        """Insert distinct keys; false if the filter is too full, and then it must be built anew."""
        if self.n + len(h) > 0.9 * self.t.size:
            return False
        self.n += len(h)
        f, i = self._place(h)
        for turn in range(400):
            for _ in (0, 1):
                order = np.argsort(i, kind="stable")
                f, i = f[order], i[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                free = np.cumsum(self.t[i] == 0, axis=1)
                ok = free[:, -1] > rank
                slot = (free == (rank + 1)[:, None]).argmax(1)
                self.t[i[ok], slot[ok]] = f[ok]
                f, i = f[~ok], i[~ok]
                if not len(f):
                    return True
                i = self._other(f, i)
            bucket, one = np.unique(i, return_index=True)
            victim = self.t[bucket, turn % self.SLOTS].copy()
            self.t[bucket, turn % self.SLOTS] = f[one]
            f[one] = victim
            i[one] = self._other(victim, bucket)
        return False

    def delete(self, h: np.ndarray) -> None:
        """Take out keys that were inserted."""
        f, i = self._place(h)
        while len(f):
            for _ in (0, 1):
                # of keys with one fingerprint and bucket, one a turn
                _, one = np.unique(i << 16 | f, return_index=True)
                hit = self.t[i[one]] == f[one, None]
                found = hit.any(1)
                self.t[i[one[found]], hit[found].argmax(1)] = 0
                self.n -= int(found.sum())
                rest = np.ones(len(f), bool)
                rest[one[found]] = False
                f, i = f[rest], i[rest]
                i = self._other(f, i)
            if not found.any() and len(one) == len(f):
                return  # what is left was never inserted


class Shard:
    """Filter and exact table (key in two parts, reference count, smallest document) of one shard."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.key, self.key2 = np.zeros(0, U64), np.zeros(0, U64)
        self.count, self.least = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _find(self, key: np.ndarray, key2: np.ndarray) -> np.ndarray:
        """Places in the sorted exact table; -1 if absent. Equal first parts are walked through."""
        at = np.searchsorted(self.key, key)
        out = np.full(len(key), -1)
        todo = np.arange(len(key))
        while len(todo):
            p = at[todo]
            inside = p < len(self.key)
            todo, p = todo[inside], p[inside]
            same = self.key[p] == key[todo]
            todo, p = todo[same], p[same]
            hit = self.key2[p] == key2[todo]
            out[todo[hit]] = p[hit]
            todo = todo[~hit]
            at[todo] += 1
        return out

    def insert(self, key, key2, count, doc) -> None:
        order = np.lexsort((doc, key2, key))
        key, key2, count, doc = key[order], key2[order], count[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return
        key, key2, count, doc = key[first], key2[first], np.add.reduceat(count, first), doc[first]
        maybe = self.filter.contains(key)
        at = np.full(len(key), -1)
        at[maybe] = self._find(key[maybe], key2[maybe])
        old = at >= 0
        self.count[at[old]] += count[old]
        self.least[at[old]] = np.minimum(self.least[at[old]], doc[old])
        key, key2, count, doc = key[~old], key2[~old], count[~old], doc[~old]
        self.key, self.key2 = np.concatenate([self.key, key]), np.concatenate([self.key2, key2])
        self.count, self.least = np.concatenate([self.count, count]), np.concatenate([self.least, doc])
        order = np.lexsort((self.key2, self.key))
        self.key, self.key2, self.count, self.least = self.key[order], self.key2[order], self.count[order], self.least[order]
        if not self.filter.insert(key):
            size = len(self.filter.t)
            while True:
                size *= 2
                self.filter = CuckooFilter(size)
                if self.filter.insert(self.key):
                    break


STEP = 1 << 17


def decide(rows: pa.Table) -> pa.Table:
    """Insert a shard's entries batch by batch; the answer to each is two bits: the key is in two or more documents, and
    the batch's smallest document with it is the smallest of all."""
    n, (key, key2, doc, count), rows = ex.receive(rows, [np.uint64, np.uint64, np.int64, np.int64])
    shard = Shard()
    for i in range(0, len(key), STEP):
        shard.insert(key[i : i + STEP], key2[i : i + STEP], count[i : i + STEP], doc[i : i + STEP])
    at = shard._find(key, key2)
    bits = np.stack([shard.count[at] >= 2, shard.least[at] == doc], axis=1).reshape(-1)
    out = ex.answer(rows, 2 * n, bits)
    return out.set_column(2, "n", pa.array(2 * n))


def _entries(batch: ex.Batch, buckets: int):
    """The batch's lines, its distinct keys by shard with the number of documents and the smallest, each line's entry."""
    lines = Lines(batch.texts)
    ids = batch.ids[lines.doc[lines.at]]
    bucket = (lines.key >> U64(32)) % U64(buckets)
    order = np.lexsort((ids, lines.key2, lines.key, bucket))
    k, k2, d, b = lines.key[order], lines.key2[order], ids[order], bucket[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
    other = new.copy()
    other[1:] |= d[1:] != d[:-1]
    first = np.flatnonzero(new)
    count = np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    entry = np.empty(len(k), np.int64)
    entry[order] = np.cumsum(new) - 1
    return lines, b[new], k[new], k2[new], d[new], count, entry


def clean(docs: DataFrame, total: int | None = None, digest: bool = False, in_place: bool = False) -> DataFrame:
    """One row per row of docs: its columns but text, n_lines, n_dropped and kept (the lines that stay), or its digest.

    In place, the rows have the columns of docs, whatever their names, and the lines that stay are their text.
    """
    mine = ["n_lines", "n_dropped", "kept_sha256" if digest else "kept"]
    keep = [f for f in docs.schema if f.name.lower() != "text" and (in_place or f.name.lower() not in mine)]
    total = ex.text_bytes(docs) if total is None else total
    buckets = max(total // (64 * ex.BUCKET_KEYS), 8)
    # carried columns travel under names of their own
    batches = ex.batched(docs.select(*(F.col(f"`{f.name}`").alias(f"_k{i}") for i, f in enumerate(keep)), F.col("doc_id").cast("long").alias("doc_id"), "text"), total)

    def send(batch):
        _, bucket, key, key2, doc, count, _ = _entries(batch, buckets)
        return ex.send(batch.b, bucket, [key, key2, doc, count])

    def run(batch, bits):
        lines, _, _, _, least, _, entry = _entries(batch, buckets)
        many, own = bits[0::2], bits[1::2]
        gone = np.zeros(len(lines.doc), bool)
        if len(entry):
            keeper = own[entry] & (batch.ids[lines.doc[lines.at]] == least[entry])
            gone[lines.at] = many[entry] & ~keeper
        data, size = batch.texts.data, len(batch.texts.data)
        mark = np.zeros(size + 2, np.int8)
        np.add.at(mark, lines.starts[~gone], 1)
        np.subtract.at(mark, (lines.ends + ~lines.is_last)[~gone], 1)
        inside = np.cumsum(mark[:size], dtype=np.int8) > 0
        kept = data[inside].tobytes()
        cuts = np.concatenate([[0], np.cumsum(inside)])[batch.texts.offsets]
        open_end = gone[lines.first[1:] - 1] if len(batch.ids) else np.zeros(0, bool)  # the last line went: so does the break before it
        texts = [kept[i : j - 1] if cut_one and j > i else kept[i:j] for i, j, cut_one in zip(cuts[:-1].tolist(), cuts[1:].tolist(), open_end.tolist(), strict=True)]
        dropped = np.bincount(lines.doc[gone], minlength=len(batch.ids))
        last = pa.array([hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode("utf-8", "replace") for t in texts], pa.string())
        return pa.table([*(batch.rows.column(f"_k{i}") for i in range(len(keep))), pa.array(lines.n.astype(np.int64)), pa.array(dropped.astype(np.int64)), last], names=names)

    names = [*(f"_k{i}" for i in range(len(keep))), "n_lines", "n_dropped", "last"]
    schema = ", ".join([*(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(keep)), "n_lines long, n_dropped long, last string"])
    out = ex.finish(batches, ex.ask(batches, send, decide, buckets), run, schema)
    back = {f.name: F.col(f"_k{i}").alias(f.name) for i, f in enumerate(keep)}
    if in_place:
        return out.select(*(back.get(c, F.col("last").alias(c)) for c in docs.columns))
    return out.select(*back.values(), "n_lines", "n_dropped", F.col("last").alias(mine[2]))


class LineIndex:
    """A persistent, reversible index: refs (shard, k1, k2, doc_id), one row per key and document, and a filter per shard.

    The reference count of a key is the number of its refs. Every method returns a new index; nothing is collected. The
    number of shards is fixed when the index is made, from the bytes of text that it is to hold.
    """

    SHARD_BYTES = 64 << 20
    REFS = "shard long, k1 long, k2 long, doc_id long"
    FILTERS = "shard long, slots binary"

    def __init__(self, refs: DataFrame, filters: DataFrame, shards: int):
        self.refs, self.filters, self.shards = refs, filters, shards

    @classmethod
    def empty(cls, spark: SparkSession, size: int = 0) -> LineIndex:
        shards = max(size // cls.SHARD_BYTES, 16)
        return cls(spark.createDataFrame([], cls.REFS), spark.range(shards).select(F.col("id").alias("shard"), F.lit(CuckooFilter().t.tobytes()).alias("slots")), shards)

    def keys(self, docs: DataFrame) -> DataFrame:
        shards = self.shards

        def run(batches):
            for b in pieces(batches):
                t = Lines(Texts(b.column("text")))
                ids = b.column("doc_id").fill_null(NO_DOC).take(pa.array(t.doc[t.at]))
                shard = (t.key >> U64(32)) % U64(shards)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(t.key.view(np.int64)), pa.array(t.key2.view(np.int64)), ids], ["shard", "k1", "k2", "doc_id"])

        return docs.select("doc_id", "text").mapInArrow(run, self.REFS).distinct()

    def _filters(self, keys: DataFrame, add: bool) -> DataFrame:
        """Filters with distinct keys added or deleted."""

        def run(key, left, right):
            filter_ = CuckooFilter(slots=np.frombuffer(right.column("slots")[0].as_py(), np.uint16).reshape(-1, 4).copy())
            h = left.column("k1").to_numpy().view(U64)
            if not add:
                filter_.delete(h)
            elif len(h) and not filter_.insert(h):
                return pa.table([pa.array([key[0].as_py()]), pa.array([b""], pa.binary())], names=["shard", "slots"])
            return pa.table([pa.array([key[0].as_py()]), pa.array([filter_.t.tobytes()], pa.binary())], names=["shard", "slots"])

        return keys.select("shard", "k1", "k2").distinct().groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(run, self.FILTERS)

    @classmethod
    def _rebuilt(cls, refs: DataFrame, filters: DataFrame) -> DataFrame:
        """Filters that overflowed are built anew from the exact keys."""

        def run(key, left, right):
            slots = right.column("slots")[0].as_py()
            if not slots:
                h = left.column("k1").to_numpy().view(U64)
                size = 1 << 10
                while True:
                    filter_ = CuckooFilter(size)
                    if filter_.insert(h):
                        break
                    size *= 2
                slots = filter_.t.tobytes()
            return pa.table([pa.array([key[0].as_py()]), pa.array([slots], pa.binary())], names=["shard", "slots"])

        return refs.select("shard", "k1", "k2").distinct().groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, cls.FILTERS)

    def insert(self, docs: DataFrame) -> LineIndex:
        keys = self.keys(docs)

        def probe(key, left, right):
            filter_ = CuckooFilter(slots=np.frombuffer(right.column("slots")[0].as_py(), np.uint16).reshape(-1, 4))
            h = left.column("k1").to_numpy().view(U64)
            return left.append_column("maybe", pa.array(filter_.contains(h) if len(h) else np.zeros(0, bool)))

        probed = cut(keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(probe, self.REFS + ", maybe boolean"))
        at = ["shard", "k1", "k2"]
        fresh = probed.filter("not maybe").select(*at).union(probed.filter("maybe").select(*at).join(self.refs.select(*at), at, "left_anti"))
        refs = cut(self.refs.union(probed.drop("maybe").join(self.refs, [*at, "doc_id"], "left_anti").select(*at, "doc_id")))
        return LineIndex(refs, cut(self._rebuilt(refs, self._filters(fresh, True))), self.shards)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        at = ["shard", "k1", "k2"]
        refs = cut(self.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*at, "doc_id"))
        gone = self.refs.select(*at).distinct().join(refs.select(*at), at, "left_anti")
        return LineIndex(refs, cut(self._filters(gone, False)), self.shards)

    def counts(self) -> DataFrame:
        """k1, k2, documents, keeper for keys in two or more documents."""
        return self.refs.groupBy("k1", "k2").agg(F.count("*").alias("documents"), F.min("doc_id").alias("keeper")).filter("documents >= 2")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents),
k AS (SELECT doc_id, p, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, p, line, (c.key IS NOT NULL AND k.doc_id <> c.least) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
