"""Counting of hashed keys across batches of documents, with bits as the answer.

Documents are dealt into batches by doc_id, about BATCH_BYTES of text each. A batch sends every other side of the
exchange one array of its distinct keys per bucket (pre-aggregated: a key that a third of all documents hold is sent
once per batch), a bucket sees one key's entries from all batches, and sends each batch one bit per entry back, in the
order of the array. So the text is dealt out once, keys once, and answers are bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, small_batches
from .textops import NO_DOC, Texts, give_back, worker_memory

BATCH_BYTES = 3 << 19
BUCKET_KEYS = 1 << 20
WIRE = "_b long, bucket long, n long, body binary"
NAMES = ["_b", "bucket", "n", "body"]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def batched(docs: DataFrame, total: int) -> DataFrame:
    """docs with their batch _b, dealt out by it; total is the number of text bytes."""
    small_batches(docs.sparkSession)
    batches = max(total // BATCH_BYTES, 1)
    tasks = max(parallelism(docs.sparkSession), 1)
    return docs.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(batches))).repartition(int(min(tasks, max(batches, 1))), "_b")


class Batch:
    """A batch's rows in order of doc_id; null ids come last."""

    def __init__(self, rows: pa.Table):
        worker_memory()
        ids = rows.column("doc_id")
        ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).fill_null(NO_DOC).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.rows = rows.take(pa.array(order))
        self.ids = ids[order]
        self.texts = Texts(self.rows.column("text"))
        self.b = rows.column("_b")[0].as_py()


def send(b: int, bucket: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """Rows of WIRE from columns that are sorted by bucket."""
    names, first = np.unique(bucket, return_index=True)
    last = np.append(first[1:], len(bucket))
    body = [b"".join(np.ascontiguousarray(c[i:j]).tobytes() for c in columns) for i, j in zip(first, last, strict=True)]
    return pa.table([pa.array(np.full(len(names), b, np.int64)), pa.array(names.astype(np.int64)), pa.array((last - first).astype(np.int64)), pa.array(body, pa.binary())], names=NAMES)


def receive(rows: pa.Table, kinds: list) -> tuple[np.ndarray, list[np.ndarray], pa.Table]:
    """Sizes of the entries' arrays and their columns, back to back, in the order of the batches."""
    rows = rows.sort_by("_b")
    n = rows.column("n").to_numpy()
    bodies = [x.as_buffer() for x in rows.column("body")]
    out = []
    skipped = np.zeros(len(n), np.int64)
    for kind in kinds:
        out.append(np.concatenate([np.frombuffer(x, kind, int(k), int(s)) for x, k, s in zip(bodies, n, skipped, strict=True)]) if len(n) else np.zeros(0, kind))
        skipped = skipped + n * np.dtype(kind).itemsize
    return n, out, rows


def answer(rows: pa.Table, n: np.ndarray, bits: np.ndarray) -> pa.Table:
    """Bits to each batch, packed."""
    cuts = np.concatenate([[0], np.cumsum(n)])
    body = [np.packbits(bits[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([rows.column("_b"), rows.column("bucket"), rows.column("n"), pa.array(body, pa.binary())], names=NAMES)


def bits_of(answers: pa.Table) -> np.ndarray:
    """All bits that a batch got back, in the order of its entries (by bucket)."""
    if not answers.num_rows:
        return np.zeros(0, bool)
    answers = answers.sort_by("bucket")
    return np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k) for x, k in zip(answers.column("body"), answers.column("n").to_pylist(), strict=True)]).astype(bool)


def freeing(work: Callable) -> Callable:
    """work on a group's rows, after which the worker gives back what it freed: Arrow's pool and glibc would keep it."""

    def run(rows):
        try:
            return work(rows)
        finally:
            give_back()

    return run


def freeing_two(work: Callable) -> Callable:
    """As freeing, for two groups."""

    def run(rows, bits):
        try:
            return work(rows, bits)
        finally:
            give_back()

    return run


def ask(batches: DataFrame, make: Callable, judge: Callable, buckets: int) -> DataFrame:
    """make(Batch) -> table of WIRE; judge(rows of one bucket) -> table of WIRE."""
    sent = batches.groupBy("_b").applyInArrow(freeing(lambda rows: make(Batch(rows))), WIRE)
    return sent.groupBy("bucket").applyInArrow(freeing(judge), WIRE)


def ask_again(batches: DataFrame, answers: DataFrame, make: Callable, judge: Callable) -> DataFrame:
    """As ask; make(Batch, bits) also sees an earlier question's answers."""
    sent = batches.groupBy("_b").cogroup(answers.groupBy("_b")).applyInArrow(freeing_two(lambda rows, bits: make(Batch(rows), bits_of(bits)) if rows.num_rows else send(0, np.zeros(0, np.int64), [])), WIRE)
    return sent.groupBy("bucket").applyInArrow(freeing(judge), WIRE)


def finish(batches: DataFrame, answers: DataFrame, make: Callable, schema: str) -> DataFrame:
    """make(Batch, bits) -> table of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_schema(_parse_datatype_string(schema))
    def run(rows, bits):
        if not rows.num_rows:
            return pa.table([pa.array([], f.type) for f in wanted], names=wanted.names)
        return make(Batch(rows), bits_of(bits))

    return batches.groupBy("_b").cogroup(answers.groupBy("_b")).applyInArrow(freeing_two(run), schema)
