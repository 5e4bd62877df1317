"""Operator 1, embedding near-dedup with int8 tile products.

Equal vectors of a label are one class, which has a number of its own and a count, so copies are never compared with each
other. Each class's unit vector is quantised to int8 with a scale of its own, which leaves a rest whose length is kept.
Classes of a label are dealt into buckets, and every pair of buckets is one task, which gets the int8 codes only and
multiplies tiles of them. (The integers are multiplied as float32, which holds their sums exactly up to 1040 components at
a time.) With x = x' + d and y = y' + e, |xy - x'y'| <= |d| + (1 + |d|) |e|, so a pair above the threshold by more than
that bound is linked and one below it by more is not. Only the vectors that have a pair between are sent to their tasks a
second time, in double precision, and decide it there. A task returns counts and a spanning forest, not pairs.

Defined cases: a vector that is null, zero or holds null or non-finite components, or has a null label, links with
nothing; so do vectors of different lengths; rows with a null vec_id have no component (null, not kept) and link with
nothing; repeated rows are vectors of their own, and so are rows that repeat a vec_id with another vector (each is kept
whose component's smallest vec_id is its own); ties cannot arise (the threshold itself links); an empty table gives an
empty result; other columns are ignored, whatever their names; vectors of any length are compared whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, join_counted, small_batches, stored, table
from .textops import min_labels

THRESHOLD = 0.98
BUCKET = 8192
"""Classes of a bucket; twice as many meet in a task, as codes."""
BUCKET_BYTES = 4 << 20
"""Codes of a bucket, if vectors are long."""
TILE = 512
EXACT = 1040
SLACK = 1e-9
"""Over the rounding of double precision at these lengths."""


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what quantisation left of each unit row."""
    scale = np.abs(x).max(1, keepdims=True) / 127
    q = np.rint(x / scale).astype(np.int8)
    return q, scale[:, 0], np.sqrt(((x - q * scale) ** 2).sum(1)) + SLACK


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return out


def units(rows: pa.Table) -> np.ndarray:
    """Unit vectors of rows whose embeddings have one length."""
    x = rows.column("embedding").combine_chunks() if isinstance(rows.column("embedding"), pa.ChunkedArray) else rows.column("embedding")
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows.column("embedding")), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very small or large components stay in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes(classes: DataFrame) -> DataFrame:
    """cid, label, d, n and the quantised form of each class."""

    def run(batches):
        for b in batches:
            size = np.asarray(b.column("d"))
            for d in np.unique(size):
                own = b.filter(pa.array(size == d))
                q, scale, rest = quantise(units(own))
                yield pa.RecordBatch.from_arrays([own.column("cid"), own.column("label"), own.column("d"), own.column("n"), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(rest)], ["cid", "label", "d", "n", "code", "scale", "rest"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.mapInArrow(run, f"cid long, label {kind}, d int, n long, code binary, scale double, rest double")


class Tiles:
    """The classes of a task, those of side 0 first, and its pairs by tiles: (rows, columns, near, bound, which pairs count)."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("side", "ascending"), ("cid", "ascending")])
        self.rows, self.n = rows, rows.num_rows
        self.ids, self.count, self.side = (rows.column(c).to_numpy() for c in ("cid", "n", "side"))
        self.q = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(self.n, -1)
        self.scale, self.rest = rows.column("scale").to_numpy(), rows.column("rest").to_numpy()
        first = int((self.side == 0).sum())
        self.first, self.inner = first, self.n > 0 and rows.column("p")[0] == rows.column("q")[0]
        self.links, self.label = np.zeros(self.n, np.int64), np.arange(self.n)

    def __iter__(self):
        for i in range(0, self.first, TILE):
            a = slice(i, min(i + TILE, self.first))
            for j in range(i if self.inner else self.first, self.n, TILE):
                b = slice(j, min(j + TILE, self.n))
                near = products(self.q[a], self.q[b]) * self.scale[a, None] * self.scale[None, b]
                counts = np.triu(np.ones(near.shape, bool), 1) if self.inner and i == j else np.ones(near.shape, bool)
                yield a, b, near, self.rest[a, None] + (1 + self.rest[a, None]) * self.rest[None, b], counts

    def link(self, a: slice, b: slice, m: np.ndarray) -> None:
        if not m.any():
            return
        self.links[a] += m @ self.count[b]
        self.links[b] += m.T @ self.count[a]
        p, r = np.nonzero(m)
        old = np.flatnonzero(self.label != np.arange(self.n))
        self.label = min_labels(self.n, np.concatenate([p + a.start, old]), np.concatenate([r + b.start, self.label[old]]))

    def result(self, open_: np.ndarray) -> pa.Table:
        out = np.flatnonzero((self.links > 0) | open_)
        return pa.table([pa.array(self.ids[out]), pa.array(self.links[out]), pa.array(self.ids[self.label[out]]), pa.array(open_[out])], names=["cid", "links", "root", "open"])


def by_bounds(rows: pa.Table, threshold: float) -> pa.Table:
    """All pairs between two buckets (or inside one), as far as the bounds decide them; classes with another pair are open."""
    t = Tiles(rows)
    open_ = np.zeros(t.n, bool)
    for a, b, near, bound, counts in t:
        sure = counts & (near - bound >= threshold + SLACK)
        t.link(a, b, sure)
        between = counts & ~sure & (near + bound >= threshold - SLACK)
        open_[a] |= between.any(1)
        open_[b] |= between.any(0)
    return t.result(open_)


def in_full(rows: pa.Table, threshold: float) -> pa.Table:
    """The pairs between two buckets (or inside one) that the bounds left, in double precision."""
    t = Tiles(rows)
    x = units(t.rows)
    for a, b, near, bound, counts in t:
        p, r = np.nonzero(counts & (near - bound < threshold + SLACK) & (near + bound >= threshold - SLACK))
        m = np.zeros(near.shape, bool)
        for k in range(0, len(p), 1 << 14):
            i, j = p[k : k + (1 << 14)], r[k : k + (1 << 14)]
            m[i, j] = (x[a][i] * x[b][j]).sum(1) >= threshold
        t.link(a, b, m)
    return t.result(np.zeros(t.n, bool))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    small_batches(vectors.sparkSession)
    v = vectors.select("vec_id", "embedding", "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = v.filter(fine)
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("d", F.size("embedding")), "embedding-classes")  # written, so numbers stay
    total = classes.agg(F.sum("n")).first()[0] or 0
    sizes = classes.groupBy("label", "d").agg(F.count("*").alias("m"))
    sizes = cut(sizes.select("label", "d", "m", F.ceil(F.greatest(F.col("m") / bucket, F.col("m") * F.col("d") / BUCKET_BYTES)).alias("buckets")))
    quantised = stored(codes(classes), "embedding-codes")  # both steps see the same codes, so a pair is decided once
    dealt = join_counted(quantised, sizes, ["label", "d"], "m", classes.count()).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("buckets")))
    task = ["label", "d", "p", "q"]
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))).select(
        "label", "d", F.least("i", "o").alias("p"), F.greatest("i", "o").alias("q"), F.when(F.col("i") <= F.col("o"), 0).otherwise(1).alias("side"), "cid", "n", "code", "scale", "rest"
    )
    kind = classes.schema["label"].dataType.simpleString()

    def first(key, rows):
        out = by_bounds(rows, threshold)
        out = out.append_column("side", rows.column("side").take(pc.index_in(out.column("cid"), rows.column("cid"))))
        for k, name in enumerate(task):
            out = out.append_column(name, pa.array([key[k].as_py()] * out.num_rows, key[k].type))
        return out

    found = cut(pairs.groupBy(*task).applyInArrow(first, f"cid long, links long, root long, open boolean, side int, label {kind}, d int, p long, q long"))
    again = found.filter("open").select("cid", "side", *task).join(quantised.select("cid", "n", "code", "scale", "rest"), "cid").join(classes.select("cid", "embedding"), "cid")
    more = cut(again.groupBy(*task).applyInArrow(lambda rows: in_full(rows, threshold), "cid long, links long, root long, open boolean"))
    both = found.select("cid", "links", "root").filter("links > 0").unionByName(more.select("cid", "links", "root"))
    links = both.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(both.select(F.col("cid").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cid"), "component")
    linked = cut(linked.join(classes.select("cid", "least"), "cid"))
    least = cut(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c")))
    named = join_counted(linked.select("cid", "component"), least, ["component"], "c", linked.count()).select("cid", "component_id")
    known = cut(links.join(named, "cid", "left"))
    info = classes.select("cid", "label", "embedding", "least", "n").join(known, "cid", "left")
    info = info.select("label", "embedding", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    good_rows = join_counted(good, info, ["label", "embedding"], "n", total).select("vec_id", "n_links", "component_id")
    out = good_rows.union(v.filter(~fine).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT *, sqrt(list_dot_product(e, e)) AS s FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.98),
r AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""
