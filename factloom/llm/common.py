"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import give_back, worker_memory


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local one serves a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = Path(tempfile.gettempdir(), f"factloom-{os.getpid()}").as_uri()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


ROWS_A_TASK = 1 << 15


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, which outlives executors.

    What is small is then read by few tasks, whatever number of partitions it was made in: each of them would write a file of
    its own in every exchange to come.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    return out.coalesce(1 + out.count() // ROWS_A_TASK)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS, BATCH_SIZE = 1000, "4m"


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a few MB: rows here are whole texts, and a batch is held by the JVM and Python at once.

    Both settings are read when a result is computed, after the operator has returned, so they stay lowered in the session.
    """
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_SIZE)


def private(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> list[str]:
    """Quoted names of df's columns but those named, whatever their case."""
    gone = {n.lower() for n in names}
    return [f"`{c}`" for c in df.columns if c.lower() not in gone]


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches, text: str = "text", limit: int = 1 << 20):
    """In a task: record batches cut to about `limit` bytes of text, one row at least."""
    worker_memory()
    for b in batches:
        t = b.column(text)
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(t), 0), np.int64)) if b.num_rows else np.zeros(0)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + limit, "right")))
            yield b.slice(i, j - i)
            i = j
    give_back()


def fold(df: DataFrame, every: int) -> DataFrame:
    """held_out column's remainder: crc32 of doc_id as text modulo `every`."""
    return F.crc32(F.col("doc_id").cast("string")) % every


HOT = 1000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row per key and says in `count` how many rows of left have it (total in all).

    Keys with more than a HOT-th of all rows are HOT at most: they are broadcast, and their rows are not moved.
    """
    limit = total / HOT
    hot = F.broadcast(right.filter(F.col(count) > limit))
    cold = left.join(hot.select(*on), on, "left_anti").join(right.filter(F.col(count) <= limit), on, how)
    return left.join(hot, on).unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u long, v long): rows (node, component) with the smallest node of each.

    Alternating large-star and small-star steps; every step is two shuffles with partial aggregation, its result is
    checkpointed, and only a count and a checksum come to the driver.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    before = mark(e)
    while before[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        e = cut(joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct())
        after = mark(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
