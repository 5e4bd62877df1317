"""Incremental scans: a content-hash cache, a stream that scans what changed, and a guard against stale versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probe(rules: DataFrame, capabilities: list[str]) -> str:
    """Hash of the active rules, their severities and the capabilities; a cached result holds only under the same."""
    line = F.concat("id", F.lit(":"), "severity")
    hashed = rules.agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n" + ",".join(sorted(capabilities)))), 256).alias("h")).first()
    return hashed.h[:16]


def stale(files: DataFrame, cache: DataFrame, probe_value: str) -> DataFrame:
    """Files that the cache (norm_path, hash, probe) does not hold as they are."""
    hashed = files.withColumn("hash", F.substring(F.sha2("text", 256), 1, 16))
    return hashed.join(cache.filter(F.col("probe") == probe_value).select("norm_path", "hash").distinct(), ["norm_path", "hash"], "left_anti")


def rescan(files: DataFrame, cache: DataFrame, results: DataFrame, probe_value: str, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings of all files: cached ones for files that did not change, new ones for the others."""
    todo = stale(files, cache, probe_value)
    kept = results.join(todo.select("norm_path").distinct(), "norm_path", "left_anti").join(files.select("norm_path").distinct(), "norm_path", "left_semi")
    return kept.unionByName(scan(todo.drop("hash")), allowMissingColumns=True)


def watch(stream: DataFrame, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str = "200 milliseconds", once: bool = False):
    """Scan what arrives and append the findings to `out`; the query's checkpoint makes restarts exact."""

    def batch(df: DataFrame, number: int) -> None:
        latest = df.groupBy("norm_path").agg(F.max_by(F.struct(*[c for c in df.columns if c != "norm_path"]), "version").alias("x")).select("norm_path", "x.*")
        scan(latest).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return q.trigger(availableNow=True).start() if once else q.trigger(processingTime=every).start()


def newest(analyses: DataFrame, versions: DataFrame) -> DataFrame:
    """Analyses (uri, version, ...) that are of the newest known version of their document."""
    v = versions.groupBy("uri").agg(F.max("version").alias("version"))
    return analyses.join(v, ["uri", "version"], "left_semi")


def windowed_counts(events: DataFrame, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per tumbling window with a watermark: an extension for event streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
