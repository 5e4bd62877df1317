"""Keys, order, suppression and display of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.schema import PLUGIN

def severity_rank():
    return F.when(F.col("severity") == "error", 0).otherwise(1)


def order_columns() -> list:
    return [severity_rank(), *(F.col(c) for c in ("norm_path", "line", "col", "diagnostic", "id"))]


def finalize(pending: DataFrame, text_rule: bool = False) -> DataFrame:
    """Add id and evidence_key to rows (norm_path, line, col, diagnostic, message, evidence)."""
    c = F.col
    key = S.text_evidence_key if text_rule else S.evidence_key
    evidence = c("evidence") if text_rule else S.evidence_text(c("evidence"))
    return pending.withColumn("id", S.finding_id(c("norm_path"), c("line"), c("col"), PLUGIN, c("diagnostic"), c("message"))).withColumn("evidence_key", key(c("diagnostic"), c("message"), evidence)).drop("evidence")


def canonical(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*order_columns())


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings with `suppressed`: by a next-line directive, else a same-line one, else the state of blocks.

    directives: (norm_path, line, kind in next, same, disable, enable, diagnostic or '*'). Block state is as of the
    finding's line: the latest block directive at or before it, if that disables. One union and one window decide it,
    so no range join is needed.
    """
    f = findings
    point = directives.filter(F.col("kind").isin("next", "same")).select("norm_path", F.when(F.col("kind") == "next", F.col("line") + 1).otherwise(F.col("line")).alias("line"), "diagnostic")
    named = point.filter("diagnostic <> '*'").distinct().withColumn("_named", F.lit(True))
    every = point.filter("diagnostic = '*'").select("norm_path", "line").distinct().withColumn("_every", F.lit(True))
    f = f.join(named, ["norm_path", "line", "diagnostic"], "left").join(every, ["norm_path", "line"], "left")
    blocks = directives.filter(F.col("kind").isin("disable", "enable")).select("norm_path", "line", "diagnostic", "kind")
    marks = blocks.groupBy("norm_path", "diagnostic", "line").agg(F.max("kind").alias("kind"))  # enable after disable on one line
    rows = f.select("*", F.lit(None).cast("string").alias("_kind"), F.lit(1).alias("_order"))
    fake = marks.select(*[F.col(c) if c in ("norm_path", "diagnostic", "line") else F.lit(None).cast(f.schema[c].dataType).alias(c) for c in f.columns], F.col("kind").alias("_kind"), F.lit(0).alias("_order"))
    w = Window.partitionBy("norm_path", "diagnostic").orderBy("line", "_order").rowsBetween(Window.unboundedPreceding, 0)
    state = rows.unionByName(fake).withColumn("_state", F.last("_kind", ignorenulls=True).over(w)).filter("_order = 1")
    return state.withColumn("suppressed", F.coalesce("_named", "_every", F.col("_state") == "disable", F.lit(False))).drop("_named", "_every", "_state", "_kind", "_order")


def near_miss(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings with the first next-line directive that stands one to four lines too high for them."""
    d = directives.filter("kind = 'next'").select("norm_path", "diagnostic", F.explode(F.sequence(F.col("line") + 2, F.col("line") + 5)).alias("line"), F.col("line").alias("directive_line"))
    best = d.groupBy("norm_path", "diagnostic", "line").agg(F.min("directive_line").alias("directive_line"))
    return findings.join(best, ["norm_path", "diagnostic", "line"], "left")


def in_ranges(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings in a changed range of their file. ranges: (norm_path, from_line, to_line)."""
    r = ranges.select(F.col("norm_path").alias("_p"), "from_line", "to_line")
    return findings.join(r, (F.col("norm_path") == F.col("_p")) & F.col("line").between(F.col("from_line"), F.col("to_line")), "left_semi")


def blocking(findings: DataFrame, level: str) -> DataFrame:
    """One row: does this set block at the level none, warning or error?"""
    test = {"none": F.lit(False), "warning": F.lit(True), "error": F.col("severity") == "error"}[level]
    return findings.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("blocking"))
