"""One scan: findings of all rules, gated, overridden, relaxed, suppressed, without repeats, in order, and their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import findings as fd
from factloom.operators import scoring, selection, summaries


def scan(found: DataFrame, rules: DataFrame, caps: Column, files: DataFrame, directives: DataFrame, settings: DataFrame | None = None, overrides: DataFrame | None = None, relax: DataFrame | None = None) -> DataFrame:
    """Findings of a project in canonical order.

    found: (norm_path, line, col, diagnostic, message, evidence) of text and code rules alike; rules: the catalogue;
    files: (path, text); directives as for `suppress`; settings (id, setting); overrides (ordinal, pattern, id, setting);
    relax (diagnostic, context, setting).
    """
    active = selection.select_rules(rules, caps, settings).select(F.col("id").alias("diagnostic"), "title", "category", "severity")
    f = found.drop("title", "category", "severity").join(active, "diagnostic")
    if overrides is not None:
        f = selection.apply_overrides(f, selection.override_settings(files, overrides))
    if relax is not None:
        f = summaries.relaxed(f, files.select(F.col("path").alias("norm_path"), selection.file_context(F.col("path"), F.col("text")).alias("context")), relax)
    f = fd.suppress(f, directives).filter("not suppressed").drop("suppressed")
    f = fd.finalize(f)
    return fd.canonical(summaries.distinct_by_id(f, "line"))


def score(found: DataFrame, files: DataFrame, key: Column, name: str = "project") -> DataFrame:
    """Health of each project; key is an expression over norm_path."""
    from factloom.functions.scalars import line_count

    lines = files.select(F.col("path").alias("norm_path"), line_count(F.col("text")).alias("n")).withColumn(name, key).groupBy(name).agg(F.sum("n").alias("total_lines"))
    return scoring.health(found.withColumn(name, key), lines, name)
