"""Scores: health, change risk, coverage of checks, readiness, modernisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import half_up
from factloom.schema import CATEGORIES, CATEGORY_WEIGHTS, DENSITY_AT_ZERO, SEVERITY_WEIGHTS


def _weight(table: dict[str, float], key: Column, default: float) -> Column:
    out = F.lit(default)
    for name, w in table.items():
        out = F.when(key == name, w).otherwise(out)
    return out


def finding_weight() -> Column:
    return _weight(SEVERITY_WEIGHTS, F.col("severity"), 1.0) * _weight(CATEGORY_WEIGHTS, F.col("category"), 0.0)


def score_columns(weighted: Column, lines: Column) -> list[Column]:
    kloc = weighted / F.greatest(lines, F.lit(1)) * 1000
    score = F.greatest(F.lit(0).cast("long"), half_up(100 - F.least(F.lit(100.0), kloc / DENSITY_AT_ZERO * 100)).cast("long"))
    label = F.when(score >= 75, "healthy").when(score >= 50, "needs work").otherwise("critical")
    return [score.alias("score"), label.alias("label"), half_up(weighted, 2).alias("weighted"), half_up(kloc, 2).alias("per_kloc")]


def health(findings: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Score of each key. lines: (key, total_lines), which also names keys without findings. All categories are counted."""
    w = findings.groupBy(key).agg(F.sum(finding_weight()).alias("w"), *[F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in CATEGORIES])
    names = [f"n_{c.lower()}" for c in CATEGORIES]
    return lines.join(w, key, "left").select(key, *score_columns(F.coalesce("w", F.lit(0.0)), F.col("total_lines")), *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def change_risk(introduced: DataFrame, files_touched: Column, key: str) -> DataFrame:
    """Risk of each key's introduced findings; files_touched is an aggregate expression."""
    each = _weight(CATEGORY_WEIGHTS, F.col("category"), 1.0) * F.when(F.col("severity") == "error", 2.0).otherwise(1.0)
    g = introduced.groupBy(key).agg(F.sum(each).alias("base"), files_touched.alias("files_touched"), F.count("*").alias("introduced"), F.bool_or(F.col("category") == "Security").alias("security"))
    risk = half_up(F.col("base") + F.least(F.lit(10.0), F.col("files_touched") * 0.5), 1)
    level = F.when(F.col("security") | (risk >= 20), "severe").when(risk >= 10, "high").when(risk >= 3, "moderate").otherwise("low")
    return g.select(key, risk.alias("risk"), level.alias("level"), "files_touched", "introduced")


def check_coverage(checks: DataFrame, unit: str, group: str) -> DataFrame:
    """Two-level score of checks (group, unit, status pass, fail or na): mean of the units' rounded scores; 100 if none counts."""
    p, f = F.count_if(F.col("status") == "pass"), F.count_if(F.col("status") == "fail")
    units = checks.groupBy(group, unit).agg(p.alias("p"), f.alias("f")).withColumn("s", F.when(F.col("p") + F.col("f") == 0, 100).otherwise(half_up(100.0 * F.col("p") / (F.col("p") + F.col("f")))))
    return units.groupBy(group).agg(half_up(F.avg("s")).cast("long").alias("score"), F.count("*").alias("units"), F.sum("p").alias("passed"), F.sum("f").alias("failed"))


def readiness(dimensions: DataFrame, group: str) -> DataFrame:
    """Share of ready among assessed dimensions (status ready, gap, na, unknown); null if none is assessed."""
    r, g = F.count_if(F.col("status") == "ready"), F.count_if(F.col("status") == "gap")
    a = dimensions.groupBy(group).agg(r.alias("ready"), g.alias("gap"), F.count("*").alias("dimensions"))
    return a.select(group, F.when(F.col("ready") + F.col("gap") > 0, half_up(100.0 * F.col("ready") / (F.col("ready") + F.col("gap"))).cast("long")).alias("score"), "ready", "gap", "dimensions")


def modernization(legacy: Column, lines: Column, runtime_major: Column) -> Column:
    raw = 100 - 12 * (legacy / F.greatest(lines, F.lit(1)) * 1000) - F.when(runtime_major < 20, 25).otherwise(0)
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(100).cast("long"), half_up(raw).cast("long")))


def worst(reports: DataFrame, ordinal: str) -> DataFrame:
    """The lowest score, the first of equals."""
    return reports.agg(F.min_by(F.struct(*[F.col(c) for c in reports.columns]), F.struct("score", ordinal)).alias("x")).select("x.*")
