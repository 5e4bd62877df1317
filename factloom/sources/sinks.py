"""Sinks: JSON, SARIF, annotations, Markdown, SBOM. Rows stay distributed until the writer asks for one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import purl, version_parts


def escaped(x: Column, attribute: bool = False) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if attribute else ())):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def annotations(findings: DataFrame) -> DataFrame:
    """One workflow command per finding."""
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    return findings.select(F.concat(F.lit("::"), level, F.lit(" file="), escaped(F.col("norm_path"), True), F.lit(",line="), F.col("line").cast("string"), F.lit(",col="), F.col("col").cast("string"), F.lit("::"), escaped(F.col("message"))).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The rule descriptors: of each rule, what its first finding says."""
    first = findings.groupBy("diagnostic").agg(F.min_by("title", "pos").alias("title"))
    return first.select(F.to_json(F.struct(F.col("diagnostic").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"))).alias("value"))


def json_findings(findings: DataFrame) -> DataFrame:
    """One JSON object per finding."""
    place = [c for c in ("id", "norm_path", "line", "col", "diagnostic", "title", "category", "severity", "message") if c in findings.columns]
    return findings.select(F.to_json(F.struct(*place)).alias("value"))


def json_report(findings: DataFrame, health: DataFrame) -> DataFrame:
    """The head of a JSON report: one row with the counts by severity and category and the score; findings follow as rows."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    totals = findings.agg(F.count("*").alias("findings"), count("severity", "error").alias("errors"), count("severity", "warn").alias("warnings"), F.countDistinct("norm_path").alias("files"))
    return totals.crossJoin(F.broadcast(health.limit(1))).select(F.to_json(F.struct("findings", "errors", "warnings", "files", "score", "label")).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    place = F.array(F.struct(F.struct(F.struct(F.col("norm_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("diagnostic").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("id").alias("findingId")).alias("partialFingerprints"))).alias("value"))


def markdown_rows(findings: DataFrame, order: list, most: int = 50) -> DataFrame:
    """A table's rows: the first `most` findings, which is the report's length."""
    cell = lambda c: F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
    return findings.orderBy(*order).limit(most).select(F.concat(F.lit("| "), F.concat_ws(" | ", cell("severity"), cell("diagnostic"), F.concat(cell("norm_path"), F.lit(":"), cell("line")), cell("message")), F.lit(" |")).alias("value"))


def sbom_components(components: DataFrame) -> DataFrame:
    """CycloneDX components of (name, version, dev)."""
    p = purl(F.col("name"), F.col("version"))
    return components.select(F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", p.alias("purl"), p.alias("bom-ref"), F.when(F.col("dev"), "optional").otherwise("required").alias("scope"))).alias("value"))


def locked_components(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """Declared dependencies with the locked version, else the declared range; a runtime use beats a development one."""
    one = declared.groupBy("name").agg(F.min_by("range", "dev").alias("range"), F.min("dev").alias("dev"))
    v = locked.groupBy("name").agg(F.max_by("version", version_parts(F.col("version"))).alias("locked"))
    return one.join(v, "name", "left").select("name", F.coalesce("locked", "range").alias("version"), "dev")
