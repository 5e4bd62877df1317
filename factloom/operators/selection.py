"""Which rules run: capability gate, settings, opt-in, types and tags, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capability_gate(caps: Column, requires: Column, requires_any: Column, disabled_when: Column) -> Column:
    """All of `requires`, any of `requires_any` (an empty list does not bind), none of `disabled_when`."""
    return F.forall(requires, lambda x: F.array_contains(caps, x)) & ((F.size(requires_any) == 0) | F.arrays_overlap(requires_any, caps)) & ~F.arrays_overlap(disabled_when, caps)


def effective_setting(setting: Column, override: Column, severity: Column) -> Column:
    """A path override beats a setting, and that the rule's own severity; what is neither off nor warn is an error."""
    chosen = F.coalesce(override, setting, severity)
    return F.when(chosen.isin("off", "warn"), chosen).otherwise("error")


def select_rules(rules: DataFrame, caps: Column, settings: DataFrame | None = None, typed: bool = False, tags: list[str] | None = None) -> DataFrame:
    """Active rules with their severity. settings: (id, setting)."""
    out = rules.filter(capability_gate(caps, F.col("requires"), F.col("requires_any"), F.col("disabled_when")))
    out = out.join(settings, "id", "left") if settings is not None else out.withColumn("setting", F.lit(None).cast("string"))
    out = out.filter(F.coalesce("setting", F.lit("")) != "off").filter(~F.col("opt_in") | F.col("setting").isNotNull())
    if not typed and "typed" in rules.columns:
        out = out.filter(~F.col("typed"))
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return out.withColumn("severity", effective_setting(F.col("setting"), F.lit(None).cast("string"), F.col("severity")))


def confidence(explicit: Column, opt_in: Column, severity: Column) -> Column:
    return F.coalesce(explicit, F.when(opt_in, "low").when(severity == "error", "high").otherwise("medium"))


def override_settings(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """(path, id, setting): the last override whose pattern holds the path. overrides: (ordinal, pattern, id, setting), a config."""
    return files.select("path").join(overrides, F.rlike(F.col("path"), F.col("pattern"))).groupBy("path", "id").agg(F.max_by("setting", "ordinal").alias("setting"))


def apply_overrides(findings: DataFrame, settings: DataFrame) -> DataFrame:
    """`off` drops a finding, warn and error set its severity. settings: (path, id, setting)."""
    s = settings.select(F.col("path").alias("norm_path"), F.col("id").alias("diagnostic"), "setting")
    return findings.join(s, ["norm_path", "diagnostic"], "left").filter(F.coalesce("setting", F.lit("")) != "off").withColumn("severity", F.coalesce("setting", "severity")).drop("setting")


def file_context(path: Column, text: Column) -> Column:
    """test, script or source. The patterns of paths."""
    return (
        F.when(path.rlike(r"(?i)(^|/)(__tests__|__mocks__)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)tests?/"), "test")
        .when(text.startswith("#!") | path.rlike(r"(?i)(^|/)(bin|cli|scripts?)/") | path.rlike(r"(?i)(^|/)cli\.[cm]?[jt]s$"), "script")
        .otherwise("source")
    )


def vendored(text: Column) -> Column:
    """A licence banner or module wrapper at the head, or a long line in the head of a large file. Its limits."""
    head = F.substring(text, 1, 4096)
    probe = F.substring(text, 1, 8192)
    long_line = F.exists(F.split(probe, "\n"), lambda x: F.length(x) >= 2000)
    return head.rlike(r"(?i)/\*!|@license|@preserve|typeof define === ['\"]function['\"] && define\.amd") | ((F.length(text) >= 50_000) & long_line)
