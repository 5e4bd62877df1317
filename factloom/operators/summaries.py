"""Summaries, orders and small set operations over findings and what reports show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schema import CATEGORIES


def count_by(findings: DataFrame, column: str) -> DataFrame:
    return findings.groupBy(column).agg(F.count("*").alias("findings"))


def signals(findings: DataFrame) -> DataFrame:
    """Per diagnostic: how often, in how many files, and the first place in canonical order."""
    first = F.min(F.struct("norm_path", "line", "col"))
    g = findings.groupBy("diagnostic").agg(F.count("*").alias("findings"), F.countDistinct("norm_path").alias("files"), first.alias("at"))
    return g.select("diagnostic", "findings", "files", F.col("at.norm_path").alias("first_path"), F.col("at.line").alias("first_line"))


def work_list(findings: DataFrame) -> DataFrame:
    """Findings grouped as one would fix them: per file and diagnostic, how many and between which lines."""
    return findings.groupBy("norm_path", "diagnostic").agg(F.count("*").alias("findings"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def hygiene(findings: DataFrame) -> DataFrame:
    """Findings and errors of every category, those without any included."""
    names = findings.sparkSession.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "place int, category string")
    g = findings.groupBy("category").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"))
    return names.join(g, "category", "left").fillna(0, ["findings", "errors"]).select("category", "findings", "errors")


def distinct_by_id(findings: DataFrame, pos: str = "pos", key: str = "id") -> DataFrame:
    """Of findings with one id the first by pos."""
    rest = [c for c in findings.columns if c != key]
    return findings.groupBy(key).agg(F.min_by(F.struct(*rest), pos).alias("x")).select(key, "x.*").select(*findings.columns)


def display(findings: DataFrame, categories: list[str] | None = None, severities: list[str] | None = None, path: str | None = None, diagnostics: list[str] | None = None) -> DataFrame:
    """What a report shows: filters that do not change scores."""
    for column, values in (("category", categories), ("severity", severities), ("diagnostic", diagnostics)):
        if values:
            findings = findings.filter(F.col(column).isin(*values))
    return findings.filter(F.col("norm_path").rlike(path)) if path else findings


def by_coupling(degrees: DataFrame) -> DataFrame:
    return degrees.withColumn("coupling", F.col("fan_in") + F.col("fan_out")).orderBy(F.desc("coupling"), "node")


def worst_first(units: DataFrame, unit: str) -> DataFrame:
    return units.orderBy("score", unit)


def oldest_first(aged: DataFrame, pos: str) -> DataFrame:
    """Dated findings by age, then the undated ones, each in their own order."""
    return aged.orderBy(F.col("age").desc_nulls_last(), pos)


def trimmed(text: Column, most: int = 200) -> Column:
    """Evidence as it is displayed: white space squeezed, cut with an ellipsis. The finding keeps the whole."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def listed(names: Column, most: int = 3) -> Column:
    """A list in a message: the first names and how many more there are."""
    head = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(head, F.lit(" and "), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(head)


def still_resolved(resolved: DataFrame, present: DataFrame, suppressed: DataFrame, key: str = "key") -> DataFrame:
    """Resolved keys that neither are present again nor went away by suppression."""
    return resolved.select(key).distinct().join(present.select(key), key, "left_anti").join(suppressed.select(key), key, "left_anti")


def merged_settings(base: DataFrame, over: DataFrame) -> DataFrame:
    """Settings (name, value, items): the later value wins, lists are united without repeats, in their order."""
    j = base.select("name", F.col("value").alias("_a"), F.col("items").alias("_i")).join(over.select("name", F.col("value").alias("_b"), F.col("items").alias("_j")), "name", "full_outer")
    none = F.array().cast("array<string>")
    return j.select("name", F.coalesce("_b", "_a").alias("value"), F.array_distinct(F.concat(F.coalesce("_i", none), F.coalesce("_j", none))).alias("items"))


def relaxed(findings: DataFrame, contexts: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings after the context of their file: rules (diagnostic, context, setting) drop them (off) or make them warnings.

    contexts: (norm_path, context)."""
    f = findings.join(contexts, "norm_path", "left").join(rules.select("diagnostic", "context", F.col("setting").alias("_relax")), ["diagnostic", "context"], "left")
    f = f.filter(F.coalesce("_relax", F.lit("")) != "off").withColumn("severity", F.coalesce("_relax", "severity"))
    return f.drop("_relax", "context")


def places(offsets: DataFrame, texts: DataFrame, path: str = "path") -> DataFrame:
    """Offsets (path, offset from 0) with the line and column, both from 1, in their text."""
    j = offsets.join(texts.select(path, "text"), path)
    head = F.expr("substring(text, 1, offset)")
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    return j.select(path, "offset", line.cast("int").alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).cast("int").alias("col"))


def workspace_imports(imports: DataFrame, members: DataFrame) -> DataFrame:
    """Imports (path, specifier) of packages of the workspace: (path, member, dst). members: (name, dir)."""
    package = F.regexp_extract("specifier", r"^((?:@[^/]+/)?[^/]+)", 1)
    return imports.select("path", package.alias("name")).join(members, "name").select("path", F.col("name").alias("member"), F.col("dir").alias("dst")).distinct()


def unknown_members(uses: DataFrame, exports: DataFrame) -> DataFrame:
    """Members (package, member) used of packages whose exports are known, which they do not have."""
    known = uses.select("package", "member").distinct().join(exports.select("package").distinct(), "package", "left_semi")
    return known.join(exports.select("package", "member"), ["package", "member"], "left_anti")


def through_reexports(exports: DataFrame, stars: DataFrame) -> DataFrame:
    """(path, name, origin): names that a module offers, its own and those of modules that it re-exports whole, however far.

    exports: (path, name); stars: (src, dst). A module's own name hides one that comes from further away. Stars are made once,
    and those of modules that offer every name there is go, for they bring nothing more.
    """
    from factloom.operators.graph import cut

    stars = cut(stars.select("src", "dst"))
    known = front = cut(exports.select("path", "name", F.col("path").alias("origin")).distinct())
    names = known.select("name").distinct().count()
    while not front.isEmpty():
        step = stars.join(front.withColumnRenamed("path", "dst"), "dst").groupBy(F.col("src").alias("path"), "name").agg(F.min("origin").alias("origin"))
        front = cut(step.join(known, ["path", "name"], "left_anti").select("path", "name", "origin"))
        known = known.union(front)
        full = cut(known.groupBy(F.col("path").alias("src")).count().filter(F.col("count") >= names).select("src"))
        if not full.isEmpty():
            stars = cut(stars.join(full, "src", "left_anti"))
    return known
