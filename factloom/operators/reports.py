"""Reports that join facts of several kinds. A claim of absence holds only where nothing dynamic could hide a use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import placeholders
from factloom.operators import graph


def missing_translations(keys: DataFrame) -> DataFrame:
    """(locale, key, problem): keys of the default locale (most keys, then `en`, then the alphabet) that others lack, and
    keys whose placeholders differ. keys: (locale, key, value)."""
    sizes = keys.groupBy("locale").agg(F.countDistinct("key").alias("n"))
    default = sizes.agg(F.min_by("locale", F.struct(-F.col("n"), F.when(F.col("locale") == "en", 0).otherwise(1), "locale")).alias("d"))
    k = keys.crossJoin(F.broadcast(default))  # one row
    base = k.filter("locale = d").select("key", placeholders(F.col("value")).alias("want")).dropDuplicates(["key"])
    others = sizes.crossJoin(F.broadcast(default)).filter("locale <> d").agg(F.collect_set("locale").alias("locales"))  # the locales of a project
    have = k.filter("locale <> d").select("locale", "key", placeholders(F.col("value")).alias("got"))
    wanted = base.crossJoin(F.broadcast(others)).select("key", "want", F.explode("locales").alias("locale"))
    j = wanted.join(have, ["locale", "key"], "left")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("want"), "placeholders")
    return j.withColumn("problem", problem).filter("problem is not null").select("locale", "key", "problem")


def unused_keys(keys: DataFrame, uses: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Keys that no use names; none if any key is built at run time. uses: (key); dynamic: any rows."""
    guard = dynamic.agg((F.count("*") == 0).alias("ok"))
    return keys.select("key").distinct().join(uses.select("key").distinct(), "key", "left_anti").join(F.broadcast(guard.filter("ok")))


def schema_drift(uses: DataFrame, fields: DataFrame, dynamic: DataFrame) -> DataFrame:
    """(model, field, problem): fields that are used but not declared, filters on fields without an index, and models that
    nothing uses (only claimed if no access is dynamic). uses: (model, field, is_filter)."""
    f = fields.select("model", "field", "is_indexed")
    j = uses.join(fields.select("model").distinct(), "model", "left_semi").join(f, ["model", "field"], "left")
    unknown = j.filter("is_indexed is null").select("model", "field", F.lit("unknown-field").alias("problem")).distinct()
    slow = j.filter("is_filter and not is_indexed").select("model", "field", F.lit("unindexed-filter").alias("problem")).distinct()
    guard = dynamic.agg((F.count("*") == 0).alias("ok")).filter("ok")
    dead = fields.select("model").distinct().join(uses.select("model").distinct(), "model", "left_anti").join(F.broadcast(guard)).select("model", F.lit(None).cast("string").alias("field"), F.lit("dead-model").alias("problem"))
    return unknown.union(slow).union(dead)


def dead_code(files: DataFrame, edges: DataFrame, exports: DataFrame, imports: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, path, name): files that nothing reaches from entries, and exports that no import names.

    exports: (path, name); imports: (path, name, namespace) resolved to the exporting file; a namespace import uses all.
    """
    used = graph.reach(edges, entries.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))
    lost = files.select("path").distinct().join(used, "path", "left_anti").select(F.lit("unused-file").alias("kind"), "path", F.lit(None).cast("string").alias("name"))
    whole = imports.filter("namespace").select("path").distinct()
    names = exports.join(imports.select("path", "name").distinct(), ["path", "name"], "left_anti").join(whole, "path", "left_anti").join(entries.select("path"), "path", "left_anti")
    return lost.union(names.select(F.lit("unused-export"), "path", "name"))


def dependency_report(declared: DataFrame, imported: DataFrame, core: list[str]) -> DataFrame:
    """(kind, name): declared and never imported, imported and never declared. imported: (specifier)."""
    package = F.regexp_extract("specifier", r"^((?:@[^/]+/)?[^/]+)", 1)
    used = imported.filter("NOT specifier LIKE '.%' AND NOT specifier LIKE 'node:%' AND NOT specifier LIKE '/%'").select(package.alias("name")).filter(~F.col("name").isin(*core)).distinct()
    d = declared.select("name").distinct()
    return d.join(used, "name", "left_anti").select(F.lit("unused").alias("kind"), "name").union(used.join(d, "name", "left_anti").select(F.lit("undeclared"), "name"))


def install_scripts(packages: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, script) that run at installation; `prepare` only runs for packages that are not from the registry.

    packages: (name, scripts map); sources: (name, registry boolean).
    """
    s = packages.select("name", F.explode("scripts").alias("script", "command")).filter(F.col("script").isin("preinstall", "install", "postinstall", "prepare"))
    return s.join(sources, "name", "left").filter((F.col("script") != "prepare") | ~F.coalesce("registry", F.lit(True))).select("name", "script", "command")


def licences(packages: DataFrame) -> DataFrame:
    """(license, packages, copyleft) counts; an OR with a permissive choice is not copyleft."""
    parts = F.split(F.regexp_replace("license", r"[()]", ""), r"\s+OR\s+")
    left = F.forall(parts, lambda p: p.rlike(r"(?i)\b(A?GPL|LGPL|MPL|EPL|EUPL|CDDL|OSL|SSPL)"))
    return packages.groupBy("license").agg(F.countDistinct("name").alias("packages")).withColumn("copyleft", F.coalesce(left, F.lit(False)))


def review_routing(changed: DataFrame, edges: DataFrame, owners: DataFrame, handlers: DataFrame, standard: int = 5, senior: int = 25) -> DataFrame:
    """One row: reach of a change, whether it touches a hub, the owners to ask and the level of review."""
    seeds = changed.select(F.col("path").alias("node")).distinct()
    reached = graph.blast_radius(edges, seeds).join(seeds, "node", "left_anti")
    hub = graph.hubs(graph.degrees(edges)).join(seeds, "node", "left_semi").agg((F.count("*") > 0).alias("hub"))
    ask = owners.join(changed.select("path").distinct(), "path", "left_semi").filter("owner <> '(unowned)'").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    served = reached.select(F.col("node").alias("path")).union(changed.select("path")).distinct().join(handlers.select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("handler_files"))
    r = reached.agg(F.count("*").alias("reach"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"))
    level = F.when(F.col("hub") | (F.col("reach") >= senior), "senior").when((F.col("reach") >= standard) | (F.col("handler_files") >= 1), "standard").otherwise("light")
    return r.join(hub).join(ask).join(served).withColumn("level", level)  # one row each


def attack_paths(trails: DataFrame, sinks: DataFrame) -> DataFrame:
    """(node, hop, place): the located hops of tainted sinks. trails: (node, depth, trail); sinks: (node)."""
    return trails.join(sinks.select("node").distinct(), "node", "left_semi").select("node", "depth", F.posexplode("trail").alias("hop", "place"))


def exports_check(maps: DataFrame, files: DataFrame) -> DataFrame:
    """(package, subpath, target, problem) of export maps: targets that do not exist, leave the package or are not relative."""
    files = files.select("package", F.col("path").alias("_path"))
    t = maps.withColumn("_path", F.regexp_replace("target", r"^\./", ""))
    j = t.join(files.withColumn("_there", F.lit(True)), ["package", "_path"], "left")
    problem = F.when(~F.col("target").startswith("./"), "not-relative").when(F.col("target").rlike(r"(^|/)\.\.(/|$)|(^|/)node_modules(/|$)"), "outside").when(~F.col("target").contains("*") & F.col("_there").isNull(), "missing-file")
    return j.withColumn("problem", problem).filter("problem is not null").select("package", "subpath", "target", "problem")


def change_shapes(lines: DataFrame) -> DataFrame:
    """(path, shape) of a diff's lines (path, kind, text): environment keys that go and come back nowhere, and migrations
    that arrive together with other source."""
    key = F.regexp_extract("text", r"process\.env\.([A-Z_][A-Z0-9_]*)", 1)
    keyed = lines.withColumn("key", key).filter("key <> ''")
    gone = keyed.filter("kind = 'del'").join(keyed.filter("kind = 'add'").select("key").distinct(), "key", "left_anti").select("path", F.lit("env-key-removed").alias("shape")).distinct()
    migration = F.col("path").rlike(r"(^|/)migrations?/|\.sql$")
    both = lines.agg(F.bool_or(migration).alias("m"), F.bool_or(~migration & F.col("path").rlike(r"\.[cm]?[jt]sx?$")).alias("s")).filter("m and s")
    mixed = lines.filter(migration).select("path").distinct().join(F.broadcast(both)).select("path", F.lit("migration-with-feature").alias("shape"))
    return gone.union(mixed)


def openapi_paths(routes: DataFrame) -> DataFrame:
    """(path, method, operation_id, security): merged routes in document order. routes: (method, path, authenticated)."""
    from factloom.functions.scalars import path_template

    merged = routes.groupBy("method", "path").agg(F.bool_or("authenticated").alias("security"))
    name = F.concat(F.lower("method"), F.regexp_replace(F.initcap(F.regexp_replace("path", r"[^A-Za-z0-9]+", " ")), " ", ""))
    return merged.select(path_template(F.col("path")).alias("path"), F.lower("method").alias("method"), name.alias("operation_id"), "security").orderBy("path", "method")
