"""Sources: text files, reports, manifests, lock files, ownership and diffs, as tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.globs import any_glob
from factloom.functions.scalars import line_count

#: What a source tree scan leaves out, and the extensions that it reads.
IGNORED = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/out/_next/**", "**/.nuxt/**", "**/coverage/**", "**/.vite/**", "**/prisma/generated/**", "**/*.d.ts", "**/*.min.js", "**/*.bundle.js", "**/*.vendor.js"]
EXTENSIONS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts")


def read_tree(spark: SparkSession, root: str, globs: list[str] | None = None, ignored: list[str] | None = None, dotfiles: bool = False) -> DataFrame:
    """files(path, norm_path, text, n_lines) below root. Names are filtered before contents are decoded; the reader leaves
    out files of length zero."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"/+$", "", root.split(":", 1)[-1] if root.startswith("file:") else root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(re.sub("^/*", "/", base)) + "/", "")
    out = raw.withColumn("norm_path", rel)
    out = out.filter(F.col("norm_path").rlike(any_glob(globs or [f"**/*.{x}" for x in EXTENSIONS] + [f"*.{x}" for x in EXTENSIONS])))
    out = out.filter(~F.concat(F.lit("/"), "norm_path").rlike(any_glob(["/" + g if not g.startswith("**") else g for g in (IGNORED if ignored is None else ignored)])))
    if not dotfiles:
        out = out.filter(~F.col("norm_path").rlike(r"(^|/)\."))
    return out.select("path", "norm_path", F.col("content").cast("string").alias("text")).withColumn("n_lines", line_count(F.col("text")))


def scoped(files: DataFrame, selectors: list[DataFrame]) -> DataFrame:
    """Files that any selector (norm_path) names; all files if there is none."""
    if not selectors:
        return files
    names = selectors[0].select("norm_path")
    for s in selectors[1:]:
        names = names.union(s.select("norm_path"))
    return files.join(names.distinct(), "norm_path", "left_semi")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a JSON report, with their place in it."""
    schema = "findings array<struct<id:string,normalizedFilePath:string,line:int,column:int,diagnostic:string,category:string,severity:string,message:string,confidence:string,evidenceKey:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("findings").alias("pos", "f")).select("pos", "f.*").withColumn("key", F.coalesce("evidenceKey", "id"))


def capabilities(manifests: DataFrame, tokens: DataFrame, text: str = "text") -> DataFrame:
    """(path, capabilities) of package manifests; tokens: (package, token), a vocabulary."""
    m = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, type string")
    dep = F.map_entries(F.map_concat(*[F.coalesce(m[k], F.create_map().cast("map<string,string>")) for k in ("peerDependencies",)]))
    each = manifests.select("path", F.explode_outer(F.concat(dep, *[F.coalesce(F.map_entries(m[k]), F.array().cast("array<struct<key:string,value:string>>")) for k in ("dependencies", "devDependencies")])).alias("d"), m["type"].alias("type"))
    j = each.join((tokens), F.col("d.key") == F.col("package"), "left")
    major = F.regexp_extract("d.value", r"(\d+)", 1)
    own = F.when(F.col("token").isNotNull(), F.when(major != "", F.array(F.col("token"), F.concat("token", F.lit(":"), major))).otherwise(F.array("token"))).otherwise(F.array().cast("array<string>"))
    return j.groupBy("path").agg(F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list(own)), F.array(F.lit("node"), F.max(F.when(F.col("type") == "module", "esm").otherwise("cjs")))))).alias("capabilities"))


def codeowners(texts: DataFrame, text: str = "text") -> DataFrame:
    """(ordinal, pattern, owners): comments go, patterns without owners stay."""
    lines = texts.select(F.posexplode(F.split(text, "\r?\n")).alias("ordinal", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).filter("line <> ''")
    parts = F.split("line", r"\s+")
    return lines.select("ordinal", parts[0].alias("glob"), F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.contains("@")).alias("owners"))


def npm_lock(texts: DataFrame, text: str = "text") -> DataFrame:
    """(path, name, version, dev) of lock files of version 2 or 3; the root entry is left out."""
    p = F.from_json(text, "packages map<string,struct<version:string,dev:boolean>>")["packages"]
    e = texts.select("path", F.explode(F.map_entries(p)).alias("e")).filter("e.key <> ''")
    return e.select("path", F.regexp_replace("e.key", r"^.*node_modules/", "").alias("name"), F.col("e.value.version").alias("version"), F.coalesce("e.value.dev", F.lit(False)).alias("dev"))


def yarn_lock(texts: DataFrame, text: str = "text") -> DataFrame:
    """(path, name, version) of yarn lock files, by blocks."""
    blocks = texts.select("path", F.explode(F.split(text, r"\n\n+")).alias("b"))
    name = F.regexp_extract("b", r'(?m)^"?((?:@[^/\s"]+/)?[^@\s"]+)@', 1)
    version = F.regexp_extract("b", r'(?m)^\s+version:?\s+"?([^"\s]+)"?', 1)
    return blocks.select("path", name.alias("name"), version.alias("version")).filter("name <> '' and version <> ''")


def pnpm_lock(texts: DataFrame, text: str = "text") -> DataFrame:
    """(path, name, version) of pnpm lock files: keys such as /name@1.2.3 or name@1.2.3."""
    k = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s{2,}'?/?((?:@[^/\s']+/)?[^@\s'/(]+@\d[^\s':(]*)"), F.lit(1))
    e = texts.select("path", F.explode(F.array_distinct(k)).alias("e"))
    return e.select("path", F.regexp_extract("e", r"^(.+)@[^@]+$", 1).alias("name"), F.regexp_extract("e", r"@([^@]+)$", 1).alias("version"))


HUNK_LINES = "path string, hunk int, kind string, pos int, line int, text string"


def unified_diff(texts: DataFrame, text: str = "text") -> DataFrame:
    """Added and deleted lines of unified diffs with their numbers. The counters of a hunk run over its lines, so a
    diff is parsed by one pass in Python."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b[text]:
                path, hunk, old, new = None, -1, 0, 0
                for pos, x in enumerate((t or "").split("\n")):
                    if x.startswith("+++ "):
                        path = re.sub(r"^\+\+\+ (?:b/)?", "", x)
                    elif m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", x):
                        hunk, old, new = hunk + 1, int(m[1]), int(m[2])
                    elif hunk >= 0 and x.startswith("-") and not x.startswith("--- "):
                        rows.append((path, hunk, "del", pos, old, x[1:]))
                        old += 1
                    elif hunk >= 0 and x.startswith("+"):
                        rows.append((path, hunk, "add", pos, new, x[1:]))
                        new += 1
                    elif hunk >= 0 and x.startswith(" "):
                        old, new = old + 1, new + 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HUNK_LINES.split(", ")])

    return texts.select(text).mapInPandas(run, HUNK_LINES)


INSTRUCTIONS = "path string, ordinal int, line int, stage int, op string, args string"


def dockerfile(texts: DataFrame, text: str = "text") -> DataFrame:
    """Instructions with continuation lines joined and the build stage that they belong to."""

    def run(batches):
        for b in batches:
            rows = []
            for path, t in zip(b["path"], b[text], strict=True):
                n, stage, kept, first = 0, -1, "", 0
                for i, x in enumerate((t or "").split("\n"), 1):
                    if not kept and (not x.strip() or x.lstrip().startswith("#")):
                        continue
                    first = first or i
                    kept += x.rstrip("\r")
                    if kept.endswith("\\"):
                        kept = kept[:-1] + " "
                        continue
                    op, _, args = kept.strip().partition(" ")
                    stage += op.upper() == "FROM"
                    rows.append((path, n, first, stage, op.upper(), args.strip()))
                    n, kept, first = n + 1, "", 0
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INSTRUCTIONS.split(", ")])

    return texts.select("path", text).mapInPandas(run, INSTRUCTIONS)


def mutable_base_images(instructions: DataFrame) -> DataFrame:
    """FROM lines without digest that follow no tag or `latest`; earlier stages and templates are not images."""
    f = instructions.filter("op = 'FROM'").withColumn("image", F.regexp_extract("args", r"^(?:--\S+\s+)*(\S+)", 1)).withColumn("name", F.lower(F.regexp_extract("args", r"(?i)\sAS\s+(\S+)\s*$", 1)))
    names = f.filter("name <> ''").select("path", F.col("name").alias("image_key")).distinct()
    f = f.withColumn("image_key", F.lower("image")).join(names, ["path", "image_key"], "left_anti")
    tag = F.regexp_extract("image", r":([^/:]+)$", 1)
    return f.filter(~F.col("image").contains("@") & ~F.col("image").contains("$") & (F.col("image_key") != "scratch")).filter((tag == "") | tag.rlike(r"(?i)(^|-)latest$")).select("path", "line", "image")


def users(instructions: DataFrame) -> DataFrame:
    """(path, stage, line, user) of each build stage: its last USER, else what the stage that it builds on has, else null."""
    from factloom.operators.graph import scope_closure

    start = instructions.filter("op = 'FROM'")
    image = F.lower(F.regexp_extract("args", r"^(?:--\S+\s+)*(\S+)", 1))
    named = start.select("path", F.lower(F.regexp_extract("args", r"(?i)\sAS\s+(\S+)\s*$", 1)).alias("image"), F.col("stage").alias("base")).filter("image <> ''")
    key = lambda c: F.concat_ws("#", "path", c)
    stages = start.select("path", "stage", "line", image.alias("image")).join(named, ["path", "image"], "left").filter("base is null or base < stage")
    parents = stages.groupBy("path", "stage", "line").agg(F.max("base").alias("base")).select("path", "stage", "line", key("stage").alias("scope"), F.when(F.col("base").isNotNull(), key("base")).alias("parent"))
    last = instructions.filter("op = 'USER'").groupBy(key("stage").alias("ancestor")).agg(F.max_by("args", "ordinal").alias("user"))
    near = scope_closure(parents.select("scope", "parent")).join(last, "ancestor").groupBy("scope").agg(F.min_by("user", "dist").alias("user"))
    return parents.join(near, "scope", "left").select("path", "stage", "line", "user")


def runs_as_root(instructions: DataFrame) -> DataFrame:
    """dockerfile-runs-as-root: files whose last stage has no user but root."""
    final = users(instructions).groupBy("path").agg(F.max_by(F.struct("line", "user"), "stage").alias("x")).select("path", "x.*")
    root = F.coalesce(F.regexp_extract("user", r"^([^:\s]+)", 1).isin("root", "0"), F.lit(True))
    return final.filter(root).select(F.col("path").alias("norm_path"), "line", F.lit(1).alias("col"), F.lit("dockerfile-runs-as-root").alias("diagnostic"))
