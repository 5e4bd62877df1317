"""Version history, ownership and blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import age_days, half_up


def churn(commit_files: DataFrame, commits_scanned: Column, path: str = "path") -> DataFrame:
    """Per file: commits, authors, last commit index and score. commit_files: (commit_index, author, path).

    Each axis is divided by its maximum over all files; that is one aggregated row, joined as such.
    """
    g = commit_files.groupBy(path).agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.min("commit_index").alias("last_index"))
    top = g.agg(F.max("commits").alias("mc"), F.max("authors").alias("ma"))
    n = commit_files.agg(commits_scanned.alias("n"))
    recency = F.when(F.col("n") > 1, 1 - F.col("last_index") / (F.col("n") - 1)).otherwise(1.0)
    score = half_up(100 * (0.5 * F.col("commits") / F.col("mc") + 0.2 * F.col("authors") / F.col("ma") + 0.3 * recency)).cast("long")
    return g.join(F.broadcast(top)).join(F.broadcast(n)).select(path, "commits", "authors", "last_index", score.alias("score"))


def magnets(churned: DataFrame, commits_scanned: int, path: str = "path", floor: int = 70, least: int = 3, most: int = 10) -> DataFrame:
    """Top files by churn; none if fewer than ten commits were scanned."""
    if commits_scanned < 10:
        return churned.limit(0)
    return churned.filter((F.col("score") >= floor) & (F.col("commits") >= least)).orderBy(F.desc("score"), F.desc("commits"), path).limit(most)


def rank_by_churn(findings: DataFrame, churned: DataFrame, path: str = "path", pos: str = "pos") -> DataFrame:
    """Findings with their file's churn score (0 if none) and their place in the new order."""
    j = findings.join(churned.select(path, F.col("score").alias("churn")), path, "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    return j.orderBy(F.desc("churn"), pos)


def commit_index(log: DataFrame, repository: str | None = None) -> DataFrame:
    """Log text to (commit_index, author, path). log: (pos, line), headers are 'commit<TAB>author'.

    Header carry-forward is a running count over the text's order, inside each repository if that column is named.
    """
    w = (Window.partitionBy(repository) if repository else Window.partitionBy(F.lit(0))).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith("commit\t")
    r = log.withColumn("commit_index", F.sum(head.cast("int")).over(w) - 1).withColumn("author", F.last(F.when(head, F.regexp_extract("line", r"^commit\t(.*)$", 1)), ignorenulls=True).over(w))
    return r.filter(~head & (F.col("line") != "")).select(*([repository] if repository else []), "commit_index", "author", F.col("line").alias("path"))


def owners(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """(path, owner): the last rule that matches wins, one without owners clears; '(unowned)' if none is left.

    rules: (ordinal, pattern, owners) with Java patterns; a file of rules, so it is broadcast.
    """
    each = paths.select(path).distinct()
    hit = each.join(F.broadcast(rules), F.rlike(F.col(path), F.col("pattern")), "left").groupBy(path).agg(F.max_by("owners", "ordinal").alias("owners"))
    some = F.when(F.size(F.coalesce("owners", F.array().cast("array<string>"))) > 0, F.col("owners")).otherwise(F.array(F.lit("(unowned)")))
    return hit.select(path, F.explode(some).alias("owner"))


def blame_ages(findings: DataFrame, blame: DataFrame, commits: DataFrame, now: Column) -> DataFrame:
    """Findings with sha, author and age in days; null where a line has no commit. blame: (path, line, sha)."""
    return _aged(findings.join(blame, ["path", "line"], "left"), commits, now)


def _aged(blamed: DataFrame, commits: DataFrame, now: Column) -> DataFrame:
    zero = "0" * 40
    j = blamed.join(commits, "sha", "left")
    return j.withColumn("age", F.when((F.col("sha") != zero) & F.col("committed_at").isNotNull(), age_days(now, F.col("committed_at"))))


def blame_of_pairs(files: DataFrame, lines: DataFrame, key: str, blame: DataFrame) -> DataFrame:
    """(path, line, sha) of those pairs of files (path, key) and lines (line, key) with one key that have blame.

    It begins with the blame, so no pair without any is made.
    """
    return blame.join(files, "path").join(lines, ["line", key]).select("path", "line", "sha")


SPREAD, LINES_A_ROW = 16, 1 << 14


def blame_ages_of_pairs(files: DataFrame, lines: DataFrame, key: str, blame: DataFrame, commits: DataFrame, now: Column) -> DataFrame:
    """blame_ages, as (path, line, sha, age), of all pairs of files (path, key) and lines (line, key) with one key.

    The pairs grow with the square of both and are not moved: those that have blame are found from the blame, and a file
    brings their lines to where its other pairs are made.
    """
    from factloom.operators.graph import cut

    hit = cut(blame_of_pairs(files, lines, key, blame))
    known = hit.groupBy("path").agg(F.collect_set("line").alias("_known"))
    # lines travel as arrays, several to a key, and each array goes to SPREAD shares of the files: keys may be few
    parts = 1 + lines.count() // LINES_A_ROW
    share = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_share")
    packed = lines.groupBy(key, F.pmod(F.xxhash64("line"), F.lit(parts)).alias("_part")).agg(F.collect_list(F.struct("line")).alias("_lines")).select(key, "_lines", share)
    dealt = files.join(known, "path", "left").withColumn("_share", F.pmod(F.hash("path"), F.lit(SPREAD)))
    rest = dealt.join(packed, [key, "_share"]).select("path", "_known", F.inline("_lines")).filter(~F.coalesce(F.array_contains("_known", F.col("line")), F.lit(False)))
    aged = _aged(hit, commits, now).select("path", "line", "sha", "age")
    return aged.union(rest.select("path", "line", *(F.lit(None).cast(aged.schema[c].dataType).alias(c) for c in ("sha", "age"))))


def age_summary(aged: DataFrame, group: str, recent: int = 30) -> DataFrame:
    """Lower median, oldest and recent counts of ages."""
    return aged.groupBy(group).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY age)").cast("long").alias("median_age"), F.max("age").alias("oldest"), F.count_if(F.col("age") <= recent).alias("recent"), F.count_if(F.col("age").isNull()).alias("undated"))


def ai_signal(body: Column) -> Column:
    """trailer, marker or null."""
    return F.when(body.rlike(r"(?im)^co-authored-by:.*\b(copilot|assistant|bot|ai)\b"), "trailer").when(body.rlike(r"(?i)generated (with|by) .*\b(ai|assistant|copilot)\b"), "marker")


def changed_by(findings: DataFrame, blame: DataFrame, shas: DataFrame) -> DataFrame:
    """Findings on lines whose commit is one of shas."""
    return findings.join(changed_lines(blame, shas), ["path", "line"])


def changed_lines(blame: DataFrame, shas: DataFrame) -> DataFrame:
    return blame.join(shas.select("sha").distinct(), "sha")


def positional_pairs(lines: DataFrame) -> DataFrame:
    """Deleted and added lines of a hunk paired by place, where both sides have as many. lines: (hunk, kind, pos, text)."""
    w = Window.partitionBy("hunk", "kind")
    r = lines.withColumn("n", F.row_number().over(w.orderBy("pos"))).withColumn("size", F.count("*").over(w))
    d, a = (r.filter(F.col("kind") == k).select("hunk", "n", "size", F.col("text").alias(t)) for k, t in (("del", "old"), ("add", "new")))
    return d.join(a, ["hunk", "n", "size"]).select("hunk", "n", "old", "new")
