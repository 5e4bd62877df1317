"""Multiset comparison of reports: delta, ratchet, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SPANS = 64


def multiset_anti(left: DataFrame, right: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Rows of left beyond as many of their key as right has; the first by pos (a number) are absolved.

    Right is pre-aggregated to one row per key before the join. Rows are ranked in SPANS spans of pos, and the rows of a
    key's earlier spans are counted, so that a key that most rows have is not ranked by one task.
    """
    n = right.groupBy(*by).agg(F.count("*").alias("_n"))
    ends = left.agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))  # one row
    span = F.floor((F.col(pos) - F.col("_lo")) / F.greatest((F.col("_hi") - F.col("_lo") + 1) / SPANS, F.lit(1))).cast("int")
    spread = left.crossJoin(F.broadcast(ends)).withColumn("_s", span).drop("_lo", "_hi")
    counts = spread.groupBy(*by, "_s").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    beyond = before.join(n, by, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(F.col("_b") + F.col("_c") > F.col("_n"))
    ranked = spread.join(beyond, [*by, "_s"]).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(pos)))
    return ranked.filter(F.col("_r") + F.col("_b") > F.col("_n")).select(*left.columns)


def delta(base: DataFrame, current: DataFrame, key: str = "key", file: str = "file", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(introduced, resolved): first match inside the file, then what is left anywhere."""
    b1, c1 = multiset_anti(base, current, [key, file], pos), multiset_anti(current, base, [key, file], pos)
    return multiset_anti(c1, b1, [key], pos), multiset_anti(b1, c1, [key], pos)


def ratchet(current: DataFrame, accepted: DataFrame, history: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """Current findings beyond the accepted ones; regression if the key was resolved before."""
    new = multiset_anti(current, accepted, [key], pos)
    return new.join(history.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left").withColumn("regression", F.coalesce("_seen", F.lit(False))).drop("_seen")


def resolved_history(fresh: DataFrame, old: DataFrame, most: int = 500) -> DataFrame:
    """Fresh resolutions first, then the newest; `most` rows, which is the history's size."""
    both = fresh.select("key", "resolved_at").withColumn("fresh", F.lit(1)).unionByName(old.select("key", "resolved_at").withColumn("fresh", F.lit(0)))
    one = both.groupBy("key").agg(F.max(F.struct("fresh", "resolved_at")).alias("x")).select("key", "x.*")
    return one.orderBy(F.desc("fresh"), F.desc("resolved_at"), "key").limit(most).drop("fresh").orderBy("key")


def drift(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed and changed rows between two lists."""
    o, n = old.select(key, F.col(value).alias("old_value")), new.select(key, F.col(value).alias("new_value"))
    j = o.join(n, key, "full_outer")
    kind = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "changed")
    return j.withColumn("change", kind).filter("change is not null")


def fix_outcome(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """One row: fixed, remaining, new, as multisets of keys."""
    b, a = before.groupBy(key).agg(F.count("*").alias("b")), after.groupBy(key).agg(F.count("*").alias("a"))
    j = b.join(a, key, "full_outer").fillna(0, ["a", "b"])
    return j.agg(F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("fixed"), F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("remaining"), F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("new"))


def surface_diff(old: DataFrame, new: DataFrame, key: str, auth: str) -> DataFrame:
    """Route surfaces: a removal or an added demand for authentication breaks; a dropped demand is noted."""
    j = old.select(key, F.col(auth).alias("a")).join(new.select(key, F.col(auth).alias("b")), key, "full_outer")
    change = F.when(F.col("b").isNull(), "removed").when(~F.col("a") & F.col("b"), "auth-added").when(F.col("a") & ~F.col("b"), "auth-removed")
    return j.withColumn("change", change).filter("change is not null").select(key, "change", (F.col("change") != "auth-removed").alias("breaking"))


def package_verdict(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """Export lists (name, exports, complete): removals need both complete, additions a complete baseline."""
    j = old.select(name, F.col("exports").alias("o"), F.col("complete").alias("oc")).join(new.select(name, F.col("exports").alias("n"), F.col("complete").alias("nc")), name, "full_outer")
    none = F.array().cast("array<string>")
    removed = F.when(F.col("oc") & F.col("nc"), F.array_sort(F.array_except("o", "n"))).otherwise(none)
    added = F.when(F.col("oc"), F.array_sort(F.array_except("n", "o"))).otherwise(none)
    out = j.select(name, removed.alias("removed"), added.alias("added"), F.col("o").isNull().alias("new_package"), F.col("n").isNull().alias("gone"))
    verdict = F.when(F.col("gone") | (F.size("removed") > 0), "major").when(F.col("new_package") | (F.size("added") > 0), "minor").otherwise("patch")
    return out.select(name, verdict.alias("verdict"), F.size(F.coalesce("removed", none)).alias("n_removed"), F.size(F.coalesce("added", none)).alias("n_added"))
