"""Join and window shapes that rules over fact tables share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containing(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Nodes with each of `outer` that holds them: intervals of pre and post order inside one file."""
    o = outer.select(F.col("file"), F.col("node").alias("outer_node"), F.col("pre").alias("_pre"), F.col("post").alias("_post"))
    return nodes.join(o, "file").filter((F.col("_pre") < F.col("pre")) & (F.col("post") < F.col("_post"))).drop("_pre", "_post")


def nearest_containing(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    c = containing(nodes, outer.withColumn("pre", F.col("pre")))
    best = c.join(outer.select(F.col("node").alias("outer_node"), F.col("pre").alias("_at")), "outer_node").groupBy("file", "node").agg(F.max_by("outer_node", "_at").alias("outer_node"))
    return nodes.join(best, ["file", "node"])


def unreachable(statements: DataFrame, parent: str, ordinal: str, ends: Column) -> DataFrame:
    """The first statement of each list that stands after one that ends it."""
    w = Window.partitionBy(parent).orderBy(ordinal)
    after = F.coalesce(F.max(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    r = statements.withColumn("_after", after).filter("_after")
    return r.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_after", "_n")


def repeated_definitions(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """All but the first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).filter("_n > 1").drop("_n")


def dominant_minority(rows: DataFrame, group: str, value: str, least: int = 10, share: float = 0.9) -> DataFrame:
    """Rows that differ from what at least `share` of their group of `least` or more has."""
    c = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    top = c.groupBy(group).agg(F.sum("n").alias("size"), F.max_by(value, F.struct("n", value)).alias("most"), F.max("n").alias("n")).filter((F.col("size") >= least) & (F.col("n") >= share * F.col("size")))
    return rows.join(top.select(group, "most", "size"), group).filter(F.col(value) != F.col("most"))


def without(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(other.select(*on).distinct(), on, "left_anti")


def topology(published: DataFrame, consumed: DataFrame) -> DataFrame:
    """(topic, publishers, consumers, state): orphan, dead consumer or connected, and whether one place does both."""
    p = published.groupBy("topic").agg(F.countDistinct("file").alias("publishers"))
    c = consumed.groupBy("topic").agg(F.countDistinct("file").alias("consumers"))
    loops = published.select("topic", "file").distinct().join(consumed.select("topic", "file").distinct(), ["topic", "file"]).groupBy("topic").agg(F.count("*").alias("loops"))
    j = p.join(c, "topic", "full_outer").join(loops, "topic", "left").fillna(0, ["publishers", "consumers", "loops"])
    return j.withColumn("state", F.when(F.col("consumers") == 0, "orphan").when(F.col("publishers") == 0, "dead-consumer").otherwise("connected"))


def lineage(uses: DataFrame) -> DataFrame:
    """(route, entity, ops) from (route, entity, op)."""
    return uses.groupBy("route", "entity").agg(F.array_sort(F.collect_set("op")).alias("ops"))


def row_frame_text(lines: DataFrame, before: int, after: int, file: str = "file", pos: str = "pos") -> Column:
    """The lines from `before` above to `after` below, joined."""
    w = Window.partitionBy(file).orderBy(pos).rowsBetween(-before, after)
    return F.array_join(F.collect_list("text").over(w), "\n")
