"""Graphs over edge tables (src, dst): reachability, closure, components, layers, taint.

Loops over cyclic graphs keep a frontier and an anti-join with what was visited. Every few rounds the state is
checkpointed to the shared folder, which bounds the lineage and survives lost executors.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder; a folder of this machine serves a local master only."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="factloom-"))
    return df.checkpoint()


def clean_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src <> dst").distinct()


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth): nodes that seeds (node) reach, with the shortest depth; seeds have depth 0."""
    e = edges.select("src", "dst")
    visited = frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while most is None or depth < most:
        depth += 1
        step = e.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
        if depth % 5 == 0:
            visited = cut(visited)
    return visited


def blast_radius(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Who depends on changed nodes, with the shortest depth; a changed node is not its own dependent."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, changed).filter("depth > 0")


def smallest_above(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each node, itself included. Only nodes that changed pass theirs on."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    known = changed = cut(nodes.withColumn("colour", F.col("node")))
    while not changed.isEmpty():
        offered = edges.join(changed.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
        changed = cut(known.join(offered, "node").filter("offer < colour").select("node", F.col("offer").alias("colour")))
        known = cut(known.join(changed.select("node", F.col("colour").alias("_c")), "node", "left").select("node", F.coalesce("_c", "colour").alias("colour")))
    return known


def strong_components(edges: DataFrame, trims: int = 3) -> DataFrame:
    """(node, component, size) for components of more than one node; a component is named by its smallest node.

    Every node takes the smallest node that reaches it as its colour. The nodes that reach their colour's node inside the
    colour are its component; no component crosses colours, so edges between them go, and what is left is done again.
    Nodes without a way in or out are trimmed first. No pairs of nodes are made.
    """
    e, found = cut(clean_edges(edges)), []
    while True:
        for _ in range(trims):
            e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        e = cut(e)
        if e.isEmpty():
            break
        colour = smallest_above(e)
        same = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b")), "dst").filter("_a = _b").select("src", "dst")
        same = cut(same)
        back = reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.filter("node = colour").select("node"))
        part = cut(back.select("node").join(colour, "node").select("node", F.col("colour").alias("component")))
        found.append(part)
        done = part.select("node")
        e = same.join(done.select(F.col("node").alias("src")), "src", "left_anti").join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    c = found[0]
    for part in found[1:]:
        c = c.union(part)
    return c.join(c.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1"), "component").select("node", "component", "size")


def cycle_members(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) that lie on a cycle: both ends in one strong component."""
    c = strong_components(edges).select("node", "component")
    e = clean_edges(edges).join(c.select(F.col("node").alias("src"), F.col("component").alias("_a")), "src").join(c.select(F.col("node").alias("dst"), F.col("component").alias("_b")), "dst")
    return e.filter("_a = _b").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) over distinct edges without self edges."""
    e = clean_edges(edges)
    i = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    o = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    return i.join(o, "node", "full_outer").fillna(0, ["fan_in", "fan_out"])


def hubs(degree: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    return degree.filter(F.col("fan_in") >= least).orderBy(F.desc("fan_in"), "node").limit(most)


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges against the order of layers (node, rank): upward imports, and skips from rank 0 to 2 or deeper."""
    j = clean_edges(edges).join(layers.select(F.col("node").alias("src"), F.col("rank").alias("a")), "src").join(layers.select(F.col("node").alias("dst"), F.col("rank").alias("b")), "dst")
    kind = F.when(F.col("b") < F.col("a"), "upward-import").when((F.col("a") == 0) & (F.col("b") >= 2), "layer-skip")
    return j.withColumn("kind", kind).filter("kind is not null").select("src", "dst", "kind")


def taint(seeds: DataFrame, flows: DataFrame, most: int = 12) -> DataFrame:
    """Taint over (node) by flows (src, dst): first arrival by depth, then by the smallest trail, owns the hops."""
    done = front = cut(seeds.select("node", F.lit(0).alias("depth"), F.array(F.col("node")).alias("trail")))
    for depth in range(1, most + 1):
        step = flows.join(front.select(F.col("node").alias("src"), "trail"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("trail").alias("trail"))
        front = cut(step.join(done, "node", "left_anti").select("node", F.lit(depth).alias("depth"), F.concat("trail", F.array("node")).alias("trail")))
        if front.isEmpty():
            break
        done = done.union(front)
    return done


def scope_closure(scopes: DataFrame, most: int = 64) -> DataFrame:
    """(scope, ancestor, dist) of a tree of scopes (scope, parent), itself included."""
    up = cut(scopes.select("scope", F.col("scope").alias("ancestor"), F.lit(0).alias("dist")))
    out = up
    for dist in range(1, most + 1):
        up = cut(up.join(scopes.select(F.col("scope").alias("ancestor"), F.col("parent").alias("_p")), "ancestor").filter("_p is not null").select("scope", F.col("_p").alias("ancestor"), F.lit(dist).alias("dist")))
        if up.isEmpty():
            break
        out = out.union(up)
    return out


def resolve(refs: DataFrame, bindings: DataFrame, scopes: DataFrame) -> DataFrame:
    """Identifiers to bindings: the nearest scope that defines the name, there the first definition."""
    chain = scope_closure(scopes)
    j = refs.join(chain, "scope").join(bindings.select(F.col("scope").alias("ancestor"), "name", "binding"), ["ancestor", "name"])
    return refs.join(j.groupBy("ref").agg(F.min_by("binding", F.struct("dist", "binding")).alias("binding")), "ref", "left")
