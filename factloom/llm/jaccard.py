"""Operator 9, n-gram Jaccard join by chosen paths.

A document is the set of its hashed 5-word shingles (all its words if it has fewer); documents with equal sets are one
class, which has a number of its own. A run of the join splits classes recursively: at the root every class follows the
FAN tokens of its set that hash lowest under the run, below it the minhash tokens that it has in FAN bins drawn by the
path, so two similar sets share a child with a probability that grows with their similarity. Only nodes of more than
LIMIT classes are split again; smaller ones are compared by brute force on sketches of bounded error. A node that a split
does not make smaller holds classes that are all alike, or hardly: some of its members, drawn by hash, are compared with
all of them, and if that links most of it the rest is compared with all of it too, in tiles (so is every such node of up to
BRUTE classes); otherwise it is split on. No node is taken as it is and no depth ends the recursion.

FAN children of which a pair at the threshold shares each with a chance of 0.8 are a branching process that dies out with
a chance of (0.2 + 0.8 q)**2 = q, 1/16, however deep it goes, so runs are repeated until the expected recall at the
threshold reaches RECALL. The sketches' floor lies 6 deviations below the threshold (measured deviations of the sketch
are 0.87 to 0.98 of the ones used).

Sketch links make families, supersets of the true groups. Each family's sets meet once, in tiles if the family is
large, and there all pairs are decided exactly by set intersection. Tasks return counts and spanning forests, not pairs.

Defined cases: a null or empty text links with nothing; a null doc_id has no class (null) and links with nothing; rows
are documents, so repeated rows link with each other, and rows that repeat a doc_id with another text are judged by that
text; ties cannot arise (the threshold itself links); other columns are ignored, whatever their names; an empty table
gives an empty result; very long texts are sets like any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, join_counted, parallelism, pieces, small_batches, stored, table
from .textops import BYTES, Rolling, Texts, min_labels, mix, ranges

U64 = np.uint64
WORDS, THRESHOLD = 5, 0.8
FAN, LIMIT = 2, 512
RECALL = 0.9999
MISS = 0.0625
"""A run's chance to lose a pair at the threshold."""
RUNS = math.ceil(math.log(1 - RECALL) / math.log(MISS))
BINS = 128
KEEP = 0.7
"""A child with this share of its parent's classes has not become smaller."""
BRUTE, PROBES, PROBE_TILE = 1 << 14, 16, 4096
"""Such a node is compared in whole up to this size; members drawn first, on average; classes of a tile."""
TILE, TILE_BYTES = 1024, 16 << 20
ROLL, ROLL2 = Rolling(808, 0), Rolling(909, 0)


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, back to back and sorted in each text, and where each text's begin."""
    starts, ends, first = texts.words()
    h = BYTES.spans(texts.data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    at = ranges(first[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    out = np.zeros(len(at), U64)
    left = np.repeat(first[1:], count) - at
    for k in range(WORDS):
        some = left > k
        out = out * U64(ROLL.base) + np.where(some, h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else U64(0), U64(k + 1))
    out = mix(out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(len(n) + 1))


def lowest(tokens: np.ndarray, seeds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set (none empty) the hashes of its FAN tokens that are lowest under its seed; a set of one gives it twice."""
    n = np.diff(first)
    h = mix(tokens ^ np.repeat(seeds, n))
    one = np.minimum.reduceat(h, first[:-1])
    h[h == np.repeat(one, n)] = U64(2**64 - 1)
    two = np.minimum.reduceat(h, first[:-1])
    return np.stack([one, np.where(two == U64(2**64 - 1), one, two)], axis=1)


def roots(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The nodes below the root that each set visits: RUNS x FAN hashes."""
    out = []
    for run in range(RUNS):
        seed = mix(np.array([run + 1], U64))[0]
        out.append(mix(lowest(tokens, np.full(len(first) - 1, seed), first) ^ (seed * U64(3))))
    return np.concatenate(out, axis=1)


def sketch(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One-permutation minhash, 16 bits in each of BINS bins; empty bins borrow from the next full one."""
    n = len(first) - 1
    h = mix(tokens + U64(12345))
    owner = np.repeat(np.arange(n), np.diff(first))
    low = np.full(n * BINS, 2**32 - 1, np.uint32)
    np.minimum.at(low, owner * BINS + (h % U64(BINS)).astype(np.int64), ((h >> U64(33)) & U64(0x7FFFFFFF)).astype(np.uint32))
    low = low.reshape(n, BINS)
    full = low != 2**32 - 1
    at = np.where(np.concatenate([full, full], axis=1), np.arange(2 * BINS), 10**6)
    nxt = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    shift = nxt - np.arange(BINS)
    return (np.take_along_axis(low, nxt % BINS, axis=1) * np.uint32(2654435761) + shift.astype(np.uint32) * np.uint32(40503) >> np.uint32(16)).astype(np.uint16)


def floor_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins below which two sets of these sizes are taken as unlike: 6 deviations under the threshold."""
    k = np.minimum(np.minimum(a, b), BINS)
    return THRESHOLD - 6 * np.sqrt(THRESHOLD * (1 - THRESHOLD) / np.maximum(k, 1))


def keyed(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a word: their positions, their shingles, where each one's begin, and a 128-bit key of the set in two parts."""
    tokens, first = shingles(texts)
    some = np.flatnonzero(np.diff(first) > 0)
    first = np.append(first[some], first[-1])
    if not len(some):
        return some, tokens, first, np.zeros(0, np.int64), np.zeros(0, np.int64)
    k1, k2 = np.add.reduceat(mix(tokens), first[:-1]), np.add.reduceat(mix(tokens + U64(99)), first[:-1])
    return some, tokens, first, k1.view(np.int64), k2.view(np.int64)


SETS = "doc_id long, n int, k1 long, k2 long, nodes array<long>, sketch binary"


def sets_of(docs: DataFrame) -> DataFrame:
    """Per row with a doc_id and a word: size, a 128-bit key of the set, its nodes below the root, its sketch."""

    def run(batches):
        for b in pieces(batches):
            some, tokens, first, k1, k2 = keyed(Texts(b.column("text")))
            if not len(some):
                continue
            nodes = roots(tokens, first)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(some)), pa.array(np.diff(first).astype(np.int32)), pa.array(k1), pa.array(k2),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * nodes.shape[1], pa.int32()), pa.array(nodes.reshape(-1).view(np.int64))),
                    pa.array([r.tobytes() for r in sketch(tokens, first)], pa.binary()),
                ],
                ["doc_id", "n", "k1", "k2", "nodes", "sketch"],
            )

    return docs.mapInArrow(run, SETS)


def sketches(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, n = rows.column("cid").to_numpy(), rows.column("n").to_numpy().astype(np.int64)
    return ids, n, np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(len(ids), BINS)


def forest(ids: np.ndarray, label: np.ndarray) -> pa.Table:
    own = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table([pa.array(ids[own]), pa.array(ids[label[own]])], names=["u", "v"])


def brute_force(rows: pa.Table) -> pa.Table:
    """Sketch links inside each node of a shard of small nodes: edges of a spanning forest."""
    rows = rows.sort_by([("node", "ascending"), ("cid", "ascending")])
    node = rows.column("node").to_numpy()
    ids, n, sk = sketches(rows)
    cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(cuts, len(node)))
    label = np.arange(len(node))
    # pairs of all nodes, a bounded number at a time
    before = np.arange(len(node)) - np.repeat(cuts, sizes)  # each row is paired with the rows before it in its node
    done = np.concatenate([[0], np.cumsum(before)])
    i = 0
    while i < len(node):
        j = max(i + 1, int(np.searchsorted(done, done[i] + (1 << 17), "right")) - 1)
        a = np.repeat(np.arange(i, j), before[i:j])
        b = ranges(np.arange(i, j) - before[i:j], before[i:j])
        todo = label[a] != label[b]
        a, b = a[todo], b[todo]
        if len(a):
            share = np.empty(len(a))
            for k in range(0, len(a), 1 << 14):
                share[k : k + (1 << 14)] = (sk[a[k : k + (1 << 14)]] == sk[b[k : k + (1 << 14)]]).mean(1)
            ratio = np.minimum(n[a], n[b]) >= THRESHOLD * np.maximum(n[a], n[b])
            hit = ratio & (share >= floor_of(n[a], n[b]))
            if hit.any():
                old = np.flatnonzero(label != np.arange(len(node)))
                label = min_labels(len(node), np.concatenate([a[hit], old]), np.concatenate([b[hit], label[old]]))
        i = j
    return forest(ids, label)


def probe(rows: pa.Table) -> pa.Table:
    """Sketch links of the probes (side 0) with the members (side 1) of a tile of a node: (node, probe, member)."""
    ids, n, sk = sketches(rows)
    member = rows.column("side").to_numpy() == 1
    left, right = np.flatnonzero(~member), np.flatnonzero(member)
    out = [np.zeros((0, 2), np.int64)]
    for a in left.tolist():
        b = right[np.minimum(n[right], n[a]) >= THRESHOLD * np.maximum(n[right], n[a])]
        hit = b[(sk[b] == sk[a]).mean(1) >= floor_of(n[b], n[a])]
        out.append(np.stack([np.full(len(hit), ids[a]), ids[hit]], axis=1))
    out = np.concatenate(out)
    node = rows.column("node")[0].as_py() if rows.num_rows else 0
    return pa.table([pa.array(np.full(len(out), node, np.int64)), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["node", "probe", "member"])


def linked_in(rows: pa.Table) -> pa.Table:
    """The same as edges of a spanning forest (u, v)."""
    hits = probe(rows)
    a, b = hits.column("probe").to_numpy(), hits.column("member").to_numpy()
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    return forest(ids, min_labels(len(ids), code[: len(a)], code[len(a) :]))


def tiled(members: DataFrame, parts, probes: DataFrame):
    """The probes (cid, node, m, n, sketch, q of parts) with all members of their nodes, by tile and part."""
    tiles, own = F.ceil(F.col("m") / PROBE_TILE), ["cid", "node", "n", "sketch"]
    right = members.select(*own, F.pmod(F.xxhash64("cid"), tiles).alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("q"), F.lit(1).alias("side"))
    left = probes.select(*own, F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"), "q", F.lit(0).alias("side"))
    return left.unionByName(right).groupBy("node", "tile", "q")


def families(classes: DataFrame) -> DataFrame:
    """(node cid, component) of classes that have a sketch link, by the join's runs."""
    shards = 4 * parallelism(classes.sparkSession)
    visits, edges, level = classes.select("cid", F.explode(F.array_distinct("nodes")).alias("node"), F.lit(0).cast("long").alias("parent")), [], 1
    while True:
        counts = cut(visits.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1"))
        total, most = counts.agg(F.sum("m"), F.max("m")).first()
        if not total:
            break
        placed = cut(join_counted(visits, counts, ["node"], "m", total))
        if level == 1:  # from here on the classes of open nodes carry what is needed of them
            placed = placed.join(classes.select("cid", "n", "sketch"), "cid")
        small = placed.filter(F.col("m") <= LIMIT).select("cid", "node", "n", "sketch")
        edges.append(small.withColumn("_s", F.pmod(F.xxhash64("node"), F.lit(shards))).groupBy("_s").applyInArrow(brute_force, "u long, v long"))
        if most <= LIMIT:
            break
        large = placed.filter(F.col("m") > LIMIT)
        if level > 1:
            stuck = large.filter(F.col("m") >= KEEP * F.col("parent"))
            size = stuck.count()
            if size:
                more, rest = compared(stuck, size)
                edges += more
                large = large.filter(F.col("m") < KEEP * F.col("parent")).unionByName(rest)
        bins = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(BINS)) for k in range(FAN)]
        below = F.array(*[F.xxhash64("node", F.lit(k), F.substring("sketch", 2 * b + 1, F.lit(2))) for k, b in enumerate(bins)])
        visits = cut(large.select("cid", F.explode(below).alias("node"), F.col("m").alias("parent"), "n", "sketch"))
        level += 1
    out = classes.select(F.col("cid").alias("u"), F.col("cid").alias("v")).limit(0)
    for e in edges:
        out = out.union(e)
    return components(out)


def compared(stuck: DataFrame, size: int) -> tuple[list[DataFrame], DataFrame]:
    """Edges of nodes (cid, node, m, parent, n, sketch) that a split did not make smaller, and the nodes to be split on.

    Some members are compared with all; the one that most are linked with is the node's pivot. Pairs of members that are
    linked with the pivot are of one family; the others are compared with all members.
    """
    drawn = stuck.filter(F.pmod(F.xxhash64("cid", "node"), F.lit(1 << 30)) < F.lit(PROBES << 30) / F.col("m")).withColumn("q", F.lit(0).cast("long"))
    hits = cut(tiled(stuck, F.lit(1).cast("long"), drawn).applyInArrow(probe, "node long, probe long, member long"))
    pivots = hits.groupBy("node", "probe").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("probe", F.struct("c", "probe")).alias("probe"), F.max("c").alias("c"))
    sizes = stuck.groupBy("node").agg(F.first("m").alias("m"))
    pivots = cut(sizes.join(pivots, "node", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long"))))
    known = join_counted(stuck.drop("m"), pivots, ["node"], "m", size)
    own = hits.select("node", "probe", F.col("member").alias("cid"), F.lit(True).alias("linked"))
    known = cut(known.join(own, ["node", "probe", "cid"], "left"))
    whole = (F.col("m") <= BRUTE) | (2 * F.col("c") >= F.col("m"))
    parts = F.ceil((F.col("m") - F.col("c")) / PROBE_TILE)
    others = known.filter(whole & F.col("linked").isNull()).withColumn("q", F.pmod(F.xxhash64("cid", F.lit(7)), parts))
    rest = known.filter(~whole).select("cid", "node", "parent", "n", "sketch", "m")
    near = known.filter("linked").select(F.col("cid").alias("u"), F.col("probe").alias("v"))
    return [near, tiled(known.filter(whole & (F.col("c") < F.col("m"))), parts, others).applyInArrow(linked_in, "u long, v long")], rest


def exact_pairs(rows: pa.Table) -> pa.Table:
    """Decide all pairs of each family of a task (or between two tiles of one) by the sizes of set intersections."""
    blobs = [np.frombuffer(x.as_buffer(), U64) for x in rows.column("tokens")]
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    tokens, first = np.concatenate(blobs), np.concatenate([[0], np.cumsum(size)])
    del blobs
    family, ids, mult, side = (rows.column(c).to_numpy() for c in ("family", "cid", "mult", "side"))
    between = rows.num_rows > 0 and rows.column("p")[0] != rows.column("q")[0]
    out_id, out_links, out_root = [], [], []
    order = np.lexsort((ids, side, family))
    cuts = np.flatnonzero(np.append(True, family[order][1:] != family[order][:-1]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        own = order[lo:hi]
        m = len(own)
        if m < 2:
            continue
        lengths = size[own]
        flat = tokens[ranges(first[own], lengths)]
        _, code = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(m), lengths)
        count = np.bincount(code)
        keep = count[code] > 1
        code, owner = code[keep], owner[keep]
        universe, code = np.unique(code, return_inverse=True)
        common = np.zeros((m, m), np.float32)
        by_code = np.argsort(code, kind="stable")
        code, owner = code[by_code], owner[by_code]
        step = max(1, (1 << 22) // m)
        for k in range(0, len(universe), step):
            i, j = np.searchsorted(code, [k, k + step])
            block = np.zeros((m, min(step, len(universe) - k)), np.float32)
            block[owner[i:j], code[i:j] - k] = 1
            common += block @ block.T
        union = lengths[:, None] + lengths[None, :] - common
        link = common >= THRESHOLD * union - 1e-6
        # 0.8 of a union of whole numbers is met or missed by 0.2 at least
        np.fill_diagonal(link, False)
        if between:
            link &= side[own][:, None] != side[own][None, :]
        a, b = np.nonzero(np.triu(link))
        if not len(a):
            continue
        label = min_labels(m, a, b)
        links = link @ mult[own]
        hit = np.flatnonzero(links)
        out_id.append(ids[own][hit])
        out_links.append(links[hit].astype(np.int64))
        out_root.append(ids[own][label[hit]])
    none = [np.zeros(0, np.int64)]
    return pa.table([pa.array(np.concatenate(x or none)) for x in (out_id, out_links, out_root)], names=["cid", "links", "root"])


def tokens_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, tokens) of the wanted classes (cid, doc_id, k1, k2); other texts of the same doc_id are left out."""

    def run(batches):
        for b in pieces(batches):
            some, tokens, first, k1, k2 = keyed(Texts(b.column("text")))
            same = (b.column("k1").to_numpy()[some] == k1) & (b.column("k2").to_numpy()[some] == k2)
            at = np.flatnonzero(same)
            blobs = [tokens[first[i] : first[i + 1]].tobytes() for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("cid").take(pa.array(some[at])), pa.array(blobs, pa.binary())], ["cid", "tokens"])

    return docs.join(wanted, "doc_id").mapInArrow(run, "cid long, tokens binary").dropDuplicates(["cid"])


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id that links reach), n_links (other rows with a similarity of the threshold or more)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text")
    docs = rows.filter("doc_id is not null")
    sets = stored(sets_of(docs), "jaccard-sets")
    keys = sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("mult"))
    # one row of each class; its number is fixed by being written
    classes = sets.join(keys, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"])
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    family = cut(families(classes).join(classes.select(F.col("cid").alias("node"), "mult", "n"), "node"))
    total, size = family.agg(F.count("*"), F.sum("n")).first()
    sizes = cut(family.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("size")))
    shards = max(4 * parallelism(spark), 8 * (size or 0) // (2 * TILE_BYTES))
    put = join_counted(family, sizes, ["component"], "m", total).withColumn("tiles", F.ceil(F.greatest(F.col("m") / TILE, 8 * F.col("size") / TILE_BYTES)))
    put = put.withColumn("i", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    put = put.select(
        F.col("node").alias("cid"), F.col("component").alias("family"), "mult", F.least("i", "o").alias("p"), F.greatest("i", "o").alias("q"), F.when(F.col("i") <= F.col("o"), 0).otherwise(1).alias("side"),
        F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(shards))).otherwise(F.lit(-1)).alias("shard"),
    )
    put = put.withColumn("whole", F.when(F.col("shard") < 0, F.col("family")))
    wanted = classes.select("cid", "doc_id", "k1", "k2").join(family.select(F.col("node").alias("cid")), "cid", "left_semi")
    found = cut(put.join(tokens_of(docs, wanted), "cid").groupBy("shard", "whole", "p", "q").applyInArrow(exact_pairs, "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cid"), "component")
    linked = cut(linked.join(classes.select("cid", "doc_id"), "cid"))
    least = cut(linked.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("c")))
    named = join_counted(linked.select("cid", "component"), least, ["component"], "c", linked.count()).select("cid", "class_id")
    info = classes.select("cid", "k1", "k2", "mult", F.col("doc_id").alias("own")).join(links, "cid", "left").join(named, "cid", "left")
    info = cut(info.select("k1", "k2", "mult", F.coalesce("class_id", "own").alias("class_id"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = join_counted(sets.select("doc_id", "k1", "k2"), info, ["k1", "k2"], "mult", sets.count()).select("doc_id", "class_id", "n_links")
    without = rows.filter(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return out.union(without.select("doc_id", "doc_id", F.lit(0).cast("long")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(words[i:i+4], ' ') AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 5 * k >= 4 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT u, min(v) AS class_id FROM r GROUP BY u),
k AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
SELECT m.u AS doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM m LEFT JOIN k ON k.u = m.u
"""
