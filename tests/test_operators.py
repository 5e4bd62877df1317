"""Operators of the library: a case that fires, one that stays silent, and the edges between."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions import globs
from factloom.functions import scalars as S
from factloom.operators import delta, findings, graph, history, rulekit, scoring, selection, suggest, textscan
from factloom.sources import files, sinks
from factloom.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, S.half_up(F.col("v"), 2), v=1.005) == 1.0
    assert one(spark, S.half_up(F.col("v")), v=-2.5) == -2
    assert [one(spark, S.line_count(F.col("v")), v=x) for x in ("", "a", "a\n", "a\nb")] == [0, 1, 2, 2]
    assert one(spark, S.evidence_text(F.col("v")), v="  a \n b  ") == "a b"
    assert one(spark, S.path_template(F.col("v")), v="/a/:id/b/:x_y") == "/a/{id}/b/{x_y}"
    assert one(spark, S.placeholders(F.col("v")), v="{{ b }} {{a}} {{b}}") == ["a", "b"]
    assert [one(spark, S.dependency_class(F.col("v")), v=x) for x in ("1.2.3", "^1.2.3", "latest", "git+ssh://x", "https://x/y.tgz")] == ["exact", "range", "tag", "git", "url"]
    assert one(spark, S.purl(F.col("n"), F.col("v")), n="@a/B", v="1.0.0") == "pkg:npm/%40a/b@1.0.0"
    assert one(spark, S.version_parts(F.col("v")), v="v1.22.3-rc") == [1, 22, 3]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("**/node_modules/**", "a/node_modules/b.js", "a/modules/b.js"), ("*.ts", "a.ts", "d/a.ts"), ("**/*.min.js", "x/y.min.js", "x/ymin.js"), ("src/?.js", "src/a.js", "src/ab.js")],
)
def test_globs(spark, glob, yes, no):
    r = globs.glob_to_regex(glob)
    assert one(spark, F.col("v").rlike(r), v=yes) and not one(spark, F.col("v").rlike(r), v=no)


def test_owner_patterns(spark):
    match = lambda p, x: one(spark, F.col("v").rlike(globs.owner_pattern_to_regex(p)), v=x)
    assert match("docs/", "docs/a/b.md") and match("docs/*", "docs/a.md") and not match("docs/*", "docs/a/b.md")
    assert match("*.js", "a/b.js") and match("/src", "src/x") and not match("/src", "a/src/x")


def test_last_owner_wins(spark):
    rules = files.codeowners(spark.createDataFrame([("* @all # c\r\n*.js @js\n/gen/\n",)], "text string"))
    compiled = spark.createDataFrame([(r.ordinal, globs.owner_pattern_to_regex(r.glob), r.owners) for r in rules.collect()], "ordinal int, pattern string, owners array<string>")
    paths = spark.createDataFrame([("a.md",), ("b.js",), ("gen/b.js",)], "path string")
    assert rows(history.owners(paths, compiled)) == [("a.md", "@all"), ("b.js", "@js"), ("gen/b.js", "(unowned)")]


def test_selection(spark):
    rules = spark.createDataFrame([("a", "warn", False, ["x"], [], [], ["t"]), ("b", "error", True, [], [], [], []), ("c", "warn", False, [], ["p", "q"], ["x"], [])], "id string, severity string, opt_in boolean, requires array<string>, requires_any array<string>, disabled_when array<string>, tags array<string>")
    caps = F.array(F.lit("x"), F.lit("q"))
    assert rows(selection.select_rules(rules, caps).select("id", "severity")) == [("a", "warn")]
    on = spark.createDataFrame([("b", "on"), ("a", "off")], "id string, setting string")
    assert rows(selection.select_rules(rules, caps, on).select("id", "severity")) == [("b", "error")]


@pytest.mark.parametrize(("n", "lines", "want"), [([("Security", "error")] * 3 + [("Performance", "warn")] * 4, 2000, (89, "healthy", 22.0, 11.0)), ([("Performance", "warn")] * 10, 250, (60, "needs work", 10.0, 40.0)), ([("Security", "error")], 0, (0, "critical", 6.0, 6000.0))])
def test_health_golden(spark, n, lines, want):
    f = spark.createDataFrame([("k", *x) for x in n], "k string, category string, severity string")
    r = scoring.health(f, spark.createDataFrame([("k", lines)], "k string, total_lines int"), "k").first()
    assert (r.score, r.label, r.weighted, r.per_kloc) == want


def two_pass(base, cur):
    """The definition of the delta, in order."""
    pool = {}
    for k, f, p in base:
        pool.setdefault(k, []).append((f, p))
    left = []
    for k, f, p in cur:
        hit = next((x for x in pool.get(k, []) if x[0] == f), None)
        if hit:
            pool[k].remove(hit)
        else:
            left.append((k, f, p))
    new = []
    for k, f, p in left:
        if pool.get(k):
            pool[k].pop(0)
        else:
            new.append(p)
    return sorted(new), sorted(p for v in pool.values() for _, p in v)


def test_delta(spark):
    rnd = random.Random(1)
    for _ in range(3):
        b, c = ([(rnd.choice("xyz"), rnd.choice("fg"), i) for i in range(rnd.randint(0, 25))] for _ in range(2))
        i, r = delta.delta(*(spark.createDataFrame(x, "key string, file string, pos int") for x in (b, c)))
        got = sorted(x.pos for x in i.collect()), sorted(x.pos for x in r.collect())
        want = two_pass(b, c)
        assert got[0] == want[0] and len(got[1]) == len(want[1])


def test_ratchet_and_history(spark):
    f = lambda x: spark.createDataFrame(x, "key string, pos int")
    out = delta.ratchet(f([("a", 1), ("a", 2), ("b", 3)]), f([("a", 0)]), f([("b", 0)]))
    assert rows(out.select("pos", "regression")) == [(2, False), (3, True)]
    h = lambda x: spark.createDataFrame(x, "key string, resolved_at string")
    assert rows(delta.resolved_history(h([("n", "1")]), h([("o", "9"), ("p", "8")]), 2).select("key")) == [("n",), ("o",)]


def test_suppression(spark):
    f = spark.createDataFrame([("p", i, "r") for i in range(1, 9)], "norm_path string, line int, diagnostic string")
    d = spark.createDataFrame([("p", 1, "next", "r"), ("p", 4, "disable", "r"), ("p", 6, "enable", "r"), ("p", 8, "same", "*"), ("q", 1, "disable", "r")], "norm_path string, line int, kind string, diagnostic string")
    assert [r.line for r in findings.suppress(f, d).filter("suppressed").orderBy("line").collect()] == [2, 4, 5, 8]
    assert [r.line for r in findings.near_miss(f, d).filter("directive_line is not null").orderBy("line").collect()] == [3, 4, 5, 6]


def closure_of(e):
    out = set(e)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} | out
        if more == out:
            return out
        out = more


@pytest.mark.parametrize(("seed", "n"), [(2, 16), (3, 12), (4, 20), (5, 30), (6, 0)])
def test_graph(spark, seed, n):
    rnd = random.Random(seed)
    e = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(n)}
    df = spark.createDataFrame(sorted(e), "src int, dst int")
    clean = {(a, b) for a, b in e if a != b}
    full = closure_of(clean)
    assert set(rows(graph.cycle_members(df))) == {(a, b) for a, b in clean if (b, a) in full}
    comp = {a: min([b for x, b in full if x == a and (b, a) in full] + [a]) for a in range(12) if any((a, b) in full and (b, a) in full for b in range(12) if b != a)}
    assert {(r.node, r.component) for r in graph.strong_components(df).collect()} == set(comp.items())
    depth = {0: 0}
    level = {0}
    while level:
        level = {b for a, b in e if a in level} - set(depth)
        depth |= {n: max(depth.values()) + 1 for n in level}
    assert set(rows(graph.reach(df, spark.createDataFrame([(0,)], "node int")))) == set(depth.items())


def test_taint_trail(spark):
    flows = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (4, 5)], "src int, dst int")
    out = {r.node: (r.depth, r.trail) for r in graph.taint(spark.createDataFrame([(1,)], "node int"), flows).collect()}
    assert out == {1: (0, [1]), 2: (1, [1, 2]), 3: (1, [1, 3])}


def test_scopes(spark):
    scopes = spark.createDataFrame([(0, None), (1, 0), (2, 1)], "scope int, parent int")
    bindings = spark.createDataFrame([(0, "x", 10), (1, "x", 11), (0, "y", 12)], "scope int, name string, binding int")
    refs = spark.createDataFrame([(1, 2, "x"), (2, 0, "x"), (3, 2, "y"), (4, 2, "z")], "ref int, scope int, name string")
    assert {r.ref: r.binding for r in graph.resolve(refs, bindings, scopes).collect()} == {1: 11, 2: 10, 3: 12, 4: None}


def test_suggest(spark):
    rnd = random.Random(4)
    names = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = sorted((a, b, distance(a, b)) for a in names for b in names if a != b and distance(a, b) <= 2)
    assert rows(suggest.suggestions(df.withColumnRenamed("name", "word"), df)) == want


def test_history(spark):
    log = spark.createDataFrame(list(enumerate(["commit\tann", "a.js", "b.js", "", "commit\tbob", "a.js"])), "pos int, line string")
    cf = history.commit_index(log)
    assert rows(cf) == [(0, "ann", "a.js"), (0, "ann", "b.js"), (1, "bob", "a.js")]
    out = {r.path: (r.commits, r.authors, r.score) for r in history.churn(cf, F.max("commit_index") + 1).collect()}
    assert out == {"a.js": (2, 2, 100), "b.js": (1, 1, 65)}
    pairs = history.positional_pairs(spark.createDataFrame([(1, "del", 1, "a"), (1, "add", 2, "b"), (2, "del", 1, "c"), (2, "add", 2, "d"), (2, "add", 3, "e")], "hunk int, kind string, pos int, text string"))
    assert rows(pairs) == [(1, 1, "a", "b")]


def test_rulekit(spark):
    n = spark.createDataFrame([("f", 1, 0, 9), ("f", 2, 1, 5), ("f", 3, 2, 3), ("g", 4, 2, 3)], "file string, node int, pre int, post int")
    assert rows(rulekit.nearest_containing(n, n.filter("node < 3")).select("node", "outer_node")) == [(2, 1), (3, 2)]
    s = spark.createDataFrame([("p", 1, False), ("p", 2, True), ("p", 3, False), ("p", 4, False), ("q", 1, True)], "parent string, ordinal int, ends boolean")
    assert rows(rulekit.unreachable(s, "parent", "ordinal", F.col("ends")).select("parent", "ordinal")) == [("p", 3)]
    t = rulekit.topology(*(spark.createDataFrame(x, "topic string, file string") for x in ([("a", "1"), ("b", "1")], [("a", "1"), ("c", "2")])))
    assert {r.topic: (r.state, r.loops) for r in t.collect()} == {"a": ("connected", 1), "b": ("orphan", 0), "c": ("dead-consumer", 0)}


FILES = [
    ("infra/s3.tf", 'acl = "public-read"\nblock_public_acls = false\nacl = "private"', {("no-public-cloud-storage", 1), ("no-public-cloud-storage", 2)}),
    ("keys/id_rsa", "x\n-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN RSA PRIVATE KEY-----", {("no-committed-private-key", 2)}),
    ("src/id.js", "-----BEGIN RSA PRIVATE KEY-----", set()),
    (".github/workflows/a.yml", "  - uses: actions/checkout@v4\n  - uses: a/b@" + "0" * 40 + "\n run: echo ${{ github.event.issue.title }}", {("ci-unpinned-action", 1), ("ci-script-injection", 3)}),
    ("k/pod.yaml", "kind: Pod\nspec:\n  hostNetwork: true\n  privileged: true", {("k8s-host-namespace", 3), ("k8s-privileged-container", 4)}),
    ("k/ds.yaml", "kind: DaemonSet\nspec:\n  hostNetwork: true", set()),
    ("db/migrations/1.sql", "-- postgres\nCREATE INDEX i ON t(a);\nCREATE INDEX CONCURRENTLY j ON t(a);\nALTER TABLE t ADD COLUMN c int NOT NULL;\nDROP TABLE users;", {("migration-index-without-concurrently", 2), ("migration-add-not-null-without-default", 4), ("migration-destructive-without-guard", 5)}),
    ("app/Dockerfile", "FROM node\nCOPY .env /app/\nCOPY .env.example /app/", {("dockerfile-copies-dotenv-into-image", 2)}),
    ("package.json", '{"dependencies": {\n"left": "latest",\n"ok": "1.2.3"}}', {("no-unpinned-dependency", 2)}),
]


def test_line_rules(spark):
    df = spark.createDataFrame([(p, t) for p, t, _ in FILES], "path string, text string")
    out = textscan.line_findings(df, textscan.LINE_RULES).collect()
    for p, _, want in FILES:
        assert {(r.diagnostic, r.line) for r in out if r.path == p} == want, p
    key = next(r for r in out if r.diagnostic == "no-public-cloud-storage" and r.line == 1)
    assert key.col == 1 and key.evidence == 'acl = "public-read"'


def test_structural_text_rules(spark):
    iam = 'Effect: "Allow"\nAction: "*"\nResource: "*"\nEffect: "Allow"\nAction: "s3:Get"\nResource: "*"'
    df = spark.createDataFrame([("p.yml", iam), ("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"a": "1", "b": "2"}}')], "path string, text string")
    assert rows(textscan.block_iam(df)) == [("p.yml", 1)]
    assert rows(textscan.conflicting_dependencies(df)) == [("package.json", "a")]
    docker = "FROM node:20 AS build\nRUN a \\\n  b\nFROM build\nFROM nginx\nFROM x@sha256:1\nFROM scratch\nFROM redis:latest"
    ins = files.dockerfile(spark.createDataFrame([("D", docker)], "path string, text string"))
    assert ("D", 1, 2, 0, "RUN", "a    b") in rows(ins)
    assert rows(files.mutable_base_images(ins)) == [("D", 5, "nginx"), ("D", 8, "redis:latest")]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "m").mkdir(parents=True)
    (tmp_path / "src" / "a.js").write_text("x\ny\n")
    (tmp_path / "top.ts").write_text("x")
    (tmp_path / "src" / ".hidden.js").write_text("x")
    (tmp_path / "src" / "b.min.js").write_text("x")
    (tmp_path / "node_modules" / "m" / "i.js").write_text("x")
    assert rows(files.read_tree(spark, str(tmp_path)).select("norm_path", "n_lines")) == [("src/a.js", 3), ("top.ts", 1)]
    diff = "+++ b/a.js\n@@ -1,3 +1,3 @@\n x\n-old\n+new\n y"
    assert rows(files.unified_diff(spark.createDataFrame([(diff,)], "text string")).select("path", "kind", "line", "text")) == [("a.js", "add", 2, "new"), ("a.js", "del", 2, "old")]
    npm = '{"packages": {"": {}, "node_modules/a": {"version": "1.0.0"}, "node_modules/b/node_modules/@s/c": {"version": "2.0.0", "dev": true}}}'
    assert rows(files.npm_lock(spark.createDataFrame([("l", npm)], "path string, text string"))) == [("l", "@s/c", "2.0.0", True), ("l", "a", "1.0.0", False)]
    yarn = '"@s/c@^2.0.0":\n  version "2.1.0"\n\nleft-pad@1:\n  version "1.3.0"\n'
    assert rows(files.yarn_lock(spark.createDataFrame([("l", yarn)], "path string, text string"))) == [("l", "@s/c", "2.1.0"), ("l", "left-pad", "1.3.0")]
    pnpm = "packages:\n\n  /left-pad@1.3.0:\n    resolution: {}\n  '@s/c@2.0.0':\n    dev: true\n"
    assert rows(files.pnpm_lock(spark.createDataFrame([("l", pnpm)], "path string, text string"))) == [("l", "@s/c", "2.0.0"), ("l", "left-pad", "1.3.0")]
    m = spark.createDataFrame([("p", '{"type": "module", "dependencies": {"express": "^5.0.1", "zod": "3"}}')], "path string, text string")
    assert files.capabilities(m, spark.createDataFrame([("express", "express")], "package string, token string")).first().capabilities == ["esm", "express", "express:5", "node"]


def test_sinks(spark):
    f = spark.createDataFrame([(0, "a,b.js", 3, 1, "r", "T", "error", "m%|\n", "i1"), (1, "c.js", 4, 2, "r", "U", "warn", "n", "i2")], "pos int, norm_path string, line int, col int, diagnostic string, title string, severity string, message string, id string")
    assert sinks.annotations(f).first().value == "::error file=a%2Cb.js,line=3,col=1::m%25|%0A"
    assert [r.value for r in sinks.sarif_rules(f).collect()] == ['{"id":"r","shortDescription":{"text":"T"}}']
    assert '"ruleId":"r"' in sinks.sarif_results(f).first().value
    assert sinks.markdown_rows(f, ["pos"], 1).collect()[0].value.startswith("| error | r | a,b.js:3 | m%\\|")
    d = spark.createDataFrame([("a", "^1", False), ("a", "^2", True), ("b", "3", True)], "name string, range string, dev boolean")
    assert rows(sinks.locked_components(d, spark.createDataFrame([("a", "1.5.0")], "name string, version string"))) == [("a", "1.5.0", False), ("b", "3", True)]


def test_incremental(spark, tmp_path):
    f = spark.createDataFrame([("a", "1"), ("b", "2")], "norm_path string, text string")
    cache = f.filter("norm_path = 'a'").select("norm_path", F.substring(F.sha2("text", 256), 1, 16).alias("hash"), F.lit("p").alias("probe"))
    assert [r.norm_path for r in incremental.stale(f, cache, "p").collect()] == ["b"]
    assert incremental.stale(f, cache, "other").count() == 2
    old = spark.createDataFrame([("a", "old"), ("b", "old"), ("gone", "old")], "norm_path string, finding string")
    out = incremental.rescan(f, cache, old, "p", lambda x: x.select("norm_path", F.lit("new").alias("finding")))
    assert rows(out) == [("a", "old"), ("b", "new")]
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "norm_path string, version int, text string").write.parquet(str(src))
    stream = spark.readStream.schema("norm_path string, version int, text string").parquet(str(src))
    q = incremental.watch(stream, lambda x: x.select("norm_path", "text"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("norm_path", "text")) == [("a", "y")]


def test_fix_outcome(spark):
    f = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    assert tuple(delta.fix_outcome(f("aab"), f("abbc")).first()) == (1, 2, 2)
    assert Counter(r.change for r in delta.drift(*(spark.createDataFrame(x, "id string, v string") for x in ([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")])), "id", "v").collect()) == Counter(["removed", "changed", "added"])
