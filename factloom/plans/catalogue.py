"""All queries over the driver tables, with the SQL that they are checked against.

The tables stand for the facts that the operators work on, as analogies: events are findings (type = rule, user = file,
k in props = line), documents and pages are text files, lineitem holds facts with places, commits and edges, orders are
dated rows, nations and regions are projects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import delta, findings, graph, history, rulekit, scoring, selection, suggest, textscan
from factloom.sources import javascript
from factloom.streaming import incremental

REGISTRY: dict[str, tuple[Callable, str]] = {}
MIDDLE = "2024-01-16 00:00:00"


def query(name: str, sql: str):
    def add(f):
        REGISTRY[name] = (f, sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def as_findings(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("pos"), c.alias("diagnostic"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("norm_path"),
        F.get_json_object("props", "$.k").cast("int").alias("line"), (F.col("event_id") % 7 + 1).cast("int").alias("col"),
        F.when(c.isin("error", "purchase"), "error").otherwise("warn").alias("severity"),
        F.when(c == "error", "Bugs").when(c == "purchase", "Security").when(c == "click", "Performance").when(c == "view", "Maintainability").otherwise("Reliability").alias("category"),
        F.concat(c, F.lit(" at "), F.get_json_object("props", "$.k")).alias("message"), "ts", "value",
    ).withColumn("key", F.concat_ws(":", "diagnostic", F.col("line").cast("string")))


FSQL = """f AS (SELECT event_id AS pos, event_type AS diagnostic, 'u' || user_id AS norm_path, CAST(json_extract(props, '$.k') AS INT) AS line,
 (event_id % 7 + 1)::INT AS col, CASE WHEN event_type IN ('error', 'purchase') THEN 'error' ELSE 'warn' END AS severity,
 CASE event_type WHEN 'error' THEN 'Bugs' WHEN 'purchase' THEN 'Security' WHEN 'click' THEN 'Performance' WHEN 'view' THEN 'Maintainability' ELSE 'Reliability' END AS category,
 event_type || ' at ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS message, ts, value, event_type || ':' || CAST(json_extract(props, '$.k') AS VARCHAR) AS key FROM events)"""
BC = f"b AS (SELECT * FROM f WHERE ts < TIMESTAMP '{MIDDLE}'), c AS (SELECT * FROM f WHERE ts >= TIMESTAMP '{MIDDLE}')"
WEIGHT = "(CASE severity WHEN 'error' THEN 3.0 ELSE 1.0 END) * (CASE category WHEN 'Security' THEN 2.0 WHEN 'Reliability' THEN 1.5 WHEN 'Bugs' THEN 1.5 WHEN 'Performance' THEN 1.0 ELSE 0.5 END)"


def halves(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = F.lit(MIDDLE).cast("timestamp_ntz").cast(f.schema["ts"].dataType)
    return f.filter(F.col("ts") < m), f.filter(F.col("ts") >= m)


#: An example catalogue (id, severity, opt_in, requires, requires_any, disabled_when).
RULES = [
    ("express-limit", "warn", False, ["express"], [], []),
    ("async-handler", "error", False, ["express"], [], ["express:5"]),
    ("any-server", "error", False, [], ["express", "fastify"], []),
    ("plain", "warn", False, [], [], []),
    ("typed-only", "error", True, ["ts"], [], []),
    ("no-edge", "error", False, ["node"], [], ["edge"]),
]


def _list(x):
    return "[" + ", ".join(f"'{y}'" for y in x) + "]::VARCHAR[]"


@query("q01_rule_selection", f"""WITH r(id, severity, opt_in, req, anyof, dis) AS (VALUES {", ".join(f"('{i}', '{s}', {o}, {_list(a)}, {_list(b)}, {_list(c)})" for i, s, o, a, b, c in RULES)}),
n AS (SELECT n_nationkey, list_filter(['node', CASE WHEN n_nationkey % 2 = 0 THEN 'express' END, CASE WHEN n_nationkey % 4 = 0 THEN 'express:5' END, CASE WHEN n_nationkey % 3 = 0 THEN 'fastify' END, CASE WHEN n_nationkey % 5 = 0 THEN 'edge' END, CASE WHEN n_regionkey > 2 THEN 'ts' END], lambda x: x IS NOT NULL) AS caps FROM nation)
SELECT n_nationkey, id, severity FROM n, r WHERE NOT opt_in AND list_has_all(caps, req) AND (len(anyof) = 0 OR list_has_any(caps, anyof)) AND NOT list_has_any(caps, dis)""")
def q01(spark, d):
    rules = spark.createDataFrame(RULES, "id string, severity string, opt_in boolean, requires array<string>, requires_any array<string>, disabled_when array<string>")
    k = F.col("n_nationkey")
    caps = F.filter(F.array(F.lit("node"), F.when(k % 2 == 0, "express"), F.when(k % 4 == 0, "express:5"), F.when(k % 3 == 0, "fastify"), F.when(k % 5 == 0, "edge"), F.when(F.col("n_regionkey") > 2, "ts")), lambda x: x.isNotNull())
    n = table(spark, d, "nation").select("n_nationkey", caps.alias("caps"))
    each = n.withColumn("_one", F.lit(1)).join(F.broadcast(rules.withColumn("_one", F.lit(1))), "_one")  # rules are a catalogue of fixed size
    gate = selection.capability_gate(F.col("caps"), F.col("requires"), F.col("requires_any"), F.col("disabled_when"))
    return each.filter(~F.col("opt_in") & gate).select("n_nationkey", "id", "severity")


#: Line rules (id, category, severity, pattern in the common subset of regular expressions).
SCAN = [
    ("email-like", "Security", "error", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+"),
    ("licence-line", "Reliability", "warn", r"All rights reserved|Licensed under|Copyright"),
    ("symbol-noise", "Bugs", "warn", r"[#$%&*]{3}"),
    ("long-number", "Security", "warn", r"[0-9]{8,}"),
    ("shouting", "Maintainability", "warn", r"\b[A-Z]{4,} [A-Z]{2,}\b"),
]


def scan_lines(spark, d) -> DataFrame:
    rules = tuple(textscan.TextRule(i, i, c, s, p, i, max_bytes=1 << 62) for i, c, s, p in SCAN)
    docs = table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    return textscan.line_findings(docs, rules, keep=("doc_id", "source")).select("doc_id", "source", "line", "diagnostic", "category", "severity")


SCANSQL = "l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM documents), s AS (" + " UNION ALL ".join(f"SELECT doc_id, source, line::INT AS line, '{i}' AS diagnostic, '{c}' AS category, '{s}' AS severity FROM l WHERE regexp_matches(t, '{p}')" for i, c, s, p in SCAN) + ")"
SCORE = "CAST(greatest(0, floor(100 - least(100.0, w / greatest(n, 1) * 1000 / 100.0 * 100) + 0.5)) AS BIGINT)"


@query("q02_health_score", f"""WITH {SCANSQL}, t AS (SELECT source, sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END)::DOUBLE AS n FROM documents GROUP BY source),
g AS (SELECT t.source, n, coalesce(sum({WEIGHT}) FILTER (WHERE s.diagnostic IS NOT NULL), 0)::DOUBLE AS w, {", ".join(f"count(*) FILTER (WHERE category = '{c}') AS n_{c.lower()}" for c in ("Security", "Reliability", "Bugs", "Performance", "Maintainability"))} FROM t LEFT JOIN s ON s.source = t.source GROUP BY t.source, n)
SELECT source, {SCORE} AS score, CASE WHEN {SCORE} >= 75 THEN 'healthy' WHEN {SCORE} >= 50 THEN 'needs work' ELSE 'critical' END AS label, floor(w * 100 + 0.5) / 100 AS weighted, floor(w / greatest(n, 1) * 1000 * 100 + 0.5) / 100 AS per_kloc, n_security, n_reliability, n_bugs, n_performance, n_maintainability FROM g""")
def q02(spark, d):
    lines = table(spark, d, "documents").groupBy("source").agg(F.sum(S.line_count(F.col("text"))).alias("total_lines"))
    return scoring.health(scan_lines(spark, d), lines, "source")


@query("q03_finding_keys", f"""WITH {FSQL} SELECT pos, norm_path || '::' || line || ':' || col || '::factloom/' || diagnostic || '::' || substr(sha256(norm_path || '|' || line || '|' || col || '|' || diagnostic || '|' || message), 1, 8) AS id,
 substr(sha256(length(diagnostic) || ':' || diagnostic || '|' || length(message) || ':' || message || '|' || length(norm_path) || ':' || norm_path), 1, 16) AS evidence_key,
 CASE WHEN severity = 'error' THEN 'high' ELSE 'medium' END AS confidence FROM f""")
def q03(spark, d):
    f = findings.finalize(as_findings(spark, d).withColumn("evidence", F.col("norm_path")))
    conf = selection.confidence(F.lit(None).cast("string"), F.lit(False), F.col("severity"))
    return findings.canonical(f).select("pos", "id", "evidence_key", conf.alias("confidence"))


ANTI = "SELECT * EXCLUDE (r, n) FROM (SELECT x.*, row_number() OVER (PARTITION BY {p} ORDER BY x.pos) AS r, coalesce(y.n, 0) AS n FROM {left} x LEFT JOIN (SELECT {g}, count(*) AS n FROM {right} GROUP BY {g}) y USING ({g})) WHERE r > n"


def _anti(left, right, by):
    return ANTI.format(left=left, right=right, g=", ".join(by), p=", ".join(f"x.{c}" for c in by))


@query("q04_delta", f"""WITH {FSQL}, {BC}, b1 AS ({_anti("b", "c", ["key", "norm_path"])}), c1 AS ({_anti("c", "b", ["key", "norm_path"])}), i AS ({_anti("c1", "b1", ["key"])}), r AS ({_anti("b1", "c1", ["key"])})
SELECT pos, key, 'introduced' AS status FROM i UNION ALL SELECT pos, key, 'resolved' FROM r""")
def q04(spark, d):
    b, c = halves(as_findings(spark, d))
    i, r = delta.delta(b, c, file="norm_path")
    return i.select("pos", "key", F.lit("introduced").alias("status")).union(r.select("pos", "key", F.lit("resolved")))


@query("q05_ratchet", f"""WITH {FSQL}, {BC}, h AS (SELECT DISTINCT key FROM b WHERE value > 200), i AS ({_anti("c", "b", ["key"])}) SELECT pos, i.key, h.key IS NOT NULL AS regression FROM i LEFT JOIN h ON h.key = i.key""")
def q05(spark, d):
    b, c = halves(as_findings(spark, d))
    return delta.ratchet(c, b, b.filter("value > 200")).select("pos", "key", "regression")


@query("q06_drift", """WITH o AS (SELECT p_brand AS id, CAST(count(*) % 3 AS VARCHAR) AS v FROM part WHERE p_size < 25 GROUP BY p_brand), n AS (SELECT p_brand AS id, CAST(count(*) % 3 AS VARCHAR) AS v FROM part WHERE p_size >= 25 AND p_brand <> 'Brand#3' GROUP BY p_brand)
SELECT coalesce(o.id, n.id) AS id, o.v AS old_value, n.v AS new_value, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.v IS DISTINCT FROM n.v""")
def q06(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("id"), "p_size")
    o, n = (x.groupBy("id").agg((F.count("*") % 3).cast("string").alias("v")) for x in (p.filter("p_size < 25"), p.filter("p_size >= 25 and id <> 'Brand#3'")))
    return delta.drift(o, n, "id", "v")


def commit_files(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_index"), F.col("l_suppkey").alias("author"), F.col("l_partkey").alias("path"))


CHURN = """g AS (SELECT l_partkey AS path, count(*) AS commits, count(DISTINCT l_suppkey) AS authors, min(l_orderkey) AS last_index FROM lineitem GROUP BY l_partkey),
m AS (SELECT max(commits) AS mc, max(authors) AS ma FROM g), k AS (SELECT max(l_orderkey) + 1 AS n FROM lineitem),
churn AS (SELECT path, commits, authors, last_index, CAST(floor(100 * (0.5::DOUBLE * commits / mc + 0.2::DOUBLE * authors / ma + 0.3::DOUBLE * (1 - last_index / (n - 1)::DOUBLE)) + 0.5) AS BIGINT) AS score FROM g, m, k)"""


@query("q07_churn", f"WITH {CHURN} SELECT * FROM churn")
def q07(spark, d):
    return history.churn(commit_files(spark, d), F.max("commit_index") + 1)


@query("q08_magnets", f"WITH {CHURN} SELECT path, score, commits FROM churn WHERE score >= 70 AND commits >= 3 ORDER BY score DESC, commits DESC, path LIMIT 10")
def q08(spark, d):
    return history.magnets(q07(spark, d), 10).select("path", "score", "commits")


#: Example ownership rules (ordinal, pattern, owners); the last match wins, an empty list clears.
OWNERS = [(0, "u*", ["@all"]), (1, "u1*", ["@one", "@ten"]), (2, "u13?", []), (3, "u2", ["@two"])]
OWNER_RE = {"u*": "^u[0-9]*$", "u1*": "^u1[0-9]*$", "u13?": "^u13[0-9]$", "u2": "^u2$"}


@query("q09_owners", f"""WITH {FSQL}, r(ordinal, pattern, owners) AS (VALUES {", ".join(f"({o}, '{OWNER_RE[p]}', {_list(w)})" for o, p, w in OWNERS)}),
o AS (SELECT norm_path, arg_max(owners, ordinal) AS owners FROM (SELECT DISTINCT norm_path FROM f) p JOIN r ON regexp_matches(norm_path, pattern) GROUP BY norm_path),
e AS (SELECT norm_path, unnest(CASE WHEN len(owners) = 0 THEN ['(unowned)'] ELSE owners END) AS owner FROM o)
SELECT owner, count(*) AS findings FROM f JOIN e USING (norm_path) GROUP BY owner""")
def q09(spark, d):
    from factloom.functions.globs import owner_pattern_to_regex

    f = as_findings(spark, d)
    rules = spark.createDataFrame([(o, owner_pattern_to_regex(p), w) for o, p, w in OWNERS], "ordinal int, pattern string, owners array<string>")
    return f.join(history.owners(f, rules, "norm_path"), "norm_path").groupBy("owner").agg(F.count("*").alias("findings"))


@query("q10_blame_age", """WITH a AS (SELECT o_orderpriority, greatest(0, floor((epoch_ms(TIMESTAMP '1999-01-01 00:00:00') - epoch_ms(o_orderdate)) / 86400000.0))::BIGINT AS age FROM orders)
SELECT o_orderpriority, quantile_disc(age, 0.5) AS median_age, max(age) AS oldest, count(*) FILTER (WHERE age <= 365) AS recent, count(*) FILTER (WHERE age IS NULL) AS undated FROM a GROUP BY o_orderpriority""")
def q10(spark, d):
    o = table(spark, d, "orders").withColumn("age", S.age_days(F.lit("1999-01-01 00:00:00").cast("timestamp"), F.col("o_orderdate").cast("timestamp")))
    return history.age_summary(o, "o_orderpriority", 365)


def edges(spark, d) -> DataFrame:
    """A part is followed by the next part of the same order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, d, "lineitem").withColumn("dst", F.lead("l_partkey").over(w)).filter("dst is not null")
    return e.select(F.col("l_partkey").alias("src"), "dst")


ESQL = "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"


def reach_sql(seeds: str, node: str, other: str) -> str:
    """Shortest depths: each round keeps one row per node that was not there before."""
    return f"""r(node, depth) USING KEY (node) AS ({seeds} UNION SELECT e.{node}, min(r.depth) + 1 FROM r JOIN e ON e.{other} = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS k WHERE k.node = e.{node}) GROUP BY e.{node})"""


@query("q11_blast_radius", f"""WITH RECURSIVE {ESQL}, {reach_sql("SELECT p_partkey, 0 FROM part WHERE p_size = 1", "src", "dst")} SELECT node, depth FROM r WHERE depth > 0""")
def q11(spark, d):
    return graph.blast_radius(graph.clean_edges(edges(spark, d)), table(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("node")))


@query("q12_degrees", f"""WITH {ESQL}, i AS (SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY dst), o AS (SELECT src AS node, count(*) AS fan_out FROM e GROUP BY src)
SELECT coalesce(i.node, o.node) AS node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM i FULL JOIN o ON i.node = o.node""")
def q12(spark, d):
    return graph.degrees(edges(spark, d))


@query("q13_hubs", f"WITH {ESQL} SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY dst HAVING count(*) >= 10 ORDER BY fan_in DESC, node LIMIT 10")
def q13(spark, d):
    return graph.hubs(graph.degrees(edges(spark, d))).select("node", "fan_in")


@query("q14_layer_violations", f"""WITH {ESQL} SELECT src, dst, CASE WHEN b.p_size % 4 < a.p_size % 4 THEN 'upward-import' ELSE 'layer-skip' END AS kind FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE b.p_size % 4 < a.p_size % 4 OR (a.p_size % 4 = 0 AND b.p_size % 4 >= 2)""")
def q14(spark, d):
    return graph.layer_violations(edges(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 4).alias("rank")))


@query("q15_components", f"""WITH RECURSIVE {ESQL}, p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON e.src = p.dst),
c AS (SELECT a.src AS node, least(min(a.dst), a.src) AS component FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def q15(spark, d):
    return graph.strong_components(edges(spark, d))


@query("q16_taint_depth", f"""WITH RECURSIVE {ESQL}, r(node, depth, trail) USING KEY (node) AS (SELECT p_partkey, 0, [p_partkey] FROM part WHERE p_brand = 'Brand#1' UNION SELECT e.dst, min(r.depth) + 1, list_append(min(r.trail), e.dst) FROM r JOIN e ON e.src = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS k WHERE k.node = e.dst) GROUP BY e.dst)
SELECT node, depth, array_to_string(trail, '>') AS trail FROM r""")
def q16(spark, d):
    seeds = table(spark, d, "part").filter("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("node"))
    return graph.taint(seeds, graph.clean_edges(edges(spark, d))).select("node", "depth", F.array_join(F.col("trail").cast("array<string>"), ">").alias("trail"))


@query("q17_text_scan", f"WITH {SCANSQL} SELECT doc_id, line, diagnostic, severity FROM s")
def q17(spark, d):
    return scan_lines(spark, d).select("doc_id", "line", "diagnostic", "severity")


@query("q18_html_scan", r"""SELECT page_id, len(regexp_extract_all(html, '<script\b'))::INT AS scripts, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INT AS links, len(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: starts_with(x, 'http')))::INT AS external FROM pages""")
def q18(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"<script\b"), F.lit(0))).alias("scripts"), F.size(links).alias("links"), F.size(F.filter(links, lambda x: x.startswith("http"))).alias("external"))


@query("q19_vendored", r"""SELECT doc_id, (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END)::INT AS n_lines, (regexp_matches(substr(text, 1, 4096), '(?i)/\*!|@license|@preserve|typeof define === [''"]function[''"] && define\.amd') OR (length(text) >= 50000 AND len(list_filter(string_split(substr(text, 1, 8192), chr(10)), lambda x: length(x) >= 2000)) > 0)) AS vendored FROM documents""")
def q19(spark, d):
    return table(spark, d, "documents").select("doc_id", S.line_count(F.col("text")).alias("n_lines"), selection.vendored(F.col("text")).alias("vendored"))


@query("q20_suppression", """WITH e AS (SELECT event_id, 'u' || user_id AS p, event_type, event_id AS line FROM events),
b AS (SELECT p, line, CASE event_type WHEN 'click' THEN 'disable' WHEN 'signup' THEN 'enable' END AS kind, event_id, event_type FROM e),
s AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY p ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM b)
SELECT s.event_id, (coalesce(state = 'disable', false) OR EXISTS (SELECT 1 FROM e n WHERE n.event_type = 'purchase' AND n.p = s.p AND n.line + 1 = s.line)) AS suppressed FROM s WHERE event_type = 'error'""")
def q20(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("norm_path"), "event_type", F.col("event_id").alias("line"))
    f = e.filter("event_type = 'error'").select("event_id", "norm_path", "line", F.lit("r").alias("diagnostic"))
    kind = F.when(F.col("event_type") == "click", "disable").when(F.col("event_type") == "signup", "enable").when(F.col("event_type") == "purchase", "next")
    return findings.suppress(f, e.withColumn("kind", kind).filter("kind is not null").select("norm_path", "line", "kind", F.lit("r").alias("diagnostic"))).select("event_id", "suppressed")


@query("q21_changed_ranges", f"""WITH {FSQL}, r AS (SELECT 'u' || c_custkey AS p, c_nationkey * 3 AS a, c_nationkey * 3 + 9 AS b FROM customer) SELECT pos FROM f WHERE EXISTS (SELECT 1 FROM r WHERE p = norm_path AND line BETWEEN a AND b)""")
def q21(spark, d):
    r = table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("norm_path"), (F.col("c_nationkey") * 3).alias("from_line"), (F.col("c_nationkey") * 3 + 9).alias("to_line"))
    return findings.in_ranges(as_findings(spark, d), r).select("pos")


@query("q22_dead_entities", """SELECT 'part' AS kind, p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'order', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def q22(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    out = None
    for kind, t, key, other, on in (("part", table(spark, d, "part"), "p_partkey", li, "l_partkey"), ("customer", table(spark, d, "customer"), "c_custkey", o, "o_custkey"), ("order", o, "o_orderkey", li, "l_orderkey")):
        x = rulekit.without(t.select(F.col(key).alias("id")), other.select(F.col(on).alias("id")), ["id"]).select(F.lit(kind).alias("kind"), "id")
        out = x if out is None else out.union(x)
    return out


@query("q23_did_you_mean", """WITH w AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS word, b.name AS name, levenshtein(a.name, b.name)::INT AS distance FROM w a, w b WHERE a.name <> b.name AND levenshtein(a.name, b.name) <= 2""")
def q23(spark, d):
    n = table(spark, d, "part").select(F.col("p_name").alias("name"))
    return suggest.suggestions(n.select(F.col("name").alias("word")), n)


ROUTE = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"


@query("q24_surface_diff", f"""WITH s AS (SELECT {ROUTE} AS route, starts_with(url, 'https') AS new, bool_or(contains(url, 'page=')) AS auth FROM pages GROUP BY 1, 2), o AS (SELECT * FROM s WHERE NOT new), n AS (SELECT * FROM s WHERE new),
j AS (SELECT coalesce(o.route, n.route) AS route, CASE WHEN n.route IS NULL THEN 'removed' WHEN NOT o.auth AND n.auth THEN 'auth-added' WHEN o.auth AND NOT n.auth THEN 'auth-removed' END AS change FROM o FULL JOIN n ON o.route = n.route)
SELECT route, change, change <> 'auth-removed' AS breaking FROM j WHERE change IS NOT NULL""")
def q24(spark, d):
    s = table(spark, d, "pages").groupBy(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("route"), F.col("url").startswith("https").alias("new")).agg(F.bool_or(F.col("url").contains("page=")).alias("auth"))
    return delta.surface_diff(s.filter("not new"), s.filter("new"), "route", "auth")


@query("q25_package_verdict", """WITH x AS (SELECT l_partkey AS name, l_discount >= 0.05 AS new, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS exports, count(*) >= 5 AS complete FROM lineitem GROUP BY 1, 2),
j AS (SELECT coalesce(o.name, n.name) AS name, o.exports AS o, n.exports AS n, o.complete AS oc, n.complete AS nc FROM (SELECT * FROM x WHERE NOT new) o FULL JOIN (SELECT * FROM x WHERE new) n ON o.name = n.name),
k AS (SELECT name, o IS NULL AS np, n IS NULL AS gone, CASE WHEN oc AND nc THEN len(list_filter(o, lambda v: NOT list_contains(n, v))) ELSE 0 END AS r, CASE WHEN oc AND n IS NOT NULL THEN len(list_filter(n, lambda v: NOT list_contains(o, v))) ELSE 0 END AS a FROM j)
SELECT name, CASE WHEN gone OR r > 0 THEN 'major' WHEN np OR a > 0 THEN 'minor' ELSE 'patch' END AS verdict, r::INT AS n_removed, a::INT AS n_added FROM k""")
def q25(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("name"), (F.col("l_discount") >= 0.05).alias("new"))
    g = g.agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("exports"), (F.count("*") >= 5).alias("complete"))
    return delta.package_verdict(g.filter("not new").drop("new"), g.filter("new").drop("new"))


@query("q26_check_coverage", """WITH u AS (SELECT l_suppkey AS supplier, l_partkey, count(*) FILTER (WHERE l_returnflag = 'A') AS p, count(*) FILTER (WHERE l_returnflag = 'R') AS f FROM lineitem GROUP BY 1, 2), s AS (SELECT *, CASE WHEN p + f = 0 THEN 100 ELSE floor(100.0::DOUBLE * p / (p + f) + 0.5) END AS s FROM u)
SELECT supplier, CAST(floor(avg(s) + 0.5) AS BIGINT) AS score, count(*) AS units, sum(p)::BIGINT AS passed, sum(f)::BIGINT AS failed FROM s GROUP BY supplier""")
def q26(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "R", "fail").otherwise("na")
    return scoring.check_coverage(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_partkey", status.alias("status")), "l_partkey", "supplier")


@query("q27_readiness", """WITH g AS (SELECT o_custkey AS customer, count(*) FILTER (WHERE o_orderstatus = 'F') AS ready, count(*) FILTER (WHERE o_orderstatus = 'O') AS gap, count(*) AS dimensions FROM orders GROUP BY 1)
SELECT customer, CASE WHEN ready + gap > 0 THEN CAST(floor(100.0::DOUBLE * ready / (ready + gap) + 0.5) AS BIGINT) END AS score, ready, gap, dimensions FROM g""")
def q27(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "gap").otherwise("unknown")
    return scoring.readiness(table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), status.alias("status")), "customer")


@query("q28_provenance", """SELECT n_regionkey, sha256(string_agg(n_name || ':' || n_nationkey, chr(10) ORDER BY n_name || ':' || n_nationkey)) AS ruleset_hash FROM nation GROUP BY n_regionkey""")
def q28(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("n_name", F.lit(":"), F.col("n_nationkey").cast("string")))), "\n"), 256).alias("ruleset_hash"))


@query("q29_worst_of", f"""WITH {FSQL}, g AS (SELECT norm_path, sum({WEIGHT})::DOUBLE AS w, count(DISTINCT line)::DOUBLE * 100 AS n, min(pos) AS ordinal FROM f GROUP BY norm_path), s AS (SELECT norm_path, {SCORE} AS score, ordinal FROM g) SELECT norm_path, score, ordinal FROM s ORDER BY score, ordinal LIMIT 1""")
def q29(spark, d):
    g = as_findings(spark, d).groupBy("norm_path").agg(F.sum(scoring.finding_weight()).alias("w"), (F.countDistinct("line") * 100).alias("n"), F.min("pos").alias("ordinal"))
    return scoring.worst(g.select("norm_path", scoring.score_columns(F.col("w"), F.col("n"))[0], "ordinal"), "ordinal")


ORD = "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey"


@query("q30_unreachable", f"""WITH a AS (SELECT l_orderkey, {ORD} AS o, max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM lineitem) SELECT l_orderkey, min(o) AS o FROM a WHERE after = 1 GROUP BY l_orderkey""")
def q30(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("o"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("ends"))
    return rulekit.unreachable(li, "l_orderkey", "o", F.col("ends")).select("l_orderkey", "o")


@query("q31_conflicting_keys", f"""WITH {FSQL}, a AS (SELECT DISTINCT norm_path, line FROM f WHERE diagnostic = 'click'), b AS (SELECT DISTINCT norm_path, line FROM f WHERE diagnostic = 'view') SELECT norm_path, a.line AS k FROM a JOIN b USING (norm_path, line)""")
def q31(spark, d):
    g = as_findings(spark, d).groupBy("norm_path").agg(F.collect_set(F.when(F.col("diagnostic") == "click", F.col("line"))).alias("a"), F.collect_set(F.when(F.col("diagnostic") == "view", F.col("line"))).alias("b"))
    return g.select("norm_path", F.explode(F.array_intersect("a", "b")).alias("k"))


@query("q32_topology", f"""WITH {FSQL}, p AS (SELECT DISTINCT line AS topic, norm_path AS file FROM f WHERE diagnostic = 'purchase'), c AS (SELECT DISTINCT line AS topic, norm_path AS file FROM f WHERE diagnostic = 'view'),
x AS (SELECT topic, count(*) AS publishers FROM p GROUP BY 1), y AS (SELECT topic, count(*) AS consumers FROM c GROUP BY 1), l AS (SELECT topic, count(*) AS loops FROM p JOIN c USING (topic, file) GROUP BY 1)
SELECT topic, coalesce(publishers, 0) AS publishers, coalesce(consumers, 0) AS consumers, coalesce(loops, 0) AS loops, CASE WHEN consumers IS NULL THEN 'orphan' WHEN publishers IS NULL THEN 'dead-consumer' ELSE 'connected' END AS state FROM x FULL JOIN y USING (topic) LEFT JOIN l USING (topic)""")
def q32(spark, d):
    f = as_findings(spark, d).select(F.col("line").alias("topic"), F.col("norm_path").alias("file"), "diagnostic")
    return rulekit.topology(f.filter("diagnostic = 'purchase'"), f.filter("diagnostic = 'view'"))


@query("q33_lineage", """SELECT o_orderpriority AS route, p_type AS entity, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS ops FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def q33(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rulekit.lineage(x.select(F.col("o_orderpriority").alias("route"), F.col("p_type").alias("entity"), F.col("l_returnflag").alias("op"))).withColumn("ops", F.array_join("ops", ","))


@query("q34_change_risk", f"""WITH {FSQL}, g AS (SELECT line AS change, sum((CASE category WHEN 'Security' THEN 2.0 WHEN 'Reliability' THEN 1.5 WHEN 'Bugs' THEN 1.5 WHEN 'Performance' THEN 1.0 ELSE 0.5 END) * (CASE severity WHEN 'error' THEN 2 ELSE 1 END))::DOUBLE AS b, count(DISTINCT norm_path) AS files_touched, count(*) AS introduced, bool_or(category = 'Security') AS sec FROM f GROUP BY 1),
r AS (SELECT *, floor((b + least(10.0, files_touched * 0.5)) * 10 + 0.5) / 10 AS risk FROM g) SELECT change, risk, CASE WHEN sec OR risk >= 20 THEN 'severe' WHEN risk >= 10 THEN 'high' WHEN risk >= 3 THEN 'moderate' ELSE 'low' END AS level, files_touched, introduced FROM r""")
def q34(spark, d):
    return scoring.change_risk(as_findings(spark, d).withColumn("change", F.col("line")), F.countDistinct("norm_path"), "change")


@query("q35_repeated_definitions", f"""SELECT l_orderkey, o FROM (SELECT l_orderkey, {ORD} AS o, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {ORD}) AS n FROM lineitem) WHERE n > 1""")
def q35(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("o"))
    return rulekit.repeated_definitions(li, ["l_orderkey", "l_returnflag"], "o").select("l_orderkey", "o")


@query("q36_peer_minority", """WITH c AS (SELECT c_nationkey AS g, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT g, sum(n) AS size, arg_max(v, struct_pack(n := n, v := v)) AS most, max(n) AS n FROM c GROUP BY g HAVING sum(n) >= 10 AND max(n) >= 0.2 * sum(n))
SELECT c_custkey, most FROM customer JOIN t ON g = c_nationkey WHERE c_mktsegment <> most""")
def q36(spark, d):
    return rulekit.dominant_minority(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", 10, 0.2).select("c_custkey", "most")


@query("q37_stale_files", """WITH h AS (SELECT doc_id, 'd' || doc_id AS norm_path, substr(sha256(text), 1, 16) AS hash, lang FROM documents) SELECT doc_id FROM h WHERE lang = 'fr'""")
def q37(spark, d):
    f = table(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("norm_path"), "text")
    cache = f.filter("lang <> 'fr'").select("norm_path", F.substring(F.sha2("text", 256), 1, 16).alias("hash"), F.lit("p").alias("probe"))
    return incremental.stale(f, cache, "p").select("doc_id")


@query("q38_fix_outcome", f"""WITH {FSQL}, {BC}, x AS (SELECT key, count(*) AS b FROM b GROUP BY 1), y AS (SELECT key, count(*) AS a FROM c GROUP BY 1), j AS (SELECT coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM x FULL JOIN y USING (key))
SELECT sum(greatest(b - a, 0))::BIGINT AS fixed, sum(least(a, b))::BIGINT AS remaining, sum(greatest(a - b, 0))::BIGINT AS new FROM j""")
def q38(spark, d):
    b, c = halves(as_findings(spark, d))
    return delta.fix_outcome(b, c)


@query("q39_blocking", f"WITH {FSQL} SELECT coalesce(bool_or(severity = 'error'), false) AS blocking FROM f")
def q39(spark, d):
    return findings.blocking(as_findings(spark, d), "error")


@query("q40_resolved_history", f"""WITH {FSQL}, {BC}, a AS (SELECT key, 1 AS fresh, CAST(pos AS VARCHAR) AS resolved_at FROM c UNION ALL SELECT key, 0, CAST(pos AS VARCHAR) FROM b), o AS (SELECT key, max(struct_pack(fresh := fresh, resolved_at := resolved_at)) AS x FROM a GROUP BY key)
SELECT key, x.resolved_at AS resolved_at FROM o ORDER BY x.fresh DESC, x.resolved_at DESC, key LIMIT 500""")
def q40(spark, d):
    b, c = halves(as_findings(spark, d).withColumn("resolved_at", F.col("pos").cast("string")))
    return delta.resolved_history(c, b)


@query("q41_script_calls", r"""SELECT page_id, 'track' AS name, x AS arg FROM (SELECT page_id, unnest(regexp_extract_all(html, 'track\((\d+)\)', 1)) AS x FROM pages)""")
def q41(spark, d):
    """Inline scripts of pages through the code-fact extractor: calls with their first argument."""
    script = F.regexp_extract_all("html", F.lit(r"(?s)<script>(.*?)</script>"), F.lit(1))
    texts = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.array_join(script, "\n;").alias("text"))
    return javascript.facts(texts).filter("kind = 'call'").select(F.col("file").cast("long").alias("page_id"), "name", F.get("args", F.lit(0)).alias("arg"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from factloom.plans import report_queries  # noqa: F401

    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from factloom.plans import report_queries  # noqa: F401

    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
