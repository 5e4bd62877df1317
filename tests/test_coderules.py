"""Code facts and rules: what fires and what stays silent."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import coderules, findings
from factloom.plans.rule_cases import CASES
from factloom.sources import javascript



UNTESTED = {"no-local-date-as-iso-datestring", "no-unawaited-hono-body", "no-flaky-test-pattern", "no-hardcoded-secret-fallback"}


@pytest.fixture(scope="module")
def found(spark):
    texts = spark.createDataFrame([(f"{i}/{k}.js", t) for i, (_, *both) in enumerate(CASES) for k, t in enumerate(both)], "path string, text string")
    facts = javascript.facts(texts).cache()
    local = {(r.norm_path, r.diagnostic) for r in coderules.local_findings(facts).collect()}
    local |= {(r.norm_path, r.diagnostic) for r in coderules.reachable_sync_io(facts).collect()}
    return local | {(r.norm_path, r.diagnostic) for r in coderules.relational_findings(facts).collect()}


def test_every_rule_has_a_case():
    assert {r.id for r in coderules.RULES} - {c[0] for c in CASES} <= UNTESTED


def test_circular_imports(spark):
    texts = spark.createDataFrame([("a.js", "import './b';"), ("b.js", "\nimport './c';"), ("c.js", "import './a'; import './d';"), ("d.js", "import './e';"), ("e.js", "")], "path string, text string")
    out = coderules.circular_imports(javascript.facts(texts), texts)
    assert sorted((r.norm_path, r.line, r.diagnostic) for r in out.collect()) == [(p, n, "no-circular-imports") for p, n in (("a.js", 1), ("b.js", 2), ("c.js", 1))]


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_rule(found, i):
    assert (f"{i}/0.js", CASES[i][0]) in found
    assert (f"{i}/1.js", CASES[i][0]) not in found


def test_odd_texts(spark):
    texts = spark.createDataFrame([("a.js", None), ("b.js", ""), ("c.js", "f((;"), ("d.js", "(" * 2000), ("e.js", "const s = `a ${b ? `c` : {}} d`; // (\nconst r = a ? /[/(]/ : 1 / 2;"), ("f.js", "🙂 'unclosed")], "path string, text string")
    facts = javascript.facts(texts)
    assert {r.norm_path for r in coderules.parse_failures(facts).collect()} == {"c.js", "d.js"}


def test_gate_suppression_and_edges(spark):
    text = "// factloom-disable-next-line no-trust-proxy-true\napp.set('trust proxy', true);\napp.set('trust proxy', true);\nimport x from '../lib/x';\nimport type y from './y';\nconst z = require('./z');"
    texts = spark.createDataFrame([("src/a.js", text), ("lib/x.ts", ""), ("src/z/index.js", ""), ("src/y.ts", "")], "path string, text string")
    facts = javascript.facts(texts)
    f = coderules.gated(coderules.local_findings(facts), F.array(F.lit("express")))
    kept = findings.suppress(f.select("norm_path", "line", "diagnostic"), coderules.directives(facts)).filter("not suppressed")
    assert [(r.line, r.diagnostic) for r in kept.collect()] == [(3, "no-trust-proxy-true")]
    assert coderules.gated(coderules.local_findings(facts), F.array(F.lit("koa"))).count() == 0
    assert sorted(tuple(r) for r in coderules.import_edges(facts, texts).collect()) == [("src/a.js", "lib/x.ts"), ("src/a.js", "src/z/index.js")]


def test_long_values_are_whole(spark):
    many = ", ".join(f"name{k}" for k in range(300))
    rows = [
        ("race", f"await Promise.race([f({'1 + ' * 200} 1), timeout(5)]);"),
        ("all", f"await Promise.all({'a.' * 300}xs.map(f));"),
        ("import", f"import {{ {many} }} from 'far';\nimport local\n;g('near');"),
    ]
    f = javascript.facts(spark.createDataFrame(rows, "path string, text string")).collect()
    args = {r.file: r.args for r in f if r.kind == "call" and r.name in ("Promise.race", "Promise.all")}
    assert "timeout(5)" in args["race"][0] and args["all"][0].endswith("xs.map(f)")
    own = [r for r in f if r.kind == "import"]
    assert [(r.name, len(r.args)) for r in own] == [("far", 300)] and {f"name{k}" for k in range(300)} <= set(own[0].idents)
