"""Every query with SQL against DuckDB on sf0.001."""

import re
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
import __spark_entry__ as entry
from factloom.operators import graph, history, summaries
from factloom.plans import rule_cases
from factloom.sources import javascript

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


MAY_BE_EMPTY: set[str] = set()
"""Queries that find nothing in so small a table."""


def plain(v):
    if v is None or v != v:
        return "-"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())
    assert got == want
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", ["q02_health_score", "q17_text_scan", "q44_scan"])
def test_scan_of_odd_letters(spark, tmp_path, name):
    """Letters and digits of other scripts are no word characters, as in the SQL."""
    texts = ["ÉABCD EF", "ABCD EFÉ", "x ßABCD EF\u0301 y", "٠WXYZ AB٠", "ABCD EF", "éABCD EFg", "_ABCD EF", "中ABCD EF中\nABCD\u00a0EF", "", None]
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = c.execute(entry.oracle_sql()[name])
    names = sorted(x[0] for x in cur.description)
    order = [[x[0] for x in cur.description].index(n) for n in names]
    got = sorted(tuple(plain(r[n]) for n in names) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["q55_blame", "q56_changed_by"])
def test_no_join_of_parts_with_suppliers_alone(spark, name):
    """Pairs of files and lines are not made before blame is joined to them."""
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(p_size#\d+ = s_nationkey#\d+\)", plan)


def test_blame_of_odd_pairs(spark):
    """Repeated files and lines, null places, lines without a commit: as the plain join of all pairs."""
    files = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 8), (None, 7), (4, None), (5, 9)], "path long, key int")
    lines = spark.createDataFrame([(10, 7), (10, 7), (11, 7), (None, 7), (12, 8), (13, 8), (14, None)], "line long, key int")
    blame = spark.createDataFrame([(1, 10, "a"), (2, 11, "b"), (3, 13, "0" * 40), (3, 99, "a"), (9, 10, "a")], "path long, line long, sha string")
    commits = spark.createDataFrame([("a", "2004-12-31 00:00:00"), ("c", "2004-01-01 00:00:00")], "sha string, at string").select("sha", F.col("at").cast("timestamp").alias("committed_at"))
    now = F.lit("2005-01-01 00:00:00").cast("timestamp")
    plain_join = history.blame_ages(files.join(lines, "key").select("path", "line"), blame, commits, now).select("path", "line", "sha", "age")
    got = history.blame_ages_of_pairs(files, lines, "key", blame, commits, now)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain_join.collect()))
    want = history.changed_by(files.join(lines, "key").select("path", "line"), blame, commits).select("path", "line")
    assert sorted(map(str, history.changed_lines(history.blame_of_pairs(files, lines, "key", blame), commits).select("path", "line").collect())) == sorted(map(str, want.collect()))


def test_equal_texts_are_parsed_once(spark, monkeypatch):
    """q42 parses a case once, however many orders it is dealt to."""
    seen = []
    monkeypatch.setattr(javascript, "facts", lambda texts, f=javascript.facts: (seen.append(texts), f(texts))[1])
    entry.queries()["q42_code_rules"](spark, DATA)
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    assert seen[0].count() == orders.select(F.col("o_orderkey") % (2 * len(rule_cases.CASES))).distinct().count() < orders.count()


def test_stars_of_complete_modules_go(spark, monkeypatch):
    """Modules that offer all names take no further part, and what is found stays the same."""
    left = []
    monkeypatch.setattr(graph, "cut", lambda df, f=graph.cut: (left.append(df.count()) if df.columns == ["src", "dst"] else None, f(df))[1])
    exports = spark.createDataFrame([(1, "a"), (2, "b")], "path long, name string")
    stars = spark.createDataFrame([(3, 1), (3, 2), (4, 3), (3, 4), (5, 4), (5, 1), (1, 5), (6, 7)], "src long, dst long")
    got = sorted(tuple(r) for r in summaries.through_reexports(exports, stars).collect())
    assert got == [(1, "a", 1), (1, "b", 2), (2, "b", 2), (3, "a", 1), (3, "b", 2), (4, "a", 1), (4, "b", 2), (5, "a", 1), (5, "b", 2)]
    assert left[0] == 8 and left[-1] == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
