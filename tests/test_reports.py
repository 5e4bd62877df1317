"""Reports and the sources with a grammar."""

from factloom.operators import reports
from factloom.sources import schemas


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_translations(spark):
    files = [("i/en.json", '{"a": "x {{n}}", "b": {"c": "y"}} // note'), ("i/fr.json", '{"a": "x {{m}}"}'), ("i/de/app.json", '{"a": "x {{ n }}", "b": {"c": "z"},}'), ("i/config.json", '{"a": 1}'), ("en.json", "[1")]
    keys = schemas.locale_keys(spark.createDataFrame(files, "path string, text string"))
    assert rows(reports.missing_translations(keys)) == [("fr", "a", "placeholders"), ("fr", "b.c", "missing")]
    uses, none = spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([], "x int")
    assert {r.key for r in reports.unused_keys(keys, uses, none).collect()} == {"b.c"}
    assert reports.unused_keys(keys, uses, uses).count() == 0


def test_schema_drift(spark):
    text = 'model User {\n  id Int @id\n  email String @unique\n  name String? // x\n  posts Post[]\n  @@map("users")\n}\nmodel Post {\n  id Int @id\n  at Int\n  @@index([at])\n}\nmodel Gone {\n  id Int\n}\n'
    f = schemas.orm_fields(spark.createDataFrame([("s.prisma", text)], "path string, text string"))
    assert {(r.model, r.field) for r in f.filter("is_indexed").collect()} == {("User", "id"), ("User", "email"), ("Post", "id"), ("Post", "at")}
    assert f.filter("field = 'posts' and is_list and table_name = 'users' and line = 5").count() == 1
    uses = spark.createDataFrame([("User", "name", True), ("User", "nick", False), ("Post", "at", True)], "model string, field string, is_filter boolean")
    none = spark.createDataFrame([], "x int")
    assert sorted((r.model, r.field or "", r.problem) for r in reports.schema_drift(uses, f, none).collect()) == [("Gone", "", "dead-model"), ("User", "name", "unindexed-filter"), ("User", "nick", "unknown-field")]
    assert reports.schema_drift(uses, f, uses).filter("problem = 'dead-model'").count() == 0


def test_containers(spark):
    text = "kind: Pod\nspec:\n  containers:\n  - name: a\n    image: x:1\n    resources:\n      limits:\n        cpu: 1\n  - name: b\n    image: y\n    securityContext:\n      privileged: true\n---\nkind: Job\nspec:\n  containers:\n    - image: z\n"
    c = schemas.containers(spark.createDataFrame([("p.yml", text)], "path string, text string"))
    assert rows(c.select("container", "image", "line", "has_limits", "privileged")) == [("", "z", 17, False, False), ("a", "x:1", 4, True, False), ("b", "y", 9, False, True)]


def test_dead_code_and_dependencies(spark):
    df = lambda x, s: spark.createDataFrame(x, s)
    out = reports.dead_code(df([("a",), ("b",), ("c",)], "path string"), df([("a", "b")], "src string, dst string"), df([("b", "f"), ("b", "g")], "path string, name string"), df([("b", "f", False)], "path string, name string, namespace boolean"), df([("a",)], "path string"))
    assert sorted((r.kind, r.path, r["name"] or "") for r in out.collect()) == [("unused-export", "b", "g"), ("unused-file", "c", "")]
    dep = reports.dependency_report(df([("left-pad",), ("@s/c",)], "name string"), df([("@s/c/x",), ("zod",), ("fs",), ("./a",)], "specifier string"), ["fs"])
    assert rows(dep) == [("undeclared", "zod"), ("unused", "left-pad")]


def test_supply_chain(spark):
    p = spark.createDataFrame([("a", {"prepare": "x", "postinstall": "y"}), ("b", {"prepare": "z", "test": "t"})], "name string, scripts map<string,string>")
    s = spark.createDataFrame([("a", True), ("b", False)], "name string, registry boolean")
    assert rows(reports.install_scripts(p, s)) == [("a", "postinstall", "y"), ("b", "prepare", "z")]
    li = reports.licences(spark.createDataFrame([("a", "MIT"), ("b", "GPL-3.0 OR MIT"), ("c", "GPL-3.0")], "name string, license string"))
    assert {r.license for r in li.filter("copyleft").collect()} == {"GPL-3.0"}


def test_review_and_shapes(spark):
    df = lambda x, s: spark.createDataFrame(x, s)
    edges = df([("b", "a"), ("c", "b"), ("d", "c")], "src string, dst string")
    r = reports.review_routing(df([("a",)], "path string"), edges, df([("a", "@x")], "path string, owner string"), df([("d",)], "path string")).first()
    assert (r.reach, r.deepest, r.hub, r.owners, r.level) == (3, 3, False, ["@x"], "standard")
    lines = df([("a.js", "del", "process.env.KEY_A"), ("b.js", "add", "process.env.KEY_B"), ("b.js", "del", "process.env.KEY_B"), ("db/migrations/1.sql", "add", "x")], "path string, kind string, text string")
    assert rows(reports.change_shapes(lines)) == [("a.js", "env-key-removed"), ("db/migrations/1.sql", "migration-with-feature")]


def test_exports_and_openapi(spark):
    df = lambda x, s: spark.createDataFrame(x, s)
    m = df([("p", ".", "./i.js"), ("p", "./a", "./a.js"), ("p", "./b", "b.js"), ("p", "./c", "./../c.js")], "package string, subpath string, target string")
    assert rows(reports.exports_check(m, df([("p", "i.js")], "package string, path string")).select("subpath", "problem")) == [("./a", "missing-file"), ("./b", "not-relative"), ("./c", "outside")]
    o = reports.openapi_paths(df([("GET", "/u/:id", False), ("GET", "/u/:id", True), ("POST", "/u", False)], "method string, path string, authenticated boolean"))
    assert [tuple(r) for r in o.collect()] == [("/u", "post", "postU", False), ("/u/{id}", "get", "getUId", True)]
    t = reports.attack_paths(df([(3, 2, [1, 2, 3]), (4, 1, [1, 4])], "node int, depth int, trail array<int>"), df([(3,)], "node int"))
    assert rows(t.select("hop", "place")) == [(0, 1), (1, 2), (2, 3)]
