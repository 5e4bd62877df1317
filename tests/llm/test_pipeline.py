"""The pipeline's stages against brute force, each on what its predecessor kept."""

import re

import corpus_pipeline
from tests.llm.test_ops import brute_lines, components, words

from factloom.llm.common import stored

DATA = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, kept string, score double, _hints int, _b string, lang_pred string"
    text = "the quick words of a plain english text that goes on and on for some time"
    rows = [(i, f"{text} {i}\nmail boss{i}@corp.example", "en", "s", 5, "k", 0.5, 1, "b", "p") for i in range(30)]
    rows += [(100, None, None, None, None, None, None, None, None, None), (None, text, "en", None, 1, None, None, None, None, None), (101, "", "en", "s", 0, "k", 0.5, 1, "b", "p"), rows[0]]
    rows += [(102, text * 3000, "en", "s", 5, "k", 0.5, 1, "b", "p")]
    for start in (rows, []):
        docs = spark.createDataFrame(start, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, DATA), "test-odd")
            assert [f.name for f in docs.schema] == [x.split()[0] for x in schema.split(", ")]
        left = docs.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).select("doc_id").distinct().count() == len({r.doc_id for r in left})
        assert bool(left) == bool(start)
        assert all((r.kept, r.score, r["_hints"], r["_b"], r.lang_pred) == ("k", 0.5, 1, "b", "p") for r in left if r.doc_id is not None)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, DATA), "test-stage")
        assert docs.columns == columns
        seen[name] = (before, {r.doc_id: r for r in docs.collect()})
    before, after = seen["language ID"]
    assert {i for i in before if re.search(r"[^\W\d_]{20}", (before[i].text or ""))} <= set(after)
    before, after = seen["line dedup"]
    assert set(after) == set(before)
    from hashlib import sha256

    want = {i: h for i, _, _, h in brute_lines([(i, r.text) for i, r in before.items()])}
    assert all(sha256(r.text.encode()).hexdigest() == want[i] and r.n_chars == len(r.text) for i, r in after.items())
    before, after = seen["n-gram Jaccard join"]
    sets = {}
    for i, r in before.items():
        w = words(r.text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = components(sets, links)
    assert set(after) == {i for i in sets if root[i] == i}
    before, after = seen["personal data"]
    assert set(after) == set(before) and not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z0-9]", r.text) for r in after.values())
    assert all(after[i].text == before[i].text for i in after if not re.search("[0-9@]", before[i].text))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)
