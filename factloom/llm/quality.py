"""Operator 10, quality rules: a threshold table compiled into one projection, without user functions.

Defined cases: a null or empty text has no words and fails; ties cannot arise; a repeated row is judged by itself;
other columns of the input are carried through, whatever their names, unless they clash with an output column, which then
wins; very long texts are judged whole; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8

#: Frequent function words of the corpus languages.
STOP_WORDS = "the be to of and that have with in is was for der die das und ist zu den von mit ein le la les de des et que un une en el los las que y por con del".split()

STOP_FORMS = [y for x in dict.fromkeys(STOP_WORDS) for y in (x, x.capitalize())]


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; a null bound does not bind."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The verdict of the method: length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_length", "try_divide(1.0D * word_chars, n_words)", 2.0, 25.0),
    Rule("symbol_ratio", "try_divide(1.0D * n_symbols, n_words)", None, 0.5),
    Rule("stop_word_ratio", "try_divide(1.0D * stop_words, n_words)", 0.01, None),
    Rule("duplicate_lines", "try_divide(1.0D * n_dup_lines, n_word_lines)", None, 0.7),
)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean column: true if every rule of the table passes."""
    out = F.lit(True)
    for r in rules:
        value = F.expr(r.metric)
        for bound, test in ((r.low, value >= r.low if r.low is not None else None), (r.high, value <= r.high if r.high is not None else None)):
            if bound is not None:
                out = out & F.coalesce(test, F.lit(False))
    return out


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, stop_words and kept.

    Each text's 8-word windows are hashed inside its own row (64 bits); no shuffle, no Python.
    """
    mine = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stop_words", "n_word_lines"]
    keep = without(docs, *mine)
    own = "_q"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(
        *keep,
        F.split(t, SPACE).alias(own + "parts"),
        F.length(t).alias(own + "chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).alias("n_symbols"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias(own + "lines"),
    )
    # each separator is one character, so the parts count them; empty parts lie between neighbouring separators
    a = a.withColumn(own + "h", F.transform(F.filter(own + "parts", lambda w: w != ""), lambda w: F.xxhash64(w)))
    a = a.withColumn(own + "chars", F.col(own + "chars") - (F.size(own + "parts") - 1)).drop(own + "parts")
    n = F.size(own + "h")
    b = a.withColumn(own + "win", F.col(own + "h"))
    for shift in (1, 2, 4):  # hashes of 2, then 4, then 8 words; the last seven are too short and go
        b = b.withColumn(own + "win", F.expr(f"transform({own}win, (x, i) -> xxhash64(x, get({own}win, i + {shift})))"))
    b = b.withColumn(own + "win", F.slice(own + "win", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))))
    stop = F.filter(own + "h", lambda h: h.isin(*[F.xxhash64(F.lit(w)) for w in STOP_FORMS]))
    b = b.withColumn("stop_words", F.size(stop).cast("long"))
    # windows found twice or more are neighbours in the sorted list; most texts have none and are not sorted
    positions = F.transform(own + "win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    c = b.withColumn(own + "sorted", F.when(F.size(F.array_distinct(own + "win")) < F.size(own + "win"), F.sort_array(positions)))
    c = c.withColumn(own + "at", F.filter(own + "sorted", lambda x, k: F.coalesce(F.get(own + "sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(own + "sorted", k + 1)["h"] == x["h"], F.lit(False))))
    c = c.withColumn(own + "at", F.sort_array(F.transform(own + "at", lambda x: x["i"])))
    # words covered by those windows: each start adds its distance to the one before, a window at most
    covered = F.aggregate(own + "at", F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), lambda s, p: F.struct((s["sum"] + F.least(F.lit(WINDOW), p - s["last"])).alias("sum"), p.alias("last")), lambda s: s["sum"])
    repeat = F.when(F.col(own + "sorted").isNull(), F.lit(0)).otherwise(covered)
    d = c.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.col(own + "chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size(own + "lines") - F.size(F.array_distinct(own + "lines"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        "stop_words",
        F.size(own + "lines").cast("long").alias("n_word_lines"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM dup) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(lines) AS nl, len(list_filter(words, lambda x: list_contains([STOPS], x))) AS sw
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 25.0 AND n_symbols::DOUBLE / n_words <= 0.5 AND sw::DOUBLE / n_words >= 0.01 AND n_dup_lines::DOUBLE / nl <= 0.7) AS kept
FROM b
""".replace("STOPS", ", ".join(f"'{x}'" for x in STOP_FORMS))
