"""Scalar functions on columns. Everything here stays inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with \b as RE2 and JavaScript mean it: Java 17 counts letters and digits of all scripts to \b, but not to \w."""
    return re.sub(r"\\(.)", lambda m: WORD_EDGE if m[1] == "b" else m[0], pattern, flags=re.S)


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits on doubles, the rounding that the scores are defined with."""
    scale = float(10**digits)
    x = x.cast("double")
    return (F.floor(x * scale + 0.5) / scale) if digits else F.floor(x + 0.5)


def line_count(text: Column) -> Column:
    """0 for an empty text, else one more than its line breaks."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1)))


def sha_prefix(x: Column, n: int) -> Column:
    return F.substring(F.sha2(x, 256), 1, n)


def evidence_text(x: Column) -> Column:
    """White space squeezed, trimmed, 200 characters at most."""
    return F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 200)


def finding_id(path: Column, line: Column, col: Column, plugin: str, rule: Column, message: Column) -> Column:
    line, col = line.cast("string"), col.cast("string")
    return F.concat(path, F.lit("::"), line, F.lit(":"), col, F.lit(f"::{plugin}/"), rule, F.lit("::"), sha_prefix(F.concat_ws("|", path, line, col, rule, message), 8))


def evidence_key(rule: Column, message: Column, evidence: Column) -> Column:
    """For structural findings: each part with its length."""
    parts = [F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in (rule, message, evidence)]
    return sha_prefix(F.concat_ws("|", *parts), 16)


def text_evidence_key(rule: Column, message: Column, line: Column) -> Column:
    """For text findings: the parts with a space between."""
    return sha_prefix(F.concat_ws(" ", rule, message, line), 16)


def normalized_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[_-]", "")


def major_version(x: Column) -> Column:
    return F.regexp_extract(x, r"(\d+)", 1).cast("int")


def version_parts(x: Column) -> Column:
    """Array of the three numbers of an x.y.z prefix, null if there is none."""
    m = F.regexp_extract(x, r"^v?(\d+\.\d+\.\d+)", 1)
    return F.when(m != "", F.transform(F.split(m, r"\."), lambda p: p.cast("int")))


def path_template(x: Column) -> Column:
    """/a/:id to /a/{id}."""
    return F.regexp_replace(x, r":([A-Za-z_][A-Za-z0-9_]*)", r"{$1}")


def placeholders(x: Column) -> Column:
    """Names in {{name}}, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"\{\{\s*([A-Za-z0-9_.]+)\s*\}\}"), 1)))


def age_days(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_millis(now) - F.unix_millis(then)) / 86_400_000))


def purl(name: Column, version: Column) -> Column:
    """npm package URL: the scope's @ is percent-encoded."""
    return F.concat(F.lit("pkg:npm/"), F.regexp_replace(F.lower(name), "^@", "%40"), F.lit("@"), version)


def dependency_class(spec: Column) -> Column:
    """How a dependency is pinned: exact, range, tag, git or url."""
    return (
        F.when(spec.rlike(r"^(git\+|git:|git@|github:|gitlab:|bitbucket:)|^[\w.-]+/[\w.-]+(#.*)?$"), "git")
        .when(spec.rlike(r"^(https?|file):"), "url")
        .when(spec.rlike(r"^=?v?\d+\.\d+\.\d+([-+][0-9A-Za-z.+-]+)?$"), "exact")
        .when(spec.rlike(r"[\^~><=*xX|]|^\d"), "range")
        .otherwise("tag")
    )


def did_you_mean(word: Column, candidate: Column) -> Column:
    """Edit distance up to 2, else null."""
    d = F.levenshtein(word, candidate, 2)
    return F.when(d >= 0, d)
