"""Row types of findings and facts."""

from __future__ import annotations

from pyspark.sql import types as T

PLUGIN = "factloom"
#: The categories in the order of reports, their weights, and those of severities.
CATEGORIES = ("Security", "Reliability", "Bugs", "Performance", "Maintainability")
CATEGORY_WEIGHTS = {"Security": 2.0, "Reliability": 1.5, "Bugs": 1.5, "Performance": 1.0, "Maintainability": 0.5}
SEVERITY_WEIGHTS = {"error": 3.0, "warn": 1.0}
DENSITY_AT_ZERO = 100.0

FINDING = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("file_path", T.StringType()),
        T.StructField("norm_path", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("plugin", T.StringType()),
        T.StructField("diagnostic", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.StringType()),
        T.StructField("suppression_hint", T.StringType()),
        T.StructField("evidence_key", T.StringType()),
    ]
)
FILES = "path string, norm_path string, text string, n_lines int"
RULES = "id string, title string, category string, severity string, opt_in boolean, scope string, requires array<string>, requires_any array<string>, disabled_when array<string>, tags array<string>"
