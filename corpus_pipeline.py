"""A corpus pipeline of five training-data operators: language ID, line dedup, near-duplicate join, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next one's docs. All but the last return the columns of docs, whatever further ones there are and however they are
named, with n_chars brought up to date where a text changed. An empty table passes through all stages as such, and very
long texts are processed whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import jaccard, language, lines, packing, pii
from factloom.llm.common import fold, stored

REJECT = 0.3
"""Documents whose best language scores less are rejected, as are those without a letter."""


def _resized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars brought up to date and its columns in the given order."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*(f"`{c}`" for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is null, empty or without a letter go, as do those whose best language scores too little (a
    score of REJECT itself stays); so does every document if no language can be learned. Repeated rows stay or go alike."""
    return language.accepted(docs, language.fit(docs.filter(fold(docs, 5) != 0)), REJECT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go, documents stay. A null text becomes an empty one; a null doc_id comes after all others; rows that repeat a
    doc_id are one document and lose no lines to each other."""
    return _resized(lines.clean(docs, in_place=True), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest doc_id stays. Texts without a word and rows with a null doc_id stay; rows
    that repeat a doc_id are one document, and stay or go together."""
    gone = jaccard.join(docs).filter("doc_id <> class_id").select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced, documents stay. A null text stays null; a row with a null doc_id keeps its terms and loses its base
    spans; repeated rows give repeated results."""
    return _resized(pii.sanitise(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece. A null or empty text is one piece of one id; repeated rows are packed each for itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data), ("packing", pack)]

#: The classifier and the packing are not expressible in SQL. The tests hold line dedup, the join and personal data against
#: brute-force versions, language ID against the rows it was not fitted on, and packing against the ids it must hold.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i}")
    return docs
