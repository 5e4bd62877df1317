"""Did-you-mean without comparing all pairs: two words within two edits share a string that both give by deleting up to
two characters, so candidates come from an equality join on those strings and the edit distance decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shorter(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))


def deletions(x: Column) -> Column:
    one = _shorter(x)
    return F.array_distinct(F.concat(F.array(x), one, F.flatten(F.transform(one, _shorter))))


def suggestions(words: DataFrame, known: DataFrame, word: str = "word", name: str = "name") -> DataFrame:
    """(word, name, distance): known names within two edits of a word, itself left out; ignoring case."""
    w = words.select(word).distinct().withColumn("_k", F.explode(deletions(F.lower(word))))
    k = known.select(name).distinct().withColumn("_k", F.explode(deletions(F.lower(name))))
    pairs = w.join(k, "_k").filter(F.col(word) != F.col(name)).select(word, name).distinct()
    return pairs.withColumn("distance", F.levenshtein(F.lower(word), F.lower(name), 2)).filter("distance >= 0")
