"""Differences between two versions of a text, line by line, as joins over counted lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.chunks import trimmed


def line_counts(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, line, count) of the trimmed lines that are not empty."""
    lines = df.select(F.col(key).alias("key"), F.explode(F.split(F.col(text), "\n")).alias("line")).select("key", trimmed(F.col("line")).alias("line"))
    return lines.where("line <> ''").groupBy("key", "line").agg(F.count(F.lit(1)).alias(name))


def line_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, added, removed, unchanged, similarity) of each key on both sides; lines count as often as they stand.

    Similarity is twice the unchanged lines over the number of different lines of both sides, 0 without lines.
    Keys should be unique on each side; lines of repeated keys count together.
    """
    both = line_counts(old, key, text, "o").join(line_counts(new, key, text, "n"), ["key", "line"], "full").fillna(0, ["o", "n"])
    per = both.groupBy("key").agg(
        F.sum(F.greatest(F.col("n") - F.col("o"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))).alias("removed"),
        F.sum(F.least("o", "n")).alias("unchanged"), F.sum((F.col("o") > 0).cast("long") + (F.col("n") > 0).cast("long")).alias("kinds"),
    )
    keys = old.where(F.col(text).isNotNull()).select(F.col(key).alias("key")).distinct().join(new.where(F.col(text).isNotNull()).select(F.col(key).alias("key")).distinct(), "key")
    out = keys.join(per, "key", "left").fillna(0)
    similarity = F.when(F.col("kinds") > 0, F.round(2 * F.col("unchanged") / F.col("kinds"), 6)).otherwise(0.0)
    return out.select(F.col("key").alias(key), "added", "removed", "unchanged", similarity.alias("similarity"))
