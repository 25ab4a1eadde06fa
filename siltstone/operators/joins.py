"""Joins that fit the size of what is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast. Sides here have a few short columns, so this is some megabytes.
MOST_ROWS = 100_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows or fewer, which is looked at; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def holding(rows: DataFrame, text: Column, asked: DataFrame, token: str) -> DataFrame:
    """``rows`` joined with the rows of ``asked`` whose ``token`` stands anywhere in ``text``, once for each pair.

    The stretches of a text of the lengths that are asked for are met by equality, so that a text is not
    compared with every token. Made for short texts, such as names and paths.
    """
    lengths = [r[0] for r in asked.select(F.length(token).alias("n")).where("n > 0").distinct().orderBy("n").collect()]  # lengths, not tokens
    return rows.withColumn("_held", F.explode(stretches(text, lengths))).join(small(asked.where(F.length(token) > 0)), F.col("_held") == F.col(token)).drop("_held")


def stretches(text: Column, lengths: list[int]) -> Column:
    """The distinct stretches of a text of some lengths."""
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[_stretches(text, n) for n in lengths]))


def _stretches(text: Column, n: int) -> Column:
    """Every stretch of ``n`` characters."""
    some = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, some).otherwise(F.array().cast("array<string>"))
