"""Row numbers and order statistics over all rows, without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str], bucket: Column, name: str = "number", group: list[str] | None = None) -> DataFrame:
    """``rows`` with their number from 1 by ``order``, in each ``group`` if one is given.

    ``bucket`` is a column that grows with the order and cuts it into stretches; a window numbers the
    rows of a stretch, and the counts of the stretches before are added.
    """
    by = group or []
    cut = rows.withColumn("_bucket", bucket)
    counts = cut.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    counts = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    out = cut.withColumn(name, F.row_number().over(inside)).join(counts, [*by, "_bucket"])
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before")


def hash_bucket(hashed: Column) -> Column:
    """Stretches of a hash in hex: its first three digits."""
    return F.conv(F.substring(hashed, 1, 3), 16, 10).cast("int")


def at_index(rows: DataFrame, group: str, value: str, index: Column, name: str) -> DataFrame:
    """(group, name): the value at an index from 0 of each group's values in order.

    ``index`` is a function of the column ``n``, the number of a group's values. Equal values are counted first, so they
    are one row however many there are. Approximate percentiles cut a group into a hundred stretches; only
    the values of the one that holds the index are put in order.
    """
    known = rows.where(F.col(value).isNotNull()).select(group, value)
    edges = known.groupBy(group).agg(F.percentile_approx(value, [i / 100 for i in range(1, 100)], 10_000).alias("_edges"), F.count("*").alias("n"))
    each = known.groupBy(group, value).agg(F.count("*").alias("_c"))
    cut = each.join(edges, group).withColumn("_bucket", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    counts = cut.groupBy(group, "_bucket").agg(F.sum("_c").alias("_n"), F.first("n").alias("n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket"))  # a hundred rows a group
    held = counts.withColumn("_upto", upto).withColumn("_index", index).where((F.col("_index") < F.col("_upto")) & (F.col("_index") >= F.col("_upto") - F.col("_n")))
    held = held.select(group, "_bucket", (F.col("_index") - F.col("_upto") + F.col("_n")).alias("_nth"))
    inside = F.sum("_c").over(Window.partitionBy(group, "_bucket").orderBy(value))
    found = cut.join(held, [group, "_bucket"]).withColumn("_to", inside)
    return found.where((F.col("_nth") < F.col("_to")) & (F.col("_nth") >= F.col("_to") - F.col("_c"))).select(group, F.col(value).alias(name))
