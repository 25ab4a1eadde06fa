"""Time-varying curriculum: mixing sources to target weights.

Each source's share of the mix is a target size; its weight over training time is a piecewise
linear schedule with mean one. The schedule is integrated to the source's cumulative demand, and
the demand is inverted to give every copy of a document its training position: the time at which
the mix has taken all words before it. Documents are range-sorted by position.

Targets: sources are ordered by code point, null last, and take weights in turn; no target exceeds
``most_repeats`` times its source's size, and what is over is reshared by weight until none is.
Within a source documents follow each other in hash order, again and again until the target is
met; only the last document of a source can be taken in part. ``whole_in_training_order``, which
the pipeline uses, takes no document in part.

Built from DataFrame functions alone. The running sums are two-level (sums of buckets, then rows
of a bucket), so a source that holds a third of all rows is spread over many tasks.

Defined results: a null text has size 0 and takes nothing; null is a source of its own, apart from
the empty string. Repeated rows take turns like different ones. An empty table gives no rows.
Documents that the mix doesn't take have a null position and sort last.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, read_table

Knots = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = (5, 2, 1)
    most_repeats: int = 3
    #: (time, weight) knots from time 0 to 1, dealt to the sources in turn; scaled to mean one.
    schedules: tuple[Knots, ...] = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """From rows (no_source, source_key, source_size), one a source: target and schedule number.

    Sources by growing ratio of cap to weight: those whose cap is below their share of what the
    earlier ones leave are capped, the rest share what is left by weight.
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy("no_source", "source_key")) - 1
    weight = F.get(F.array(*[F.lit(w) for w in config.weights]), F.pmod(rank, F.lit(len(config.weights))))
    t = sizes.withColumn("schedule", F.pmod(rank, F.lit(len(config.schedules)))).withColumn("weight", weight.cast("long"))
    t = t.withColumn("cap", F.col("source_size") * config.most_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_key")
    earlier, later = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    left = total - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    t = t.withColumn("total", total).withColumn("capped", F.col("cap") * F.sum("weight").over(later) <= F.col("weight") * left)
    spare = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    sharing = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.try_divide((F.col("weight") * spare).cast("double"), sharing))
    return t.withColumn("target", target).select("no_source", "source_key", "source_size", "target", "schedule")


def time_of(share: Column, knots: Knots) -> Column:
    """Inverse of the integrated schedule: the time at which ``share`` of the demand is met."""
    area = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:]))
    met, found = 0.0, F.lit(1.0)
    for (a, u), (b, v) in reversed(list(zip(knots, knots[1:]))):
        piece = (b - a) * (u + v) / 2 / area
        before = sum((d - c) * (x + y) / 2 / area for (c, x), (d, y) in zip(knots, knots[1:]) if d <= a)
        start, slope = u / area, (v - u) / (b - a) / area
        rest = F.greatest(share - F.lit(before), F.lit(0.0))
        if abs(slope) < 1e-12:
            dt = rest / start if start else F.lit(0.0)
        else:
            dt = (F.sqrt(F.greatest(F.lit(start * start) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(start)) / F.lit(slope)
        found = F.when(share < F.lit(before + piece), F.lit(a) + dt).otherwise(found)
        met += piece
    assert math.isclose(met, 1.0)
    return found


def assign(docs: DataFrame, carry: list[str], config: MixConfig = MixConfig()) -> DataFrame:
    """Rows (doc, size, source_size, target, taken, copies), one for each row of ``docs``.

    ``doc`` is a struct of the carried columns; ``copies`` has the words and the position of every
    copy that the mix takes.
    """
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bits = max(3, math.ceil(math.log2(max(2, docs.count())) / 2))
    rows = docs.select(
        F.struct(*carry).alias("doc"), word_count(F.col("text")).alias("size"), hashed.alias("place"), F.col("doc_id").alias("id"),
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"),
        F.shiftright(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), 32 - bits).alias("bucket"),
    )
    source = ["no_source", "source_key"]
    in_buckets = rows.groupBy(*source, "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy(*source).orderBy("bucket")) - F.col("bucket_size")
    targets = source_targets(in_buckets.groupBy(*source).agg(F.sum("bucket_size").alias("source_size")), config)
    starts = in_buckets.select(*source, "bucket", before.alias("before")).join(targets, source)

    inside = Window.partitionBy(*source, "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = rows.withColumn("until", F.sum("size").over(inside)).join(starts, [*source, "bucket"])
    laid = laid.withColumn("start", F.col("before") + F.col("until") - F.col("size")).withColumn("demand", F.round("target").cast("long"))

    def position(at: Column) -> Column:
        share, found = F.try_divide(at, F.col("demand")), F.lit(None).cast("double")
        for i, knots in enumerate(config.schedules):
            found = F.when(F.col("schedule") == i, time_of(share, knots)).otherwise(found)
        return found

    def copy(k: int) -> Column:
        at = F.col("start") + F.col("source_size") * k
        words = F.greatest(F.least(F.col("size"), F.col("demand") - at), F.lit(0))
        return F.struct(words.alias("words"), position(at).alias("position"))

    copies = F.filter(F.array(*[copy(k) for k in range(config.most_repeats)]), lambda x: x["words"] > 0)
    laid = laid.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    return laid.select("doc", "size", "source_size", "target", taken.alias("taken"), "copies")


def whole_in_training_order(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """A row for each copy that the mix takes, range-sorted by position, with the columns of ``docs`` unchanged.

    A copy is taken whole if the demand covers at least half of it and left out otherwise, so a
    source is at most half a document away from its demand.
    """
    copies = assign(docs, docs.columns, config).select("doc", "size", F.explode("copies").alias("copy"))
    kept = copies.where(F.col("copy.words") * 2 >= F.col("size"))
    return kept.orderBy("copy.position", "doc.doc_id").select("doc.*")


def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, sorted by the position of its first copy; the positions of its
    second and third copy follow in columns of their own."""
    found = assign(read_table(spark, sf_dir, "documents"), ["doc_id"])
    positions = [F.round(F.get("copies", F.lit(k))["position"], 9).alias(f"position_{k + 1}" if k else "position") for k in range(MixConfig().most_repeats)]
    return found.select("doc.doc_id", "size", "source_size", "target", "taken", *positions).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def _position_sql(copy: int) -> str:
    """Position of a copy, counted from 0: the three default schedules inverted in closed form."""
    at = f"(start + {copy} * source_size)"
    share = f"(CASE WHEN size > 0 AND {at} < demand THEN {at} / demand END)"
    return f"""round(CASE schedule WHEN 0 THEN (sqrt(0.25::double + 2 * {share}) - 0.5::double)
                  WHEN 1 THEN CASE WHEN {share} < 0.5::double THEN (1.5::double - sqrt(2.25::double - 4 * {share})) / 2
                                   ELSE 0.5::double + (sqrt(0.25::double + 4 * ({share} - 0.5::double)) - 0.5::double) / 2 END
                  ELSE 1.5::double - sqrt(2.25::double - 2 * {share}) END, 9)"""


OP9_SQL = f"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key, md5(coalesce(doc_id::varchar, '')) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size
  FROM documents
), sources AS (
  SELECT no_source, source_key, sum(size)::bigint AS source_size FROM sized GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY no_source, source_key) - 1 AS r, sum(source_size) OVER () AS total, source_size * 3 AS cap FROM sources
), weighed AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked
), tested AS (
  SELECT *, cap * sum(weight) OVER later <= weight * (total - coalesce(sum(cap) OVER earlier, 0)) AS capped
  FROM weighed
  WINDOW earlier AS (ORDER BY cap / weight, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         later AS (ORDER BY cap / weight, no_source, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
  SELECT *, CASE WHEN capped THEN cap::double
                 ELSE (weight * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()))::double / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
  FROM tested
), laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.r % 3 AS schedule, round(t.target)::bigint AS demand,
         sum(s.size) OVER (PARTITION BY no_source, source_key ORDER BY place, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN targets t USING (no_source, source_key)
)
SELECT doc_id, size::bigint AS size, source_size, target,
       (greatest(least(size, demand - start), 0) + greatest(least(size, demand - start - source_size), 0) + greatest(least(size, demand - start - 2 * source_size), 0))::bigint AS taken,
       {_position_sql(0)} AS position,
       {_position_sql(1)} AS position_2,
       {_position_sql(2)} AS position_3
FROM laid
"""
