"""Streaming variants (X1-X5). The reference has no event time; watermarks here are an extension.

Inputs are file streams; sinks are the caller's, or ``foreachBatch`` writers below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mining import POSITIVE
from ..sources.files import upsert
from ..sources.shared import exists


def event_stream(spark: SparkSession, path: str, schema, ts: str = "ts") -> DataFrame:
    """A Parquet file stream with ``ts`` as a timestamp in the session's zone, as watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_rates(events: DataFrame, key: str, late: str = "10 minutes", window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding counts, rates and error counts of each key."""
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n", (F.col("n") / seconds).alias("rate"), "mean_value")


def latency_buckets(events: DataFrame, upper: Callable, late: str = "10 minutes") -> DataFrame:
    """Five-minute histogram buckets; quantiles are interpolated from them on read."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes").alias("w"), upper(F.col("value")).alias("upper")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "upper", "n")


def mined_triplets(searches: DataFrame, feedback: DataFrame, late: str = "1 hour") -> DataFrame:
    """Searches (event_id, ts, query, top_paths) joined with later feedback (event_id, ts, signal,
    doc_id) on the event id (X1); both sides are dropped from the state after ``late``."""
    s = searches.withWatermark("ts", late).select("event_id", F.col("ts").alias("search_ts"), "query", "top_paths")
    f = feedback.withWatermark("ts", late).where(F.lower("signal").isin(*POSITIVE)).select(F.col("event_id").alias("feedback_id"), F.col("ts").alias("feedback_ts"), "signal", "doc_id")
    met = s.join(f, F.expr(f"event_id = feedback_id and feedback_ts >= search_ts and feedback_ts <= search_ts + interval {late}"))
    positive = F.when((F.col("signal") == "click") & F.col("doc_id").isNotNull(), F.col("doc_id")).otherwise(F.get("top_paths", F.lit(0)))
    found = met.withColumn("positive", positive)
    return found.select("query", "positive", F.get(F.filter("top_paths", lambda p: p != F.col("positive")), F.lit(0)).alias("negative"), "feedback_ts").where("negative is not null")


def conversation_sessions(turns: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Conversations that have been quiet for ``gap``, ready to be indexed."""
    grouped = turns.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "conv_id")
    return grouped.agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn")).select("conv_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n_turns", "last_turn")


def merge_buckets(target: str, keys: list[str], buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batch writer into a table of hashed buckets: a batch reads and replaces the buckets of its own keys
    alone. ``merge`` (old rows, batch) must give the same if a batch is tried again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets, at most
        if not touched:
            return
        if exists(spark, target):
            new = merge(spark.read.parquet(target).where(F.col("bucket").isin(touched)).select(new.columns), new)
        else:
            new = merge(new.limit(0), new)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return write


def keep_last(target: str, key: str, order: str, n: int, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps the last ``n`` rows of each key (X4), told apart by ``order``."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        once = old.unionByName(new).dropDuplicates([key, order])
        return once.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")

    return merge_buckets(target, [key], buckets, merge)


def upsert_into(target: str, keys: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch writer that upserts chunks."""
    return merge_buckets(target, keys, buckets, lambda old, new: upsert(old, new, keys))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
