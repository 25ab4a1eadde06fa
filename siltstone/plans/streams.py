"""Streaming jobs run over the tables to their end; their SQL is that of the batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.shared import exists, shared_dir
from ..streaming import jobs, state
from .registry import query


def events(spark: SparkSession, sf: str, root: str) -> DataFrame:
    """The events as a stream of files; a table may be a single file, which a stream can't watch."""
    table = T.table(spark, sf, "events")
    table.write.parquet(f"{root}/in")
    return jobs.event_stream(spark, f"{root}/in", table.schema)


def to_the_end(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    started = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siltstone-streams/{uuid.uuid4().hex}"


@query("""SELECT user_id, event_id, value, nth::int AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth <= 20""")
def streamed_last_events(spark: SparkSession, sf: str) -> DataFrame:
    """The last twenty events of each user, kept in the state of a stream."""
    state.keyed_state(spark)
    root = folder(spark)
    rows = events(spark, sf, root).select("user_id", "event_id", "value")
    to_the_end(state.last_rows(rows, "user_id", "event_id", 20), state.replace_keys(f"{root}/last", "user_id", 16), f"{root}/state", "update")
    return spark.read.parquet(f"{root}/last").select("user_id", "event_id", "value", "nth")


@query("""WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS w, event_type, count(*) AS n, avg(value) AS mean_value FROM events GROUP BY ALL)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, round(n / 300::double, 9) AS rate, round(mean_value, 6) AS mean_value FROM b""")
def streamed_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and rates of five minutes by type, each replaced as it changes."""
    root = folder(spark)
    found = jobs.windowed_rates(events(spark, sf, root), "event_type", slide="5 minutes")
    to_the_end(found, jobs.upsert_into(f"{root}/rates", ["window_start", "event_type"], 16), f"{root}/state", "update")
    shown = spark.read.parquet(f"{root}/rates")
    return shown.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("rate", 9).alias("rate"), F.round("mean_value", 6).alias("mean_value"))


LOG_SQL = """log AS (
  SELECT event_id, ts, 'u' || user_id || '-' || (event_id % 50) AS key, event_type, value, event_id % 9 AS a, event_id % 4 AS b FROM events
), asked AS (SELECT *, 'find ' || a AS query, list_transform(range(b), lambda i: 'p' || (a + i)) AS paths FROM log WHERE event_type IN ('view', 'signup', 'error')
), latest AS (SELECT key, arg_max(query, ts) AS query, arg_max(paths, ts) AS paths FROM asked GROUP BY key
), told AS (SELECT key, ts, CASE WHEN event_type = 'click' THEN 'p' || b END AS doc FROM log WHERE event_type IN ('click', 'purchase')
), met AS (SELECT query, paths, coalesce(doc, paths[1]) AS positive, ts FROM told JOIN latest USING (key)
), found AS (SELECT query, positive, list_filter(paths, lambda p: p <> positive)[1] AS negative, ts FROM met)"""


@query(f"WITH {LOG_SQL} SELECT query, positive, negative, (epoch_us(min(ts)) // 1000)::bigint AS first_ms FROM found WHERE positive IS NOT NULL AND negative IS NOT NULL GROUP BY ALL")
def streamed_triplets(spark: SparkSession, sf: str) -> DataFrame:
    """Triplets mined from a stream of the events as a log, when each of its searches is over.

    A last row, a century later, moves the watermark past all others.
    """
    state.keyed_state(spark)
    root = folder(spark)
    e = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumnRenamed("event_id", "number")
    kind, a, b = F.col("event_type"), F.col("number") % 9, F.col("number") % 4
    paths = F.when(b > 0, F.transform(F.sequence(F.lit(0).cast("long"), b - 1), lambda i: F.concat(F.lit("p"), (a + i).cast("string")))).otherwise(F.array().cast("array<string>"))
    search = kind.isin("view", "signup", "error")
    log = e.where(search | kind.isin("click", "purchase")).select(
        "ts", F.when(search, "search").otherwise("feedback").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (F.col("number") % 50).cast("string")).alias("event_id"),
        F.when(search, F.concat(F.lit("find "), a.cast("string"))).alias("query"), F.when(search, paths).alias("top_paths"), F.when(kind == "click", "click").when(kind == "purchase", "thumbsup").alias("signal"),
        F.when(kind == "click", F.concat(F.lit("p"), b.cast("string"))).alias("doc_id"),
    )
    log.write.parquet(f"{root}/log")
    for year in (2124, 2125):
        end = spark.range(1).select(F.to_timestamp(F.lit(f"{year}-01-01")).alias("ts"), F.lit("search").alias("kind"), F.lit("end").alias("event_id"), F.lit("").alias("query"), F.array().cast("array<string>").alias("top_paths"), F.lit(None).cast("string").alias("signal"), F.lit(None).cast("string").alias("doc_id"))
        end.write.mode("append").parquet(f"{root}/log")
        found = state.log_triplets(jobs.event_stream(spark, f"{root}/log", log.schema), "1000 days")
        to_the_end(found, state.triplets_into(f"{root}/triplets", 16), f"{root}/state", "append")
    if not exists(spark, f"{root}/triplets"):
        return spark.createDataFrame([], "query string, positive string, negative string, first_ms bigint")
    return spark.read.parquet(f"{root}/triplets").select("query", "positive", "negative", "first_ms")
