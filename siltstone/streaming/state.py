"""Jobs with keyed state (X1, X4): the last rows of each key, and triplets mined from a log as its events end.

State is kept by key in the state store, not in tables that batches rewrite; the sinks of `jobs` take what is
emitted. The last rows need a state store that holds lists: `keyed_state` chooses it for the session's streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType, TimestampType

from ..operators.mining import POSITIVE
from .jobs import merge_buckets

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state in a store that holds lists, values and timers."""
    spark.conf.set(PROVIDER, ROCKS)


class LastRows(StatefulProcessor):
    """The last ``n`` rows of a key by ``order``. A row of an order that is held is a repeat; late rows find their place."""

    def __init__(self, schema: StructType, order: str, n: int, keep_ms: int | None) -> None:
        self.schema, self.at, self.n, self.keep_ms = schema, schema.fieldNames().index(order), n, keep_ms
        self.names = [*schema.fieldNames(), "nth"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("last", self.schema, self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = {r[self.at]: tuple(r) for r in self.held.get()} if self.held.exists() else {}
        for row in rows:
            if row[self.at] is not None:
                known.setdefault(row[self.at], tuple(row))
            if len(known) > 4 * self.n:  # a batch may hold any number of a key's rows
                known = {o: known[o] for o in sorted(known)[-self.n :]}
        last = sorted(known)[-self.n :]
        if last:
            self.held.put([known[o] for o in last])
        for nth, o in enumerate(reversed(last), 1):
            yield Row(**dict(zip(self.names, (*known[o], nth))))

    def close(self) -> None:
        pass


def last_rows(stream: DataFrame, key: str, order: str, n: int, keep: str | None = None) -> DataFrame:
    """After every batch the last ``n`` rows of each key that it touched, ``nth`` 1 for the newest (X4). With ``keep``,
    a number of minutes as text, the rows of a key are dropped when they have not changed for that long."""
    times = [f.name for f in stream.schema if isinstance(f.dataType, TimestampType)]  # kept as numbers, which no time zone moves
    rows = stream.withColumns({c: F.unix_micros(c) for c in times}) if times else stream
    out = StructType([*rows.schema.fields, StructField("nth", IntegerType())])
    keep_ms = int(float(keep) * 60_000) if keep else None
    found = rows.groupBy(key).transformWithState(LastRows(rows.schema, order, n, keep_ms), out, "Update", "ProcessingTime" if keep else "None")
    return found.withColumns({c: F.timestamp_micros(c) for c in times}) if times else found


def replace_keys(target: str, key: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch writer for what `last_rows` emits: a key's rows take the place of those it had."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select(key).distinct(), key, "left_anti").select(new.columns).unionByName(new)

    return merge_buckets(target, [key], buckets, merge)


def log_triplets(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """(query, positive, negative, first_ms) of a log stream (ts, kind, event_id, query, top_paths, signal, doc_id), as
    `mining.triplets` finds them (X1). An event is over when nothing of it has come for ``late`` of event time; its query
    may come after its feedback, and the latest one counts. Repeated rows count once; rows later than ``late`` are dropped, as by every watermark.

    An event is a session of its id: its latest query and its distinct feedback are aggregated, so no row goes through Python."""
    kind = F.col("kind")
    search, feedback = kind.isin("search", "chat"), (kind == "feedback") & F.lower("signal").isin(*POSITIVE)
    rows = log.withWatermark("ts", late).where((search | feedback) & F.col("event_id").isNotNull() & F.col("ts").isNotNull())
    asked = F.max(F.when(search, F.struct(F.unix_micros("ts").alias("at"), "query", "top_paths"))).alias("asked")
    told = F.collect_set(F.when(feedback, F.struct(F.unix_millis("ts").alias("at_ms"), "signal", "doc_id"))).alias("told")
    events = rows.groupBy(F.session_window("ts", late).alias("session"), "event_id").agg(asked, told)
    each = events.where(F.trim("asked.query") != "").select("asked.query", "asked.top_paths", F.explode("told").alias("told"))
    positive = F.when((F.col("told.signal") == "click") & F.col("told.doc_id").isNotNull(), F.col("told.doc_id")).otherwise(F.get("top_paths", F.lit(0)))
    found = each.select("query", positive.alias("positive"), "top_paths", F.col("told.at_ms").alias("first_ms"))
    negative = F.get(F.filter("top_paths", lambda p: p.isNotNull() & (p != F.col("positive"))), F.lit(0))
    return found.select("query", "positive", negative.alias("negative"), "first_ms").where("positive is not null and negative is not null")


def triplets_into(target: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch writer of mined triplets: equal ones once, with the earliest feedback, over all batches."""
    keys = ["query", "positive", "negative"]

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy(*keys, "bucket").agg(F.min("first_ms").alias("first_ms"))

    return merge_buckets(target, keys, buckets, merge)
