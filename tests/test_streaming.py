"""Streaming jobs over small file streams."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import mining
from siltstone.streaming import jobs, state


def test_windowed_rates(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(source)
    table.limit(200).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), table.schema)
    jobs.run_once(jobs.windowed_rates(stream, "event_type", slide="5 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < found.agg(F.sum("n")).first()[0] <= 200


def test_mined_triplets(spark, tmp_path):
    s = spark.createDataFrame([("e1", "2024-01-01 00:00:00", "q", ["a", "b"]), ("e9", "2024-01-02 00:00:00", "q", ["a", "b"])], "event_id string, ts string, query string, top_paths array<string>")
    f = spark.createDataFrame([("e1", "2024-01-01 00:01:00", "thumbsup", None), ("e9", "2024-01-03 00:00:00", "click", "b")], "event_id string, ts string, signal string, doc_id string")
    for name, t in (("s", s), ("f", f)):
        t.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / name))
    read = lambda name: jobs.event_stream(spark, str(tmp_path / name), spark.read.parquet(str(tmp_path / name)).schema)
    jobs.run_once(jobs.mined_triplets(read("s"), read("f")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("q", "a", "b")]


def test_upsert_batches(spark, tmp_path):
    target = str(tmp_path / "t")
    write = jobs.upsert_into(target, ["k"], 4)
    second = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    write(spark.createDataFrame([(k, "a") for k in (1, 3, 4, 5, 6, 7)], "k int, v string"), 0)
    write(second, 1)
    write(second, 1)  # tried again
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(target).collect()) == [(1, "b"), (2, "c"), *((k, "a") for k in (3, 4, 5, 6, 7))]


def test_last_rows_are_kept(spark, tmp_path):
    target = str(tmp_path / "t")
    write = jobs.keep_last(target, "k", "ts", 3, 4)
    for batch in (range(4), range(4, 6), range(4, 6)):
        write(spark.createDataFrame([(k, ts) for k in ("a", "b") for ts in batch] + [("c", 0)], "k string, ts int"), 0)
    found = sorted((r["k"], r["ts"]) for r in spark.read.parquet(target).collect())
    assert found == [(k, ts) for k in ("a", "b") for ts in (3, 4, 5)] + [("c", 0)]


def test_sessions_and_latency_buckets(spark, tmp_path):
    rows = [("c1", i, f"2024-01-01 00:00:0{i}") for i in range(3)] + [("c2", 0, "2024-01-01 00:00:00"), ("c2", 1, "2024-01-01 00:00:20"), ("c3", 0, "2024-01-02 00:00:00")]
    t = spark.createDataFrame(rows, "conv_id string, turn int, ts string").withColumn("ts", F.to_timestamp("ts"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), t.schema)
    jobs.run_once(jobs.conversation_sessions(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    found = sorted((r["conv_id"], r["n_turns"], r["last_turn"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert set(found) <= {("c1", 3, 2), ("c2", 1, 0), ("c2", 1, 1), ("c3", 1, 0)} and ("c1", 3, 2) in found
    valued = t.withColumn("value", F.col("turn").cast("double"))
    valued.write.parquet(str(tmp_path / "in2"))
    stream = jobs.event_stream(spark, str(tmp_path / "in2"), valued.schema)
    jobs.run_once(jobs.latency_buckets(stream, lambda v: F.ceil(v)), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    n = {(str(r["window_start"]), r["upper"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert n.get(("2024-01-01 00:00:00", 0)) == 2


def feed(spark, tmp_path, batches, schema, job, write):
    """Run a stream over the batches one after the other, with what it emits given to ``write``."""
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        made = spark.read.parquet(source)
        stream = job(jobs.event_stream(spark, source, made.schema))
        started = stream.writeStream.outputMode(MODES.get(job, "update")).foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        started.awaitTermination()
    return spark.read.parquet(source)


MODES = {state.log_triplets: "append"}


def test_last_rows_of_keyed_state_equal_the_batch(spark, tmp_path):
    """Late rows, repeated rows and many keys over several batches."""
    state.keyed_state(spark)
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(40)}", f"2024-01-01 00:{rng.randrange(60):02d}:{rng.randrange(60):02d}", i) for i in range(600)]
    rows = [(k, ts, int(ts.replace("-", "").replace(":", "").replace(" ", ""))) for k, ts, _ in rows]
    batches = [rows[:250], rows[200:450], rows[:50] + rows[450:]]
    target = str(tmp_path / "t")
    everything = feed(spark, tmp_path, batches, "k string, ts string, v bigint", lambda s: state.last_rows(s, "k", "ts", 5), state.replace_keys(target, "k", 4))
    w = Window.partitionBy("k").orderBy(F.desc("ts"))
    expected = everything.withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates(["k", "ts"]).withColumn("nth", F.row_number().over(w)).where("nth <= 5")
    shown = lambda t: sorted(map(tuple, t.select("k", "ts", "v", "nth").collect()))
    assert shown(spark.read.parquet(target)) == shown(expected) and expected.count() > 150


def test_log_triplets_equal_the_batch(spark, tmp_path):
    """Queries after their feedback, later queries, repeats over batches and within one."""
    state.keyed_state(spark)
    rng = random.Random(6)
    rows = []
    for e in range(120):
        at = lambda: f"2024-01-01 0{rng.randrange(2)}:{rng.randrange(60):02d}:{rng.randrange(60):02d}"  # noqa: B023, E731
        for q in range(rng.randrange(3)):
            rows.append((at(), "search", f"e{e}", f"q{e % 7}", [f"p{rng.randrange(4)}" for _ in range(rng.randrange(4))], None, None))
        for _ in range(rng.randrange(3)):
            rows.append((at(), "feedback", f"e{e}", None, None, rng.choice(["click", "thumbsup", "Star5", "thumbsdown"]), rng.choice([None, "p1", "p9"])))
    rows = list({(r[0], r[2], r[1]): r for r in rows}.values())
    rng.shuffle(rows)
    batches = [rows[: len(rows) // 2], rows[len(rows) // 2 :] + rows[:40], [("2024-01-03 00:00:00", "search", "end", "x", [], None, None)], [("2024-01-04 00:00:00", "search", "end", "x", [], None, None)]]
    schema = "ts string, kind string, event_id string, query string, top_paths array<string>, signal string, doc_id string"
    target = str(tmp_path / "t")
    job = lambda s: state.log_triplets(s, "3 hours")
    MODES[job] = "append"
    everything = feed(spark, tmp_path, batches, schema, job, state.triplets_into(target, 4))
    batch = mining.triplets(everything.withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("corpus_id", F.lit("c")))
    expected = sorted((r["query"], r["positive"], r["negative"], r["first_ts"]) for r in batch.collect())
    assert sorted((r["query"], r["positive"], r["negative"], r["first_ms"]) for r in spark.read.parquet(target).collect()) == expected and len(expected) > 10
