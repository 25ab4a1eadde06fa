"""Evaluation, mining, recall, statistics, cost and storage queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RecallConfig
from ..engine import Engine
from ..functions.text import find_all, line_ends, tokens
from ..operators import embedding, evaluation, fusion, mining, recall, sparse, stats
from ..operators.embedding import EmbeddingConfig
from ..operators.joins import small
from ..operators.sparse import SearchIndex
from ..sources import files as S
from ..sources import tables as T
from ..sources.blocks import read_blocks
from ..sources.shared import shared_dir, staged
from . import search
from .registry import query

# Evaluation: expected are the files that hold a passage, retrieved those of the best chunks.

EVAL_SQL = f"""{search.BM25_SQL}, expected AS (
  SELECT b.item_id AS query_id, f.file_path AS path FROM benchmark b JOIN files f ON contains(f.content, b.text)
), top AS (SELECT * FROM (SELECT query_id, regexp_replace(chunk_id, ':[0-9]+$', '') AS path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS place FROM bm25) WHERE place <= 40
), retrieved AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY min(place)) AS rank FROM top GROUP BY query_id, path
), met AS (SELECT r.query_id, r.rank, r.path, e.path AS expected FROM retrieved r JOIN expected e ON r.query_id = e.query_id AND contains(lower(r.path), lower(e.path))
), wanted AS (SELECT query_id, count(DISTINCT path) AS n FROM expected GROUP BY query_id
), per_rank AS (SELECT query_id, min(rank) AS first, sum((rank <= 5)::int) AS hits5, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM (SELECT DISTINCT query_id, rank FROM met) GROUP BY query_id
), per_expected AS (SELECT query_id, sum((r <= 5)::int) AS f5, sum((r <= 10)::int) AS f10, sum((r <= 20)::int) AS f20 FROM (SELECT query_id, expected, min(rank) AS r FROM met GROUP BY ALL) GROUP BY query_id
), metrics AS (
  SELECT t.query_id, coalesce(1 / p.first::double, 0) AS reciprocal_rank, coalesce(x.f5 / t.n::double, 0) AS recall_5, coalesce(x.f10 / t.n::double, 0) AS recall_10, coalesce(x.f20 / t.n::double, 0) AS recall_20,
         coalesce(p.hits5 / 5::double, 0) AS precision_5, coalesce(p.dcg / list_sum(list_transform(range(1, least(t.n, 10) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg_10,
         coalesce(p.first = 1, false) AS top1_hit, coalesce(p.first <= 5, false) AS topk_hit
  FROM wanted t LEFT JOIN per_rank p USING (query_id) LEFT JOIN per_expected x USING (query_id))"""


def holders(index: SearchIndex, files: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, path) of the files that hold a passage whole.

    A passage is looked for in the files that have its rarest word, which the words of the chunks are gone through for. Its first and last words
    may be parts of longer ones and don't count; passages without another word are met with every file.
    """
    words = tokens(F.col("passage"))
    known = passages.select("query_id", "passage", F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))).alias("inner"))
    usable = F.size("inner") > 0
    each = known.where(usable).select("query_id", F.explode("inner").alias("term"))
    met = staged(sparse.files_with(index.words, sparse.rarest(index.words, each)), "met")
    near = files.select("file_path", "content").join(small(met), "file_path").join(small(known.select("query_id", "passage")), "query_id").where(F.contains("content", F.col("passage")))
    rest = files.join(small(known.where(~usable), 1000), F.contains("content", F.col("passage")))
    return near.select("query_id", F.col("file_path").alias("path")).union(rest.select("query_id", "file_path")).distinct()


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    passages = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    expected = holders(T.index(spark, sf), T.files(spark, sf), passages)
    deep = 2 * evaluation.depth()
    hits = search.sparse.bm25_best(T.index(spark, sf).words, T.questions(spark, sf), deep).withColumn("score", F.round("score", 6))
    retrieved = search.sparse.best(hits, deep).select("query_id", F.regexp_replace("chunk_id", ":[0-9]+$", "").alias("path"), "rank")
    return evaluation.per_query(expected, retrieved)


@query(f"WITH {EVAL_SQL} SELECT query_id, round(reciprocal_rank, 6) AS reciprocal_rank FROM metrics")
def mrr(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select("query_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(f"WITH {EVAL_SQL} SELECT query_id, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(recall_20, 6) AS recall_20, round(precision_5, 6) AS precision_5, round(ndcg_10, 6) AS ndcg_10 FROM metrics")
def recall_precision_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return metrics(spark, sf).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "recall_20", "precision_5", "ndcg_10")])


@query(f"WITH {EVAL_SQL} SELECT count(*) AS n, round(avg(top1_hit::int), 6) AS top1_accuracy, round(avg(topk_hit::int), 6) AS topk_accuracy, round(avg(reciprocal_rank), 6) AS mrr FROM metrics")
def hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 6).alias(name)
    return metrics(spark, sf).agg(F.count("*").alias("n"), one("top1_hit", "top1_accuracy"), one("topk_hit", "topk_accuracy"), one("reciprocal_rank", "mrr"))


@query("""WITH r AS (SELECT doc_id // 5 AS row, sum((quality > 0)::int)::double AS relevant FROM labels GROUP BY 1), t AS (SELECT avg(relevant) AS a, count(*) AS n FROM r
), p AS (SELECT relevant AS p95 FROM (SELECT relevant, row_number() OVER (ORDER BY relevant) - 1 AS nth FROM r), t WHERE nth = ceil(0.95::double * (n - 1)))
SELECT 'binary' AS label_kind, round(a, 6) AS avg_relevant, p95 AS p95_relevant, CASE WHEN p95 <= 1 OR a < 1.2 THEN 'mrr' ELSE 'ndcg' END AS recommended_metric, 10 AS recommended_k FROM t, p""")
def metric_profile(spark: SparkSession, sf: str) -> DataFrame:
    labels = T.table(spark, sf, "labels").select(F.expr("doc_id div 5").alias("row"), F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("label"))
    return evaluation.profile(labels)


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN nth = ceil(0.95::double * (n - 1)) THEN value END) AS p95_ceil, quantile_disc(value, 0.95) AS p95_nearest, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM n GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select("event_type", "value")
    found = evaluation.ceil_percentile(e, "event_type", "value", 0.95, "p95_ceil").join(evaluation.nearest_rank(e, "event_type", "value", 0.95, "p95_nearest"), "event_type")
    for p in (0.1, 0.5, 0.9):
        name = f"p{int(p * 100)}"
        found = found.join(evaluation.interpolated(e, "event_type", "value", p, name).withColumn(name, F.round(name, 6)), "event_type")  # a row a type
    return found


@query("""SELECT user_id, round(stddev_pop(value), 6) AS tail_stddev, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY user_id""")
def tail_stddev(spark: SparkSession, sf: str) -> DataFrame:
    last = stats.tail(T.table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", 5)
    return last.groupBy("user_id").agg(F.round(F.stddev_pop("value"), 6).alias("tail_stddev"), F.count("*").alias("n"))


@query("SELECT user_id, max(value) AS best, min(event_id) FILTER (WHERE value = top) AS first_at FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events) GROUP BY user_id")
def best_and_time_to_best(spark: SparkSession, sf: str) -> DataFrame:
    return stats.best_and_when(T.table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("""WITH a AS (SELECT item_id AS ordinal, 1 / (1 + item_id % 3)::double AS o, 1 / (1 + item_id % 4)::double AS n FROM benchmark)
SELECT ordinal, round(o, 6) AS old, round(n, 6) AS new, round(n - o, 6) AS delta, CASE WHEN n > o THEN 'improved' WHEN n < o THEN 'regressed' ELSE 'same' END AS change FROM a""")
def run_diff(spark: SparkSession, sf: str) -> DataFrame:
    run = lambda k: T.table(spark, sf, "benchmark").select(F.col("item_id").alias("ordinal"), (F.lit(1.0) / (1 + F.col("item_id") % k)).alias("reciprocal_rank"))
    found = evaluation.compare_runs(run(3), run(4))
    return found.select("ordinal", *[F.round(c, 6).alias(c) for c in ("old", "new", "delta")], "change")


@query("""WITH a AS (SELECT p_brand AS key, max(p_type) AS value FROM part WHERE p_size < 25 GROUP BY 1), b AS (SELECT p_brand AS key, max(p_type) AS value FROM part WHERE p_size > 2 AND p_brand <> 'Brand#1' GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, a.value AS old, b.value AS new, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def config_diff(spark: SparkSession, sf: str) -> DataFrame:
    p = T.table(spark, sf, "part")
    side = lambda where: p.where(where).groupBy(F.col("p_brand").alias("key")).agg(F.max("p_type").alias("value"))
    return evaluation.compare_maps(side("p_size < 25"), side("p_size > 2 and p_brand <> 'Brand#1'"))


EDGES = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query("""WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS w, CASE WHEN value <= 1 THEN 1 WHEN value <= 5 THEN 5 WHEN value <= 10 THEN 10 WHEN value <= 25 THEN 25 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 ELSE 250 END::double AS upper, count(*) AS n FROM events GROUP BY ALL
), c AS (SELECT *, sum(n) OVER x AS below, coalesce(lag(upper) OVER x, 0) AS lower, sum(n) OVER (PARTITION BY w) AS total FROM b WINDOW x AS (PARTITION BY w ORDER BY upper))
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, round(lower + (upper - lower) * (0.95::double * total - (below - n)) / n, 6) AS p95 FROM c WHERE below >= 0.95::double * total AND below - n < 0.95::double * total""")
def histogram_quantile_5m(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    buckets = e.groupBy(F.window("ts", "5 minutes")["start"].alias("w"), stats.bucket_upper(F.col("value"), EDGES).alias("upper")).agg(F.count("*").alias("n"))
    found = stats.quantile_from_buckets(buckets, ["w"], 0.95)
    return found.select(F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.round("quantile", 6).alias("p95"))


@query(f"""WITH e AS (SELECT user_id % 5 AS instance, time_bucket(INTERVAL 1 MINUTE, ts) AS m, floor((epoch(ts) + 3600 * (user_id % 5)) / 21600)::bigint AS life, value FROM events
), counted AS (SELECT instance, m, life, le, sum((value <= le OR le = 250)::int) AS n FROM e, (SELECT unnest({EDGES}::double[]) AS le) GROUP BY ALL
), samples AS (SELECT instance, le, m, sum(n) OVER (PARTITION BY instance, le, life ORDER BY m) AS v FROM counted
), gains AS (SELECT m, le, CASE WHEN lag(v) OVER x IS NULL THEN 0 WHEN v >= lag(v) OVER x THEN v - lag(v) OVER x ELSE v END AS d FROM samples WINDOW x AS (PARTITION BY instance, le ORDER BY m)
), gained AS (SELECT time_bucket(INTERVAL 1 HOUR, m) AS w, le AS upper, sum(d) AS upto FROM gains GROUP BY ALL
), b AS (SELECT w, upper, upto - coalesce(lag(upto) OVER (PARTITION BY w ORDER BY upper), 0) AS n FROM gained
), c AS (SELECT *, sum(n) OVER x AS below, coalesce(lag(upper) OVER x, 0) AS lower, sum(n) OVER (PARTITION BY w) AS total FROM b WINDOW x AS (PARTITION BY w ORDER BY upper))
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, round(lower + (upper - lower) * (0.95::double * total - (below - n)) / n, 6) AS p95 FROM c WHERE below >= 0.95::double * total AND below - n < 0.95::double * total""")
def histogram_quantile_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of five instances that start again every six hours, sampled in the minutes in which they moved."""
    e = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("instance", F.col("user_id") % 5)
    e = e.withColumn("m", F.date_trunc("minute", "ts")).withColumn("life", F.floor((F.unix_timestamp("m") + 3600 * F.col("instance")) / 21600))
    under = lambda edge: F.sum(((F.col("value") <= edge) | F.lit(edge == EDGES[-1])).cast("int"))
    counted = e.groupBy("instance", "m", "life").agg(F.array(*[F.struct(F.lit(x).alias("le"), under(x).alias("n")) for x in EDGES]).alias("b")).select("instance", "m", "life", F.inline("b"))
    samples = counted.withColumn("v", F.sum("n").over(Window.partitionBy("instance", "le", "life").orderBy("m")))
    found = stats.histogram_quantile(samples, ["instance"], "le", "m", "v", "1 hour", 0.95)
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.round("quantile", 6).alias("p95"))


@query("SELECT user_id, round(1 - sum((event_type = 'error')::int) / greatest(count(*), 1)::double, 6) AS success FROM events GROUP BY user_id")
def success_ratio(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events")
    ratio = stats.success_ratio(F.sum((F.col("event_type") == "error").cast("int")), F.count("*"))
    return e.groupBy("user_id").agg(F.round(ratio, 6).alias("success"))


@query("""WITH p AS (SELECT o_totalprice AS a, lead(o_totalprice) OVER (ORDER BY o_orderkey) AS b FROM orders), r AS (SELECT *, CASE WHEN a > b THEN 1 WHEN a < b THEN 2 ELSE 1.5 END::double AS rank FROM p WHERE b IS NOT NULL)
SELECT count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg(1 / log2(rank + 1)), 6) AS ndcg, round(avg(1 / rank), 6) AS map, round(avg((a > b)::int), 6) AS accuracy FROM r""")
def pairwise_proxy_metrics(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    after = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_totalprice").alias("negative"))
    found = evaluation.pairwise_proxy(o.withColumnRenamed("o_totalprice", "positive").join(after, "o_orderkey"))
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "map", "accuracy")])


# Mining: an event is feedback on the search of the event before it; a search lists five files.

LOG_SQL = """logged AS (
  SELECT event_id - event_id % 5 AS event_id, event_id AS ts, CASE WHEN event_id % 5 = 0 THEN 'search' ELSE 'feedback' END AS kind, 'q' || (k % 20) AS query, CASE WHEN k % 2 = 0 THEN 'en' ELSE 'fr' END AS corpus_id,
         list_transform(range(0, 5), lambda i: 'f' || ((k + i * 3) % 50)) AS top_paths, CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'thumbsup' WHEN 'error' THEN 'thumbsdown' ELSE 'note' END AS signal,
         CASE WHEN event_type = 'click' THEN 'f' || (k % 50) END AS doc_id
  FROM (SELECT *, json_extract_string(props, '$.k')::int AS k FROM events))"""


def logged(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = T.table(spark, sf, "events").withColumn("k", k)
    path = lambda n: F.concat(F.lit("f"), (n % 50).cast("string"))
    signal = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "purchase", "thumbsup").when(F.col("event_type") == "error", "thumbsdown").otherwise("note")
    return e.select(
        (F.col("event_id") - F.col("event_id") % 5).alias("event_id"), F.col("event_id").alias("ts"), F.when(F.col("event_id") % 5 == 0, "search").otherwise("feedback").alias("kind"),
        F.concat(F.lit("q"), (F.col("k") % 20).cast("string")).alias("query"), F.when(F.col("k") % 2 == 0, "en").otherwise("fr").alias("corpus_id"),
        F.array(*[path(F.col("k") + i * 3) for i in range(5)]).alias("top_paths"), signal.alias("signal"), F.when(F.col("event_type") == "click", path(F.col("k"))).alias("doc_id"),
    )


TRIPLETS_SQL = f"""{LOG_SQL}, asked AS (SELECT event_id, query, corpus_id, top_paths FROM logged WHERE kind = 'search'
), chosen AS (SELECT a.query, a.top_paths, f.ts, CASE WHEN f.signal = 'click' AND f.doc_id IS NOT NULL THEN f.doc_id ELSE a.top_paths[1] END AS positive FROM logged f JOIN asked a USING (event_id) WHERE f.kind = 'feedback' AND f.signal IN ('thumbsup', 'click') AND a.corpus_id = 'en'
), triplets AS (SELECT query, positive, negative, min(ts) AS first_ts FROM (SELECT *, list_filter(top_paths, lambda p: p <> positive)[1] AS negative FROM chosen) WHERE negative IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {TRIPLETS_SQL} SELECT * FROM triplets")
def mine_triplets(spark: SparkSession, sf: str) -> DataFrame:
    return mining.triplets(logged(spark, sf), "en")


@query(f"WITH {TRIPLETS_SQL}, t AS (SELECT *, query || '/' || positive || '/' || negative AS key FROM triplets), n AS (SELECT *, row_number() OVER (ORDER BY md5(key), key) AS r, count(*) OVER () AS n FROM t) SELECT key, CASE WHEN r <= greatest(floor(n * 0.1::double), (n >= 10)::int) THEN 'dev' ELSE 'train' END AS split FROM n")
def dev_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = mining.triplets(logged(spark, sf), "en").select(F.concat_ws("/", "query", "positive", "negative").alias("key"))
    return mining.dev_split(rows, "key")


@query(f"""WITH {T.FILES_SQL}, ring AS (SELECT file_path AS negative, row_number() OVER (ORDER BY md5(file_path), file_path) - 1 AS place, count(*) OVER () AS total FROM files
), pos AS (SELECT doc_id AS query_id, file_path AS positive, ('0x' || substr(md5(doc_id || '|' || file_path), 1, 8))::bigint AS spot FROM files WHERE doc_id % 100 = 0
), steps AS (SELECT query_id, positive, spot, unnest(range(0, 6)) AS step FROM pos
), drawn AS (SELECT s.query_id, s.positive, r.negative, row_number() OVER (PARTITION BY s.query_id, s.positive ORDER BY s.step) AS nth FROM steps s JOIN ring r ON (s.spot + s.step) % r.total = r.place WHERE r.negative <> s.positive)
SELECT query_id, positive, negative, nth::int AS nth FROM drawn WHERE nth <= 5""")
def negative_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """Five negatives out of all files for every hundredth file."""
    files = T.files(spark, sf)
    positives = files.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("file_path").alias("positive"))
    return mining.negatives(positives, files.select(F.col("file_path").alias("path")))


@query("""WITH searched AS (SELECT event_id AS ts, 'q' || (k % 20) AS query, CASE WHEN event_type = 'click' THEN 'f' || ((k + 3 * (k % 3)) % 50) END AS clicked, list_transform(range(0, 7), lambda i: 'f' || ((k + i * 3) % 50)) AS results
  FROM (SELECT *, json_extract_string(props, '$.k')::int AS k FROM events))
SELECT query, clicked AS positive, array_to_string(list_filter(results[1:5], lambda c: c <> clicked), ',') AS negatives, ts FROM searched WHERE clicked IS NOT NULL""")
def click_log_seeds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    name = lambda n: F.concat(F.lit("f"), (n % 50).cast("string"))
    e = T.table(spark, sf, "events").select(F.col("event_id").alias("ts"), "event_type", k.alias("k"))
    log = e.select("ts", F.concat(F.lit("q"), (F.col("k") % 20).cast("string")).alias("query"), F.when(F.col("event_type") == "click", name(F.col("k") + 3 * (F.col("k") % 3))).alias("clicked_chunk"), F.array(*[name(F.col("k") + 3 * i) for i in range(7)]).alias("results"))
    return mining.click_seeds(log).withColumn("negatives", F.array_join("negatives", ","))


@query(f"WITH {TRIPLETS_SQL} SELECT 'log' AS name, count(*) AS n FROM logged UNION ALL SELECT 'triplets', count(*) FROM triplets")
def log_and_triplet_counts(spark: SparkSession, sf: str) -> DataFrame:
    log = logged(spark, sf)
    return mining.counts(log=log, triplets=mining.triplets(log, "en"))


@query(f"WITH {TRIPLETS_SQL.replace("a.corpus_id = 'en'", "a.corpus_id IN ('en', 'fr')")} SELECT * FROM triplets")
def mine_triplets_of_corpora(spark: SparkSession, sf: str) -> DataFrame:
    return mining.triplets(logged(spark, sf), ["en", "fr"])


@query(f"""WITH {T.FILES_SQL}, made AS (SELECT md5(file_path) AS entry_id, 'How does ' || doc_id || ' work?' AS question, file_path AS expected_path, 'md' AS tag FROM files)
SELECT * FROM made ORDER BY entry_id LIMIT 20""")
def eval_dataset(spark: SparkSession, sf: str) -> DataFrame:
    made = evaluation.dataset_of(T.files(spark, sf), 20, ("md",))
    return made.select("entry_id", "question", F.col("expected_paths")[0].alias("expected_path"), F.col("tags")[0].alias("tag"))


@query(f"WITH {EVAL_SQL} SELECT query_id, round(reciprocal_rank, 6) AS reciprocal_rank FROM metrics ORDER BY query_id LIMIT 15")
def eval_first_entries(spark: SparkSession, sf: str) -> DataFrame:
    """An evaluation of the first fifteen entries, each to the depth that all metrics need."""
    entries = evaluation.first_entries(metrics(spark, sf).withColumn("ordinal", F.col("query_id")), 15)
    return entries.select("query_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query("""WITH runs AS (SELECT event_type AS run, 'mrr' AS metric, CASE event_type WHEN 'error' THEN 5 ELSE 10 END AS k, max(value) AS best, min(event_id)::double AS time_to_best, CASE WHEN event_type <> 'view' THEN stddev_pop(value) END AS stddev FROM events GROUP BY event_type
), pairs AS (SELECT * FROM (VALUES ('click', 'purchase'), ('click', 'view'), ('click', 'error')) v(a, b))
SELECT p.b AS run, a.k = b.k AS compatible, CASE WHEN a.k <> b.k THEN 'Incompatible runs: primary_metric/primary_k differ (baseline=mrr@' || a.k || ', current=mrr@' || b.k || ')' END AS reason,
  round(CASE WHEN a.k = b.k THEN b.best - a.best END, 6) AS delta_best, round(CASE WHEN a.k = b.k THEN b.time_to_best - a.time_to_best END, 6) AS delta_time_to_best, round(CASE WHEN a.k = b.k THEN b.stddev - a.stddev END, 6) AS delta_stddev
FROM pairs p JOIN runs a ON a.run = p.a JOIN runs b ON b.run = p.b""")
def run_diff_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Runs side by side, one of them without a standard deviation, one measured at another k."""
    e = T.table(spark, sf, "events")
    runs = e.groupBy(F.col("event_type").alias("run")).agg(F.max("value").alias("best"), F.min("event_id").cast("double").alias("time_to_best"), F.stddev_pop("value").alias("stddev"))
    runs = runs.withColumn("metric", F.lit("mrr")).withColumn("k", F.when(F.col("run") == "error", 5).otherwise(10)).withColumn("stddev", F.when(F.col("run") != "view", F.col("stddev")))
    parts = [evaluation.diff_runs(runs.where("run = 'click'"), runs.where(F.col("run") == b)).withColumn("run", F.lit(b)) for b in ("purchase", "view", "error")]
    found = parts[0].union(parts[1]).union(parts[2])
    return found.select("run", "compatible", "reason", *[F.round(c, 6).alias(c) for c in ("delta_best", "delta_time_to_best", "delta_stddev")])


@query(f"""WITH {search.TOP_CHUNKS_SQL}, judged AS (SELECT query_id, chunk_id AS path, rank <= 3 AS relevant FROM top_chunks WHERE rank <= 10)
SELECT p.query_id, p.path AS positive, n.path AS negative FROM judged p JOIN judged n USING (query_id) WHERE p.relevant AND NOT n.relevant""")
def eval_triplets_cross(spark: SparkSession, sf: str) -> DataFrame:
    hits = staged(search.top_chunks(spark, sf, 10), "hits")
    return mining.cross_triplets(hits.select("query_id", F.col("chunk_id").alias("path"), (F.col("rank") <= 3).alias("relevant")))


@query("""WITH m AS (SELECT conv_id, turn, role, trim(text) AS content FROM conversations WHERE role IN ('system', 'user', 'assistant') AND trim(text) <> '')
SELECT conv_id, count(*)::int AS n_messages, sum((role = 'assistant')::int)::int AS n_targets, md5(string_agg(role || ':' || content, chr(10) ORDER BY turn)) AS transcript_md5 FROM m GROUP BY conv_id HAVING sum((role = 'assistant')::int) > 0""")
def sft_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    found = mining.transcripts(T.table(spark, sf, "conversations"))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return found.select("conv_id", F.size("messages").alias("n_messages"), F.size(F.filter("messages", lambda m: m["is_target"])).alias("n_targets"), F.md5(text).alias("transcript_md5"))


@query("""WITH b AS (SELECT user_id, quantile_cont(value, 0.1) AS low, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.9) AS high FROM events GROUP BY user_id
), s AS (SELECT e.user_id, e.event_id, CASE WHEN mid <> 0 THEN least(greatest(value, low), high) / mid ELSE least(greatest(value, low), high) END AS scaled FROM events e JOIN b USING (user_id))
SELECT user_id, event_id, round(scaled, 6) AS scaled, round(scaled - lag(scaled) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM s""")
def telemetry_deltas(spark: SparkSession, sf: str) -> DataFrame:
    found = mining.clipped_deltas(T.table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id")
    return found.select("user_id", "event_id", F.round("scaled", 6).alias("scaled"), F.round("delta", 6).alias("delta"))


# Recall gate

MESSAGES = ["hi", "thanks a lot!", "lol", "how does chunking work?", "you mentioned a better approach", "the bug", "why is it slow?", "fix it", "we decided on a plan last week", "please write a long summary of all the files in this corpus"]
SAID_SQL = "said AS (SELECT conv_id, turn, trim(text) AS m FROM conversations WHERE text IS NOT NULL UNION ALL SELECT -1 - i, 3, list_extract([" + ", ".join("'" + m + "'" for m in MESSAGES) + "], i + 1) FROM range(0, 10) t(i))"
TOP_K_SQL = "CASE intensity WHEN 'light' THEN 3 WHEN 'standard' THEN 5 WHEN 'deep' THEN 10 ELSE 0 END AS top_k"


def said_messages(spark: SparkSession, sf: str) -> DataFrame:
    said = T.table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.col("text").alias("message"))
    made = spark.range(1).select(F.posexplode(F.array(*[F.lit(m) for m in MESSAGES])).alias("i", "message")).select((-1 - F.col("i")).cast("long").alias("conv_id"), F.lit(3).cast("long").alias("turn"), "message")
    return said.union(made)


@query(f"WITH {SAID_SQL}, g AS (SELECT conv_id, turn, {recall.intensity_sql('m', 'turn')} AS intensity FROM said) SELECT conv_id, turn, intensity, {TOP_K_SQL} FROM g")
def recall_gate(spark: SparkSession, sf: str) -> DataFrame:
    return recall.gate(said_messages(spark, sf)).select("conv_id", "turn", "intensity", F.coalesce("top_k", F.lit(0)).alias("top_k"))


@query(f"""WITH {SAID_SQL}, asked AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'Deep ' WHEN 1 THEN 'skip' WHEN 2 THEN 'whatever' END AS o FROM said
), g AS (SELECT conv_id, turn, CASE WHEN lower(trim(o)) IN ('skip', 'light', 'standard', 'deep') THEN lower(trim(o)) ELSE {recall.intensity_sql('m', 'turn')} END AS intensity, CASE WHEN lower(trim(o)) IN ('skip', 'light', 'standard', 'deep') THEN 'user' ELSE 'rules' END AS decided_by FROM asked)
SELECT conv_id, turn, 'on' AS gate, intensity, decided_by, {TOP_K_SQL} FROM g UNION ALL SELECT conv_id, turn, 'off', 'standard', 'gate off', 5 FROM said""")
def recall_gate_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """With what users ask for, some of it unknown, and with the gate off."""
    turn = F.col("turn") % 4
    asked = said_messages(spark, sf).withColumn("override", F.when(turn == 0, "Deep ").when(turn == 1, "skip").when(turn == 2, "whatever"))
    shown = lambda config, name: recall.gate(asked, config).select("conv_id", "turn", F.lit(name).alias("gate"), "intensity", "decided_by", F.coalesce("top_k", F.lit(0)).alias("top_k"))
    return shown(RecallConfig(), "on").union(shown(RecallConfig(enabled=False), "off"))


# Statistics


@query(f"WITH {T.CHUNKS_SQL} SELECT corpus_id, count(*) AS total_chunks, sum(token_count)::bigint AS total_tokens, count(DISTINCT file_path) AS total_files FROM chunks GROUP BY corpus_id")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.index_stats(T.chunks(spark, sf))


@query(f"WITH {T.CHUNKS_SQL} SELECT lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) || '/' || corpus_id AS kind, count(*) AS n_chunks, round(avg(token_count), 6) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, count(DISTINCT file_path) AS n_files FROM chunks GROUP BY 1")
def index_analysis(spark: SparkSession, sf: str) -> DataFrame:
    by = F.concat_ws("/", stats.extension(F.col("file_path")), "corpus_id")
    return stats.index_analysis(T.chunks(spark, sf), by, "kind").withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(f"WITH {T.CHUNKS_SQL}, s AS (SELECT corpus_id, sum(strlen(content))::bigint AS text_bytes, count(*) FILTER (WHERE token_count > 0) AS indexed_chunks FROM chunks GROUP BY corpus_id) SELECT *, round(text_bytes / sum(text_bytes) OVER (), 6) AS share FROM s")
def storage_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return stats.storage(T.chunks(spark, sf)).withColumn("share", F.round("share", 6))


@query(f"WITH {T.FILES_SQL} SELECT corpus_id, count(*) AS n_files, sum(strlen(content))::bigint AS bytes FROM files GROUP BY corpus_id")
def lang_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return T.files(spark, sf).groupBy("corpus_id").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).alias("bytes"))


@query(f"""WITH {T.FILES_SQL}, r AS (SELECT corpus_id, sum(strlen(content))::double AS raw FROM files GROUP BY corpus_id), v AS (SELECT *, ceil(raw / 4096) AS n, ceil(raw / 4096) * 512 * 2 AS e FROM r)
SELECT corpus_id, n::bigint AS chunks, e AS vectors, e * 1.5::double AS vector_index, round(raw * 0.2::double, 3) AS keyword_index, round(e + e * 1.5::double + raw + raw * 0.1::double + e * 0.5::double + raw * 0.2::double, 3) AS single,
  round(3 * (e + e * 1.5::double + raw + raw * 0.1::double + e * 0.5::double) + raw * 0.2::double, 3) AS replicated FROM v""")
def storage_plan(spark: SparkSession, sf: str) -> DataFrame:
    raw = T.files(spark, sf).groupBy("corpus_id").agg(F.sum(F.octet_length("content")).alias("raw_bytes"))
    found = stats.storage_plan(raw, 512, "float16")
    return found.select("corpus_id", "chunks", "vectors", "vector_index", *[F.round(c, 3).alias(c) for c in ("keyword_index", "single", "replicated")])


@query(f"""WITH {T.CHUNKS_SQL} SELECT chunk_id FROM chunks WHERE NOT (list_contains(string_split(lower(file_path), '/'), 'src3') OR list_contains(string_split(lower(file_path), '/'), 'fr')
  OR regexp_matches(file_path, '^.*7\\.md$') OR contains(lower(content), 'license'))""")
def summary_filters(spark: SparkSession, sf: str) -> DataFrame:
    chunks = T.chunks(spark, sf)
    return chunks.where(~S.excluded(F.col("file_path"), F.col("content"), ["SRC3", "/fr/"], ["*7.md"], ["License "])).select("chunk_id")


@query(f"""WITH {T.CHUNKS_SQL}, one AS (SELECT min(file_path) AS path FROM chunks WHERE chunk_ordinal = 5)
SELECT chunk_id, chunk_ordinal AS ordinal FROM chunks, one WHERE file_path = path AND chunk_ordinal IN (0, 2, 5)""")
def chunks_by_json_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """Three chunks of one file by the ordinal in their metadata, one in ten of which is empty or missing elsewhere."""
    chunks = T.chunks(spark, sf)
    path = chunks.where("chunk_ordinal = 5").agg(F.min("file_path")).first()[0]
    blank = F.when(F.col("file_path") != path, F.when(F.col("chunk_ordinal") % 10 == 0, F.lit("{}")).when(F.col("chunk_ordinal") % 10 == 1, F.lit('{"chunk_ordinal": ""}')))
    named = chunks.withColumn("metadata", F.coalesce(blank, F.to_json(F.struct("chunk_ordinal", "char_start"))))
    return S.with_ordinals(named, path, [0, 2, 5]).select("chunk_id", "ordinal")


@query(f"WITH {T.CHUNKS_SQL} SELECT corpus_id, count(DISTINCT file_path) AS n_files, count(*) AS n_chunks FROM chunks GROUP BY corpus_id")
def list_corpora(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(T.index(spark, sf), T.chunks(spark, sf)).list_corpora()


@query(f"""WITH {T.GRAPH_SQL} SELECT e.entity_type, r.relation_type, count(*) AS n FROM entities e JOIN relationships r ON r.target_id = e.entity_id GROUP BY ALL""")
def adhoc_graph_query(spark: SparkSession, sf: str) -> DataFrame:
    """A query of the caller's own over views of the graph."""
    Engine(T.index(spark, sf), T.chunks(spark, sf), entities=T.entities(spark, sf), relationships=T.relationships(spark, sf)).register_views()
    return spark.sql("SELECT e.entity_type, r.relation_type, count(*) AS n FROM corpus_entities e JOIN corpus_relationships r ON r.target_id = e.entity_id GROUP BY e.entity_type, r.relation_type")


@query(search.fused_sql("1 / (60::double + rank)", 10).replace("FROM ranked GROUP", "FROM (SELECT query_id, corpus_id, chunk_id, 1 AS list, row_number() OVER (PARTITION BY query_id, corpus_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm25 QUALIFY rank <= 50) GROUP"))
def engine_search(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword search of all passages through the engine's entry point."""
    return Engine(T.index(spark, sf), T.chunks(spark, sf)).search(T.questions(spark, sf), mode="sparse")


EMBED = EmbeddingConfig(dim=16, prefix="passage: ", max_tokens=40, hard_max_tokens=64)


@query(f"""WITH {T.FILES_SQL}, w AS (SELECT file_path, 'passage: ' || content AS t, regexp_extract_all('passage: ' || content, '[^ \t\n\r]+[ \t\n\r]*') AS ws FROM files)
SELECT file_path, md5(CASE WHEN len(ws) <= 40 THEN t ELSE array_to_string(ws[1:40], '') END) AS prepared_md5 FROM w""")
def embed_prepare(spark: SparkSession, sf: str) -> DataFrame:
    """All texts between a prefix and the model's limit of forty words. The SQL knows neither Unicode's white space nor
    its compatibility forms; these are held against brute force in the tests."""
    return embedding.prepare(T.files(spark, sf), "content", EMBED).select("file_path", F.md5("prepared").alias("prepared_md5"))


@query()
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.embed(T.files(spark, sf), "file_path", "content", config=EMBED).select("file_path", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query()
def late_chunking(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.late_chunks(T.files(spark, sf), config=EmbeddingConfig(dim=16)).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6)))


@query("""WITH t AS (SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::bigint AS x, strlen(text) AS bytes, floor(strlen(text) / 4)::bigint AS tokens FROM documents WHERE text IS NOT NULL)
SELECT doc_id, tokens, ceil(tokens / 448)::bigint AS chunks, (tokens / 120000::double + 12) * 0.6::double AS seconds_low, (tokens / 120000::double + 12) * 1.9::double AS seconds_high FROM t""")
def index_estimate(spark: SparkSession, sf: str) -> DataFrame:
    d = T.table(spark, sf, "documents").where("text is not null")
    e = stats.estimate(F.octet_length("text"))
    return d.select("doc_id", e["tokens"].alias("tokens"), e["chunks"].alias("chunks"), e["seconds_low"].alias("seconds_low"), e["seconds_high"].alias("seconds_high"))


CATALOG = [("acme", "large", 0, 0.005, 0.015, 0.0001, None, None), ("acme", "small", 1, 0.001, 0.002, None, 0.002, None), ("zeta", "large", 2, 0.01, 0.03, None, None, 0.001), ("zeta", "bare", 3, None, None, None, None, None)]
CATALOG_COLUMNS = "provider string, model string, position int, input_per_1k double, output_per_1k double, embed_per_1k double, per_request double, rerank_per_1k double"
CATALOG_SQL = "catalog AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL::double" if v is None else f"{v}::double" if isinstance(v, float) else repr(v) for v in r) + ")" for r in CATALOG) + ") v(provider, model, position, input_per_1k, output_per_1k, embed_per_1k, per_request, rerank_per_1k))"


@query(f"""WITH {CATALOG_SQL}, r AS (SELECT o_orderkey AS request_id, list_extract(['Acme', 'zeta', 'acme ', 'nobody'], (o_orderkey % 4 + 1)::int) AS provider, list_extract(['large', 'small', 'bare', 'gone', 'huge'], (o_orderkey % 5 + 1)::int) AS model,
  (o_custkey % 3000)::int AS tokens_in, (o_custkey % 700)::int AS tokens_out, (o_custkey % 4)::int AS embeds, (o_custkey % 3)::int AS reranks, 100 AS per_day FROM orders
), met AS (SELECT r.*, c.* EXCLUDE (provider, model), CASE WHEN lower(trim(r.provider)) = c.provider AND r.model = c.model THEN 0 WHEN r.model = c.model THEN 1 WHEN lower(trim(r.provider)) = c.provider THEN 2 END AS level FROM r LEFT JOIN catalog c ON lower(trim(r.provider)) = c.provider OR r.model = c.model
), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY level NULLS LAST, position) AS nth FROM met) WHERE nth = 1
), priced AS (SELECT *, round(CASE WHEN level IS NULL THEN 0 ELSE round(tokens_in / 1000::double * coalesce(input_per_1k, 0) + tokens_out / 1000::double * coalesce(output_per_1k, 0), 6) + round(embeds * 1000 / 1000::double * coalesce(embed_per_1k, 0), 6)
   + round(CASE WHEN per_request IS NOT NULL THEN reranks * per_request ELSE reranks * 500 / 1000::double * coalesce(rerank_per_1k, 0) END, 6) END, 6) AS each_usd FROM one
), powered AS (SELECT *, CASE WHEN request_id % 3 > 0 THEN 0.25::double END AS kwh_rate, CASE WHEN request_id % 3 = 2 THEN 150::double END AS watts, CASE WHEN request_id % 3 = 2 THEN (request_id % 24)::double END AS hours FROM priced
), summed AS (SELECT *, coalesce(watts / 1000 * hours * kwh_rate, 0) AS power, (kwh_rate IS NOT NULL OR watts IS NOT NULL OR hours IS NOT NULL) AND (kwh_rate IS NULL OR watts IS NULL OR hours IS NULL) AS partly FROM powered)
SELECT request_id, each_usd AS per_request_usd, round(power, 6) AS electricity_usd, round(each_usd * per_day + power, 6) AS daily_usd, round(round(each_usd * per_day + power, 6) * 30, 6) AS monthly_usd,
  concat_ws('; ', CASE WHEN level IS NULL THEN 'Unknown model: ' || provider || '/' || model WHEN input_per_1k IS NULL AND output_per_1k IS NULL AND tokens_in + tokens_out > 0 THEN 'Missing price: ' || provider || '/' || model END,
    CASE WHEN partly THEN 'Electricity needs kwh_rate, watts and hours_per_day' END) AS error FROM summed""")
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % k + 1).cast("int"))
    part = lambda k: (F.col("o_custkey") % k).cast("int")
    requests = o.select(F.col("o_orderkey").alias("request_id"), pick(["Acme", "zeta", "acme ", "nobody"], 4).alias("provider"), pick(["large", "small", "bare", "gone", "huge"], 5).alias("model"), part(3000).alias("tokens_in"), part(700).alias("tokens_out"), part(4).alias("embeds"), part(3).alias("reranks"), F.lit(100).alias("per_day"))
    third, key = F.col("request_id") % 3, F.col("request_id")
    requests = requests.withColumns({"kwh_rate": F.when(third > 0, 0.25), "watts": F.when(third == 2, 150.0), "hours_per_day": F.when(third == 2, (key % 24).cast("double"))})
    return stats.cost(requests, spark.createDataFrame(CATALOG, CATALOG_COLUMNS))


@query("""WITH catalog AS (SELECT p_brand AS provider, p_name || '-' || p_partkey AS model, list_filter(['EMB', 'GEN', 'RERANK'], lambda c, i: p_size % (i + 1) = 0) AS components FROM part)
SELECT component, provider, count(*) AS n_models, min(model) AS first_model FROM (SELECT provider, model, unnest(components) AS component FROM catalog) GROUP BY ALL""")
def models_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Models of every component in a catalogue made from the parts."""
    size = F.col("p_size")
    components = F.array_compact(F.array(*[F.when(size % (i + 2) == 0, F.lit(c)) for i, c in enumerate(stats.COMPONENTS)]))
    catalog = T.table(spark, sf, "part").select(F.col("p_brand").alias("provider"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("model"), components.alias("components"))
    found = [stats.models_for(catalog, c.lower()).withColumn("component", F.lit(c)) for c in stats.COMPONENTS]
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("component", "provider").agg(F.count("*").alias("n_models"), F.min("model").alias("first_model"))


SUMMARY_SQL = r"""found AS (
  SELECT chunk_id, file_path, regexp_extract(content, '(def|class)\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS kind, regexp_extract(content, '(def|class)\s+([A-Za-z_][A-Za-z0-9_]*)', 2) AS name,
         list_filter(list_transform(string_split(content, chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT starts_with(l, '#'))[1] AS line, regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]{2,63}') AS ids FROM chunks
), named AS (SELECT chunk_id, CASE WHEN name <> '' THEN 'Defines ' || kind || ' ' || name || '.' ELSE line END AS purpose, list_filter(ids, lambda v, i: list_position(ids, v) = i)[1:5] AS symbols FROM found)"""


@query(f"WITH {T.CHUNKS_SQL}, {SUMMARY_SQL} SELECT chunk_id, CASE WHEN length(purpose) > 240 THEN rtrim(substr(purpose, 1, 239)) || '…' ELSE purpose END AS purpose, array_to_string(symbols, ',') AS symbols FROM named")
def chunk_summaries(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    defines = r"(def|class)\s+([A-Za-z_][A-Za-z0-9_]*)"
    name = F.regexp_extract(c, defines, 2)
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    purpose = F.when(name != "", F.concat(F.lit("Defines "), F.regexp_extract(c, defines, 1), F.lit(" "), name, F.lit("."))).otherwise(F.get(lines, F.lit(0)))
    symbols = F.slice(F.array_distinct(find_all(c, r"[A-Za-z_][A-Za-z0-9_]{2,63}")), 1, 5)
    short = F.when(F.length("purpose") > 240, F.concat(F.rtrim(F.substring("purpose", 1, 239)), F.lit("…"))).otherwise(F.col("purpose"))
    return T.chunks(spark, sf).select("chunk_id", purpose.alias("purpose"), F.array_join(symbols, ",").alias("symbols")).withColumn("purpose", short)


# Sinks and sources


@query("""WITH old AS (SELECT doc_id, md5(text) AS content FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, md5(text || '!') AS content FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""")
def upsert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = T.table(spark, sf, "documents")
    old = d.where("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("content"))
    new = d.where("doc_id % 2 = 0").select("doc_id", F.md5(F.concat("text", F.lit("!"))).alias("content"))
    return S.upsert(old, new, ["doc_id"])


@query("SELECT user_id, event_id, from_end::int AS from_end FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS from_end FROM events) WHERE from_end <= 50")
def trace_ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return stats.retained(T.table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 50)


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tail(T.table(spark, sf, "events").select("event_type", "event_id", "value"), "event_type", "event_id", 20).drop("from_end")


@query("""WITH r AS (SELECT p_partkey AS row, concat_ws(chr(10), '--- row ' || (p_partkey + 1) || ' ---', '[p_name]', p_name, '[p_brand]', p_brand, '[p_type]', p_type) AS t FROM part WHERE p_partkey < 5000
), s AS (SELECT *, sum(length(t)) OVER (ORDER BY row) AS upto FROM r) SELECT row, t AS text FROM s WHERE upto <= 2000000""")
def parquet_row_text(spark: SparkSession, sf: str) -> DataFrame:
    return S.rows_as_text(T.table(spark, sf, "part"), "p_partkey")


@query("SELECT sum(length(text) + 1)::bigint AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::bigint AS lines FROM documents WHERE text IS NOT NULL")
def block_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The documents written as text files and read again as blocks of bytes: no character is lost or read twice."""
    path = f"{shared_dir(spark)}/siltstone-texts/{uuid.uuid4().hex}"
    T.table(spark, sf, "documents").where("text is not null").select("text").write.text(path)
    blocks = read_blocks(spark, path, 1 << 16)
    return blocks.agg(F.sum(F.length("content")).alias("chars"), F.sum(line_ends(F.col("content"))).alias("lines"))


@query("""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS nth, list_filter([CASE WHEN trim(text) <> '' THEN '[text]' || chr(10) || CASE WHEN length(trim(text)) > 400 THEN substr(trim(text), 1, 400) || '…' ELSE trim(text) END END,
  CASE WHEN trim(lang) <> '' THEN '[lang]' || chr(10) || trim(lang) END, CASE WHEN trim(source) <> '' THEN '[source]' || chr(10) || trim(source) END], lambda c: c IS NOT NULL) AS cells FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 5000)
), p AS (SELECT nth, CASE WHEN len(cells) > 0 THEN chr(10) || chr(10) || '--- row ' || nth || ' ---' || chr(10) || chr(10) || array_to_string(cells, chr(10) || chr(10)) END AS part FROM d
), kept AS (SELECT * FROM (SELECT *, coalesce(length(part), 0) AS size, sum(coalesce(length(part), 0)) OVER (ORDER BY nth) - coalesce(length(part), 0) AS before FROM p) WHERE before < 60000
), w AS (SELECT trim(string_agg(part, chr(10) ORDER BY nth), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, count(*) AS n, sum(size) AS chars FROM kept)
SELECT CASE WHEN n >= 5000 AND length(t) < 60000 THEN t || chr(10) || chr(10) || '… (truncated by max_rows)' WHEN chars >= 60000 THEN substr(t, 1, 60000) || chr(10) || chr(10) || '… (truncated by max_chars)' ELSE t END AS text FROM w""")
def parquet_preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of the documents as one bounded text, which is what a preview is."""
    d = T.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return S.table_as_text(d, "doc_id", max_chars=60_000, max_cell=400)


@query("""WITH m AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN map(['type', 'k'], [event_type, json_extract_string(props, '$.k')]) END AS old, CASE WHEN event_id % 5 > 0 THEN map(['user', 'type'], [user_id::varchar, upper(event_type)]) END AS new FROM events
), e AS (SELECT event_id, CASE WHEN old IS NULL THEN new WHEN new IS NULL THEN old ELSE map_concat(old, new) END AS mm FROM m)
SELECT event_id, array_to_string(list_sort(list_transform(map_keys(mm), lambda k: k || '=' || coalesce(mm[k], ''))), ',') AS merged FROM e""")
def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of an event, each missing now and then, with the newer one's entries going before."""
    e, text = T.table(spark, sf, "events"), F.col("event_type")
    old = F.when(F.col("event_id") % 7 > 0, F.create_map(F.lit("type"), text, F.lit("k"), F.get_json_object("props", "$.k")))
    new = F.when(F.col("event_id") % 5 > 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.upper(text)))
    shown = F.transform(F.map_entries("both"), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit(""))))
    return e.select("event_id", stats.merged(old, new).alias("both")).select("event_id", F.array_join(F.array_sort(shown), ",").alias("merged"))


@query("SELECT n_nationkey, concat_ws(chr(9), n_nationkey::varchar, trim(n_name), n_regionkey::varchar) AS line FROM nation")
def csv_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "nation").select("n_nationkey", S.tab_line(["n_nationkey", "n_name", "n_regionkey"]).alias("line"))


@query("""WITH w AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS starts FROM events
), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM w) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, nth""")
def session_conversations(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(count(*) / 300::double, 6) AS rate FROM events GROUP BY ALL")
def rate_5m(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = e.groupBy(F.window("ts", "5 minutes")["start"].alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round(F.col("n") / F.lit(300.0), 6).alias("rate"))


@query(f"""WITH {search.TOP_CHUNKS_SQL}, found AS (SELECT t.query_id, t.chunk_id, t.rank, list_distinct(regexp_extract_all(lower(c.content), '[a-z0-9_]{{2,64}}')) AS x FROM top_chunks t JOIN chunks c USING (chunk_id) WHERE t.rank <= 10)
SELECT query_id, chunk_id, least(len(x), 64)::int AS n_words, row_number() OVER (PARTITION BY query_id ORDER BY rank)::int AS rank FROM found""")
def score_pairs_mmr_words(spark: SparkSession, sf: str) -> DataFrame:
    """Word sets that diversification compares, of the ten best chunks of a query."""
    texts = T.chunks(spark, sf).select("chunk_id", fusion.word_set(F.col("content")).alias("words"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return search.with_texts(search.top_chunks(spark, sf, 10), texts).select("query_id", "chunk_id", F.size("words").alias("n_words"), F.row_number().over(w).alias("rank"))
