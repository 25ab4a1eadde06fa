"""Training data from logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import hash_bucket, numbered

POSITIVE = ("thumbsup", "star4", "star5", "click")


def latest_queries(log: DataFrame) -> DataFrame:
    """The last query row of each event id."""
    w = Window.partitionBy("event_id").orderBy(F.desc("ts"))
    return log.where("kind in ('search', 'chat')").withColumn("nth", F.row_number().over(w)).where("nth = 1").select("event_id", "query", "corpus_id", "top_paths")


def triplets(log: DataFrame, corpus: str | list[str] | None = None, most: int | None = None) -> DataFrame:
    """(query, positive, negative) from positive feedback on logged queries (M1, M2).

    The positive is the clicked document, or else the first path; the negative the first other
    path. Equal triplets count once, the earliest feedback first.
    """
    queries = latest_queries(log)
    if corpus is not None:
        queries = queries.where(F.col("corpus_id").isin([corpus] if isinstance(corpus, str) else corpus))
    feedback = log.where((F.col("kind") == "feedback") & F.lower("signal").isin(*POSITIVE)).select("event_id", "signal", "doc_id", "ts")
    joined = feedback.join(queries, "event_id")
    clicked = (F.col("signal") == "click") & F.col("doc_id").isNotNull()  # this branch minds case, as the reference's
    positive = F.when(clicked, F.col("doc_id")).otherwise(F.get("top_paths", F.lit(0)))
    found = joined.withColumn("positive", positive)
    negative = F.get(F.filter("top_paths", lambda p: p != F.col("positive")), F.lit(0))
    found = found.withColumn("negative", negative).where("positive is not null and negative is not null and trim(query) <> ''")
    once = found.groupBy("query", "positive", "negative").agg(F.min("ts").alias("first_ts"))
    return once if most is None else once.orderBy("first_ts", "query", "positive", "negative").limit(most)


def clean_triplets(rows: DataFrame) -> DataFrame:
    """Trimmed triplets without blanks (M3)."""
    trimmed = rows.select(*[F.trim(c).alias(c) for c in ("query", "positive", "negative")])
    return trimmed.where("query <> '' and positive <> '' and negative <> ''")


def with_texts(rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triplets with their texts, and counts of what was rejected."""
    named = lambda side: texts.select(F.col("path").alias(side), F.col("text").alias(f"{side}_text"))
    both = rows.join(named("positive"), "positive", "left").join(named("negative"), "negative", "left")
    missing = F.col("positive_text").isNull() | F.col("negative_text").isNull()
    empty = ~missing & ((F.trim("positive_text") == "") | (F.trim("negative_text") == ""))
    counts = both.agg(F.count_if(missing).alias("missing"), F.count_if(empty).alias("empty"), F.count_if(~missing & ~empty).alias("kept"))
    return both.where(~missing & ~empty), counts


def hashed(*cols: str) -> Column:
    """A fixed order that doesn't follow the keys."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


def dev_split(rows: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """``rows`` with split dev or train (M4): by hash order; one dev row at least from ten rows on."""
    named = rows.withColumn("_hash", hashed(key))
    total = rows.agg(F.count("*").alias("_total"))  # one row
    least = F.when(F.col("_total") >= 10, 1).otherwise(0)
    placed = numbered(named, ["_hash", key], hash_bucket(F.col("_hash"))).crossJoin(F.broadcast(total))
    dev = F.col("number") <= F.greatest(F.floor(F.col("_total") * F.lit(share)), least)
    return placed.withColumn("split", F.when(dev, "dev").otherwise("train")).drop("number", "_total", "_hash")


def negatives(positives: DataFrame, pool: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, positive, negative, nth): ``most`` negatives for each positive from a pool (M5).

    The pool is numbered in hash order as a ring. A positive draws the files that follow the place of
    its own hash, itself left out, so the join is on a number. Where the pool has fewer, they repeat.
    """
    named = pool.select(F.col("path").alias("negative"), hashed("path").alias("_hash"))
    ring = numbered(named, ["_hash", "negative"], hash_bucket(F.col("_hash"))).select("negative", (F.col("number") - 1).alias("place"))
    total = ring.agg(F.count("*").alias("total"))  # one row
    at = F.conv(F.substring(hashed("query_id", "positive"), 1, 8), 16, 10).cast("long")
    asked = positives.select("query_id", "positive", at.alias("at")).crossJoin(F.broadcast(total)).where("total > 0")
    steps = F.sequence(F.lit(0), F.least(F.lit(most), F.col("total") - 1).cast("int"))
    asked = asked.select("query_id", "positive", F.posexplode(steps).alias("step", "_s"), F.pmod(F.col("at") + F.col("_s"), "total").alias("place"))
    drawn = asked.join(ring, "place").where("negative <> positive")
    mine = Window.partitionBy("query_id", "positive")
    drawn = drawn.withColumn("nth", F.row_number().over(mine.orderBy("step"))).withColumn("have", F.count("*").over(mine)).where(F.col("nth") <= most)
    have = F.least(F.col("have"), F.lit(most))
    again = drawn.withColumn("nth", F.explode(F.sequence(F.col("nth").cast("long"), F.lit(most).cast("long"), have)))
    return again.select("query_id", "positive", "negative", F.col("nth").cast("int").alias("nth"))


def click_seeds(log: DataFrame) -> DataFrame:
    """(query, positive, negatives, ts) from searches with a clicked chunk (M7): the negatives are the
    others of the first five results. Rows (query, clicked_chunk, results, ts)."""
    others = F.filter(F.slice(F.coalesce("results", F.array().cast("array<string>")), 1, 5), lambda c: c != F.col("clicked_chunk"))
    kept = log.where("clicked_chunk is not null and clicked_chunk <> ''")
    return kept.select("query", F.col("clicked_chunk").alias("positive"), others.alias("negatives"), "ts")


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of logs and triplet tables."""
    parts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def cross_triplets(judged: DataFrame) -> DataFrame:
    """Every relevant with every irrelevant path of one query's list (J17); lists have a top-k's length."""
    p = judged.where("relevant").select("query_id", F.col("path").alias("positive"))
    n = judged.where("not relevant").select("query_id", F.col("path").alias("negative"))
    return p.join(n, "query_id")


def transcripts(turns: DataFrame, roles: tuple[str, ...] = ("system", "user", "assistant")) -> DataFrame:
    """(conv_id, messages): role-filtered messages in order, each with its target mask (M6)."""
    message = F.struct("turn", "role", F.trim("text").alias("content"), (F.col("role") == "assistant").alias("is_target"))
    kept = turns.where(F.col("role").isin(*roles) & (F.trim("text") != "")).select("conv_id", message.alias("message"))
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("messages")).where(F.exists("messages", lambda m: m["is_target"]))


def clipped_deltas(events: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Values clipped to the 10th and 90th percentiles of their group, scaled by the median, with
    the step since the row before (M8)."""
    bounds = events.groupBy(group).agg(F.percentile(value, 0.1).alias("low"), F.percentile(value, 0.5).alias("mid"), F.percentile(value, 0.9).alias("high"))
    clipped = F.least(F.greatest(F.col(value), F.col("low")), F.col("high"))
    scaled = events.join(bounds, group).withColumn("scaled", F.when(F.col("mid") != 0, clipped / F.col("mid")).otherwise(clipped))
    return scaled.withColumn("delta", F.col("scaled") - F.lag("scaled").over(Window.partitionBy(group).orderBy(order))).select(group, order, "scaled", "delta")
