"""Temporal list join: URL filtering against dated lists.

A list is a log of dated entries (list_key, effective, action): ``block`` or ``allow`` from that
day on, or ``remove``. The entries of a key become validity intervals that end where the next one
begins. A capture is looked up under every key that covers it (its host, each parent domain, and
host with first path segment) as of its fetch day; the most specific active entry decides.

Built from DataFrame functions alone. Keys are joined by equality with the interval as residual,
so each capture and key meets one interval at most; captures are made distinct first, so that a
URL fetched over and over is decided once. Keys are salted by URL and the intervals repeated for
each salt, so that a host or top-level domain with a third of the captures is spread over tasks.

Defined results: a null or unparsable URL, or a null fetch day, matches nothing and has decision
``none``. Two entries of a key on one day: remove goes before block, block before allow. Repeated
captures get equal rows; repeated entries count once. An empty list decides nothing. Columns of the
captures that are named like results give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stage

# How a host and the first path segment are taken from a URL.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))


def intervals(entries: DataFrame) -> DataFrame:
    """Active intervals (list_key, action, valid_from, valid_to); the last one of a key is open."""
    rank = F.when(F.col("action") == "remove", 2).when(F.col("action") == "block", 1).otherwise(0)
    known = entries.where("list_key is not null and effective is not null and action in ('allow', 'block', 'remove')")
    daily = known.groupBy(F.lower("list_key").alias("list_key"), "effective").agg(F.max_by("action", rank).alias("action"))
    until = F.lead("effective").over(Window.partitionBy("list_key").orderBy("effective"))
    spans = daily.select("list_key", "action", F.col("effective").alias("valid_from"), until.alias("valid_to"))
    return spans.where("action <> 'remove'")


def covering_keys(url: Column) -> Column:
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(F.coalesce(url, F.lit("")), SEGMENT, 1)
    with_path = F.when(segment != "", F.array(F.concat(host, F.lit("/"), F.lower(segment)))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(suffixes, with_path)).otherwise(F.array().cast("array<string>"))


#: Lookups of a key from which on they are dealt to salts, and their number.
HOT_KEY, SALTS = 1_000, 64
#: Hot keys up to which they are broadcast.
MOST_HOT = 100_000


def decide(captures: DataFrame, entries: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """``captures`` (with url and fetched) and decision, matched_key, valid_from for each row.

    Keys that many captures look up, such as top-level domains and large hosts, are dealt to salts; only their intervals
    are repeated.
    """
    looked_up = captures.select("url", "fetched").where("url is not null and fetched is not null").distinct()
    keys = looked_up.select("url", "fetched", F.explode(covering_keys(F.col("url"))).alias("list_key"))
    hot = keys.groupBy("list_key").agg(F.count("*").alias("n")).where(F.col("n") > hot_key).select("list_key", F.lit(True).alias("hot"))
    hot = stage(hot, "hot-keys")
    hot = F.broadcast(hot) if hot.limit(MOST_HOT + 1).count() <= MOST_HOT else hot
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("url", "fetched"), F.lit(SALTS))).otherwise(0).cast("int")
    keys = keys.join(hot, "list_key", "left").select("url", "fetched", "list_key", salt.alias("salt"))
    repeated = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spans = intervals(entries).join(hot, "list_key", "left").withColumn("salt", F.explode(repeated)).drop("hot")
    active = keys.join(spans, ["list_key", "salt"]).where("fetched >= valid_from and (valid_to is null or fetched < valid_to)")
    match = F.struct(F.length("list_key").alias("specific"), "list_key", "action", "valid_from")
    best = active.groupBy("url", "fetched").agg(F.max(match).alias("best"))
    kept = [c for c in captures.columns if c not in ("decision", "matched_key", "valid_from", "best")]
    rows = captures.select(kept).join(best, ["url", "fetched"], "left")
    return rows.select(*kept, F.coalesce("best.action", F.lit("none")).alias("decision"), F.col("best.list_key").alias("matched_key"), F.col("best.valid_from").alias("valid_from"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def dated_list(pages: DataFrame) -> DataFrame:
    """The list that the query evaluates, made from the hosts themselves since the tables have none:
    a host is blocked from a day of 2024 given by its hash and, two times in three, removed 90 days
    later; registered domains of ``spam`` and ``pills`` hosts are blocked from 1 March; German
    sections are allowed from 1 June."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    number = _number(F.col("host"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (number % 300).cast("int"))
    chosen = hosts.where(number % 4 == 0)
    added = chosen.select(F.col("host").alias("list_key"), day.alias("effective"), F.lit("block").alias("action"))
    removed = chosen.where(number % 3 != 0).select(F.col("host"), F.date_add(day, 90), F.lit("remove"))
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    spam = hosts.where("(host like '%spam%' or host like '%pills%')").where(parent != "").select(parent, F.lit("2024-03-01").cast("date"), F.lit("block"))
    sections = chosen.select(F.concat("host", F.lit("/de")), F.lit("2024-06-01").cast("date"), F.lit("allow"))
    return added.union(removed).union(spam).union(sections)


def op8_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    found = decide(pages.withColumn("fetched", fetched), dated_list(pages))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("fetched", "valid_from")})


OP8_SQL = """
WITH pages_at AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS fetched,
         rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@]+)', 1)), '.') AS host,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)) AS segment
  FROM pages
), hosts AS (
  SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 8))::bigint AS number FROM pages_at WHERE host <> ''
), entries AS (
  SELECT host AS list_key, CAST(DATE '2024-01-01' + CAST(number % 300 AS INTEGER) AS DATE) AS effective, 'block' AS action FROM hosts WHERE number % 4 = 0
  UNION ALL SELECT host, CAST(DATE '2024-01-01' + CAST(number % 300 + 90 AS INTEGER) AS DATE), 'remove' FROM hosts WHERE number % 4 = 0 AND number % 3 <> 0
  UNION ALL SELECT regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1), DATE '2024-03-01', 'block' FROM hosts
            WHERE (host LIKE '%spam%' OR host LIKE '%pills%') AND regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) <> ''
  UNION ALL SELECT host || '/de', DATE '2024-06-01', 'allow' FROM hosts WHERE number % 4 = 0
), daily AS (
  SELECT list_key, effective, arg_max(action, CASE action WHEN 'remove' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS action FROM entries GROUP BY ALL
), spans AS (
  SELECT list_key, action, effective AS valid_from, lead(effective) OVER (PARTITION BY list_key ORDER BY effective) AS valid_to FROM daily
), matched AS (
  SELECT p.page_id, p.url, s.list_key, s.action, s.valid_from,
         row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(s.list_key) DESC) AS r
  FROM pages_at p JOIN spans s
    ON (p.host = s.list_key OR p.host LIKE '%.' || s.list_key OR p.host || '/' || p.segment = s.list_key)
   AND s.action <> 'remove' AND p.fetched >= s.valid_from AND (s.valid_to IS NULL OR p.fetched < s.valid_to)
)
SELECT p.page_id, p.url, strftime(p.fetched, '%Y-%m-%d') AS fetched, coalesce(m.action, 'none') AS decision, m.list_key AS matched_key, strftime(m.valid_from, '%Y-%m-%d') AS valid_from
FROM pages_at p LEFT JOIN matched m ON p.page_id = m.page_id AND p.url = m.url AND m.r = 1
"""
