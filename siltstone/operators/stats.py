"""Corpus statistics, series statistics, estimates and costs."""

from __future__ import annotations

from dataclasses import fields, is_dataclass, replace
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import extension
from .joins import small

T = TypeVar("T")

# Planning constants of the index estimate.
BYTES_PER_TOKEN = 4
TOKENS_PER_SECOND = {"deterministic": 120_000, "cloud": 50_000, "local": 8_000}
OVERHEAD_SECONDS, LOW, HIGH = 12.0, 0.6, 1.9
#: Latency buckets in seconds and tokens assumed for one embedding or one re-ranking call.
EMBED_TOKENS, RERANK_TOKENS, DAYS = 1000, 500, 30


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, tokens and files of each corpus (A1)."""
    return chunks.groupBy("corpus_id").agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"), F.count_distinct("file_path").alias("total_files"))


def index_analysis(chunks: DataFrame, by: Column, name: str) -> DataFrame:
    """Token statistics by language or extension (A2)."""
    return chunks.groupBy(by.alias(name)).agg(F.count("*").alias("n_chunks"), F.avg("token_count").alias("avg_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.count_distinct("file_path").alias("n_files"))


def files_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("file_path")).alias("extension")).agg(F.count_distinct("file_path").alias("n_files"))


def storage(chunks: DataFrame) -> DataFrame:
    """Bytes of texts and the share of an index, in proportion (A3)."""
    sized = chunks.groupBy("corpus_id").agg(F.sum(F.octet_length("content")).alias("text_bytes"), F.count_if(F.col("token_count") > 0).alias("indexed_chunks"))
    return sized.withColumn("share", F.col("text_bytes") / F.sum("text_bytes").over(Window.partitionBy()))


def tail(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return rows.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def retained(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Ring-buffer retention, clamped to 10 to 500 rows."""
    return tail(rows, group, order, min(500, max(10, n)))


def best_and_when(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The best value and the first time at which it was met (A10)."""
    best = F.max(value)
    return rows.groupBy(group).agg(best.alias("best"), F.max(F.struct(F.col(value), F.struct((-F.col(order)).alias("o"))))["col2"]["o"].alias("negative")).select(group, "best", (-F.col("negative")).alias("first_at"))


def quantile_from_buckets(buckets: DataFrame, group: list[str], p: float) -> DataFrame:
    """Linear interpolation in cumulative buckets (group, upper, n): the way of rate dashboards."""
    w = Window.partitionBy(*group).orderBy("upper")
    c = buckets.withColumn("below", F.sum("n").over(w)).withColumn("lower", F.coalesce(F.lag("upper").over(w), F.lit(0.0))).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    wanted = F.lit(p) * F.col("total")
    hit = c.where((F.col("below") >= wanted) & (F.col("below") - F.col("n") < wanted))
    return hit.select(*group, (F.col("lower") + (F.col("upper") - F.col("lower")) * (wanted - (F.col("below") - F.col("n"))) / F.col("n")).alias("quantile"))


def counter_increases(samples: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """``samples`` of counters with ``increase``, what each gained since the sample of its series before. A counter
    that fell was set back to zero in between and gained what it shows; a series' first sample gains nothing."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(ts))
    return samples.withColumn("increase", F.when(before.isNull(), F.lit(0)).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value)))


def histogram_quantile(samples: DataFrame, series: list[str], le: str, ts: str, value: str, window: str, p: float) -> DataFrame:
    """(window_start, quantile) of cumulative bucket counters sampled in many series (A12): increases are corrected for
    resets in every series, added up over the series for each window and bucket, and the quantile is read from the sums."""
    gained = counter_increases(samples, [*series, le], ts, value).groupBy(F.window(ts, window)["start"].alias("window_start"), F.col(le).alias("upper")).agg(F.sum("increase").alias("upto"))
    inside = Window.partitionBy("window_start").orderBy("upper")  # a row a bucket
    buckets = gained.withColumn("n", F.col("upto") - F.coalesce(F.lag("upto").over(inside), F.lit(0)))
    return quantile_from_buckets(buckets, ["window_start"], p)


def bucket_upper(value: Column, edges: list[float]) -> Column:
    """The smallest edge that the value doesn't exceed; the last edge for those over it."""
    out = F.lit(edges[-1])
    for e in reversed(edges[:-1]):
        out = F.when(value <= e, F.lit(e)).otherwise(out)
    return out


def success_ratio(errors: Column, requests: Column) -> Column:
    return F.lit(1.0) - errors / F.greatest(requests, F.lit(1))


def estimate(total_bytes: Column, backend: str = "deterministic", config: ChunkConfig = ChunkConfig()) -> dict[str, Column]:
    """Tokens, chunks and a range of seconds to index so many bytes."""
    tokens = F.floor(total_bytes / BYTES_PER_TOKEN).cast("long")
    stride = max(1, config.target_tokens - config.overlap_tokens)
    seconds = tokens / F.lit(float(TOKENS_PER_SECOND[backend])) + OVERHEAD_SECONDS
    return {"tokens": tokens, "chunks": F.ceil(tokens / F.lit(stride)).cast("long"), "seconds_low": seconds * LOW, "seconds_high": seconds * HIGH}


def price(requests: DataFrame, catalog: DataFrame, provider: str, model: str, columns: list[str]) -> DataFrame:
    """``requests`` with prices of the first catalogue row that fits (F11): provider and model, else
    the model, else the provider; earlier rows first. The catalogue is a small dimension table."""
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    c = catalog.select(key(F.col("provider")).alias("c_provider"), key(F.col("model")).alias("c_model"), "position", *columns)
    p, m = key(F.col(provider)), key(F.col(model))
    same_provider, same_model = (p != "") & (F.col("c_provider") == p), (m != "") & (F.col("c_model") == m)
    level = F.when(same_provider & same_model, 0).when(same_model, 1).when(same_provider, 2)
    met = requests.join(small(c), same_provider | same_model, "left").withColumn("level", level)
    w = Window.partitionBy("request_id").orderBy(F.col("level").asc_nulls_last(), F.col("position"))
    return met.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "c_provider", "c_model", "position")


POWER = ("kwh_rate", "watts", "hours_per_day")


def cost(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Costs of rows (request_id, provider, model, tokens_in, tokens_out, embeds, reranks, per_day) and, where there are
    such columns, (kwh_rate, watts, hours_per_day), with the errors of what couldn't be priced."""
    priced = price(requests, catalog, "provider", "model", ["input_per_1k", "output_per_1k", "embed_per_1k", "per_request", "rerank_per_1k"])
    known = F.col("level").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    generation = F.col("tokens_in") / 1000 * zero("input_per_1k") + F.col("tokens_out") / 1000 * zero("output_per_1k")
    embedding = F.col("embeds") * EMBED_TOKENS / 1000 * zero("embed_per_1k")
    rerank = F.when(F.col("per_request").isNotNull(), F.col("reranks") * F.col("per_request")).otherwise(F.col("reranks") * RERANK_TOKENS / 1000 * zero("rerank_per_1k"))
    each = F.round(F.when(known, F.round(generation, 6) + F.round(embedding, 6) + F.round(rerank, 6)).otherwise(0.0), 6)
    unknown = F.when(~known, F.format_string("Unknown model: %s/%s", "provider", "model")).when(F.col("input_per_1k").isNull() & F.col("output_per_1k").isNull() & (F.col("tokens_in") + F.col("tokens_out") > 0), F.format_string("Missing price: %s/%s", "provider", "model")).otherwise("")
    power, wanted = F.lit(0.0), F.lit(None).cast("string")
    if all(c in requests.columns for c in POWER):
        rate, watts, hours = map(F.col, POWER)
        power = F.coalesce(watts / 1000 * hours * rate, F.lit(0.0))
        some, every = F.coalesce(rate, watts, hours).isNotNull(), (rate + watts + hours).isNotNull()
        wanted = F.when(some & ~every, "Electricity needs kwh_rate, watts and hours_per_day")
    daily = F.round(each * F.col("per_day") + power, 6)
    error = F.concat_ws("; ", F.when(unknown != "", unknown), wanted)
    return priced.select("request_id", each.alias("per_request_usd"), F.round(power, 6).alias("electricity_usd"), daily.alias("daily_usd"), F.round(daily * DAYS, 6).alias("monthly_usd"), error.alias("error"))


#: Components that models serve as.
COMPONENTS = ("EMB", "GEN", "RERANK")


def models_for(catalog: DataFrame, component: str) -> DataFrame:
    """Rows of a catalogue (provider, model, components) that serve as a component, named in either case."""
    if component.upper() not in COMPONENTS:
        raise ValueError(f"no such component: {component}")
    return catalog.where(F.array_contains("components", component.upper()))


def merged(old: Column, new: Column) -> Column:
    """A map with the entries of both; those of ``new`` go before, and a null map has none."""
    kept = F.filter(F.map_entries(old), lambda e: ~F.map_contains_key(new, e["key"]))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_from_entries(F.concat(kept, F.map_entries(new))))


# Shares of the raw size that parts of an index take, and bytes of a number by precision.
KEYWORD_SHARE, SUMMARY_SHARE, RERANKER_SHARE = 0.20, 0.10, 0.5
PRECISION_BYTES = {"float32": 4.0, "float16": 2.0, "int8": 1.0, "pq8": 0.5}


def storage_plan(corpora: DataFrame, dim: int = 512, precision: str = "float32", overhead: float = 1.5, hydration: float = 1.0, replicas: int = 3, chunk_bytes: int = 4096) -> DataFrame:
    """Bytes that an index of rows (corpus_id, raw_bytes) takes by part, alone and replicated."""
    raw = F.col("raw_bytes").cast("double")
    chunks = F.ceil(raw / chunk_bytes)
    vectors = chunks * F.lit(dim * PRECISION_BYTES[precision])
    keep = [vectors, vectors * overhead, raw * hydration, raw * SUMMARY_SHARE, vectors * RERANKER_SHARE]
    critical = sum(keep[1:], keep[0])
    single = critical + raw * KEYWORD_SHARE
    return corpora.select("corpus_id", chunks.alias("chunks"), vectors.alias("vectors"), (vectors * overhead).alias("vector_index"), (raw * KEYWORD_SHARE).alias("keyword_index"), single.alias("single"), (single + (replicas - 1) * critical).alias("replicated"))


def flat_config(section: object, prefix: str = "") -> dict[str, object]:
    """Nested dataclasses or dicts as one dict with dotted names."""
    given = {f.name: getattr(section, f.name) for f in fields(section)} if is_dataclass(section) else section
    out: dict[str, object] = {}
    for name, value in given.items():
        nested = is_dataclass(value) or isinstance(value, dict)
        out |= flat_config(value, f"{prefix}{name}.") if nested else {prefix + name: value}
    return out


def patched(section: T, changes: dict[str, object]) -> T:
    """A section of the configuration with some values changed, checked anew; unknown names are errors."""
    return replace(section, **changes)
