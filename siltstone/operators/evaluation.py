"""Retrieval evaluation (E1-E9), percentiles (A6-A8) and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..functions.text import extension, path_matches
from .numbering import at_index


def per_query(expected: DataFrame, retrieved: DataFrame, config: EvalConfig = EvalConfig()) -> DataFrame:
    """Metrics of each query from rows (query_id, path) and ranked rows (query_id, path, rank).

    Paths are made distinct first, the best rank kept. A retrieved path is relevant if it holds an
    expected one; nDCG is raw, so several retrieved paths on one expected one can pass 1.
    """
    once = retrieved.groupBy("query_id", "path").agg(F.min("rank").alias("at"))
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).drop("at")
    wanted = expected.select("query_id", F.col("path").alias("expected")).distinct()
    met = once.join(wanted, "query_id").where(path_matches(F.col("path"), F.col("expected")))
    relevant = met.groupBy("query_id", "rank").agg(F.count("*").alias("n"))
    ranks = relevant.groupBy("query_id").agg(F.min("rank").alias("first"), _count(F.col("rank") <= config.precision_k).alias("hits"), F.sum(F.when(F.col("rank") <= config.ndcg_k, F.lit(1.0) / F.log2(F.col("rank") + 1))).alias("dcg"))
    found = met.groupBy("query_id", "expected").agg(F.min("rank").alias("rank")).groupBy("query_id").agg(*[_count(F.col("rank") <= k).alias(f"found_{k}") for k in config.recall_ks])
    total = wanted.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    every = total.join(ranks, "query_id", "left").join(found, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_expected", F.lit(config.ndcg_k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "query_id", zero(F.lit(1.0) / F.col("first")).alias("reciprocal_rank"),
        *[zero(F.col(f"found_{k}") / F.col("n_expected")).alias(f"recall_{k}") for k in config.recall_ks],
        zero(F.col("hits") / F.lit(float(config.precision_k))).alias(f"precision_{config.precision_k}"),
        zero(F.col("dcg") / ideal).alias(f"ndcg_{config.ndcg_k}"),
        F.coalesce(F.col("first") == 1, F.lit(False)).alias("top1_hit"), F.coalesce(F.col("first") <= config.final_k, F.lit(False)).alias("topk_hit"),
    )


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("double"))


def ceil_percentile(rows: DataFrame, group: str, value: str, p: float, name: str) -> DataFrame:
    """The value at index ceil(p (n - 1)) from 0 of each group."""
    return at_index(rows, group, value, F.ceil(F.lit(p) * (F.col("n") - 1)), name)


def depth(config: EvalConfig = EvalConfig()) -> int:
    """How many results an evaluation retrieves: enough for all its metrics."""
    return max(config.final_k, *config.recall_ks, config.precision_k, config.ndcg_k)


def first_entries(entries: DataFrame, sample_size: int | None) -> DataFrame:
    """The first entries by ``ordinal``, all of them without a sample size (E6); this is a sample by purpose."""
    return entries.orderBy("ordinal").limit(sample_size) if sample_size else entries


#: Extensions of which questions are made.
CODE_EXTENSIONS = ("py", "js", "ts", "tsx", "go", "rs", "java")


def dataset_of(files: DataFrame, questions: int = 20, extensions: tuple[str, ...] = CODE_EXTENSIONS) -> DataFrame:
    """(entry_id, question, expected_paths, tags) for a sample of files by hash (E9); this is a sample by purpose."""
    path = F.col("file_path")
    kind = extension(path)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    kept = files.where(kind.isin(*extensions) & ~F.contains(path, F.lit("node_modules"))).select("file_path").distinct()
    entry = F.md5("file_path")
    made = kept.select(entry.alias("entry_id"), F.concat(F.lit("How does "), stem, F.lit(" work?")).alias("question"), F.array("file_path").alias("expected_paths"), F.array(kind).alias("tags"))
    return made.orderBy("entry_id").limit(questions)


def nearest_rank(rows: DataFrame, group: str, value: str, p: float, name: str) -> DataFrame:
    """(group, name): the smallest value that ``p`` of a group's rows don't exceed."""
    return at_index(rows, group, value, F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0)), name)


def interpolated(rows: DataFrame, group: str, value: str, p: float, name: str) -> DataFrame:
    """(group, name): linear interpolation between the neighbours of a place in a group's rows."""
    place = F.lit(p) * (F.col("n") - 1)
    low, high = at_index(rows, group, value, F.floor(place), "_low"), at_index(rows, group, value, F.ceil(place), "_high")
    sizes = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    share = place - F.floor(place)
    return low.join(high, group).join(sizes, group).select(group, (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias(name))


def profile(labels: DataFrame, k: int = 10) -> DataFrame:
    """Label kind and recommended metric from rows (row, key, label) in row order.

    Reading stops at the first row that shows graded labels, so the averages cover the rows so far.
    """
    by_row = labels.groupBy("row").agg(_count(F.col("label") > 0).alias("relevant"), F.max((~F.col("label").isin(0.0, 1.0)).cast("int")).alias("graded"))
    stop = by_row.agg(F.min(F.when(F.col("graded") == 1, F.col("row"))).alias("stop"))  # one row
    seen = by_row.crossJoin(stop).where("stop is null or row <= stop")
    p95 = ceil_percentile(seen.withColumn("all", F.lit(1)), "all", "relevant", 0.95, "p95_relevant").drop("all")
    totals = seen.agg(F.avg("relevant").alias("avg_relevant"), F.max("graded").alias("graded"), F.count("*").alias("n")).crossJoin(p95)
    few = (F.col("p95_relevant") <= 1) | (F.col("avg_relevant") < 1.2)
    metric = F.when(F.col("graded") == 1, "ndcg").when(few, "mrr").otherwise("ndcg")
    return totals.select(F.when(F.col("graded") == 1, "graded").otherwise("binary").alias("label_kind"), F.round("avg_relevant", 6).alias("avg_relevant"), "p95_relevant", metric.alias("recommended_metric"), F.lit(max(1, min(200, k))).alias("recommended_k"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (ordinal, reciprocal_rank) of two runs side by side by position."""
    a = before.select("ordinal", F.col("reciprocal_rank").alias("old"))
    b = after.select("ordinal", F.col("reciprocal_rank").alias("new"))
    change = F.when(F.col("new") > F.col("old"), "improved").when(F.col("new") < F.col("old"), "regressed").otherwise("same")
    return a.join(b, "ordinal").select("ordinal", "old", "new", (F.col("new") - F.col("old")).alias("delta"), change.alias("change"))


def diff_runs(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row from two runs of one row each (metric, k, best, time_to_best, stddev): whether they can be
    compared, and their differences, null where either lacks a value (A11)."""
    side = lambda run, name: run.select(*[F.col(c).alias(f"{name}_{c}") for c in ("metric", "k", "best", "time_to_best", "stddev")])
    both = side(baseline, "old").crossJoin(side(current, "new"))  # one row each
    same = F.col("old_metric").eqNullSafe(F.col("new_metric")) & F.col("old_k").eqNullSafe(F.col("new_k"))
    delta = lambda c: F.when(same, F.col(f"new_{c}") - F.col(f"old_{c}")).alias(f"delta_{c}")
    reason = F.when(~same, F.format_string("Incompatible runs: primary_metric/primary_k differ (baseline=%s@%s, current=%s@%s)", "old_metric", "old_k", "new_metric", "new_k"))
    return both.select(same.alias("compatible"), reason.alias("reason"), delta("best"), delta("time_to_best"), delta("stddev"))


def compare_maps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose values differ, with what became of them (J14), from rows (key, value)."""
    a, b = old.select("key", F.col("value").alias("old")), new.select("key", F.col("value").alias("new"))
    both = a.join(b, "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))


def pairwise_proxy(pairs: DataFrame) -> DataFrame:
    """MRR, nDCG, MAP and accuracy of (positive, negative) score pairs: rank 1, 2 or 1.5 for ties."""
    rank = F.when(F.col("positive") > F.col("negative"), 1.0).when(F.col("positive") < F.col("negative"), 2.0).otherwise(1.5)
    ranked = pairs.withColumn("rank", rank)
    return ranked.agg(F.count("*").alias("n"), F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"), F.avg(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("ndcg"), F.avg(F.lit(1.0) / F.col("rank")).alias("map"), F.avg((F.col("positive") > F.col("negative")).cast("double")).alias("accuracy"))
