"""Fusion, re-ranking and shaping of ranked hits.

Hits are rows (query_id, corpus_id, leg, rank, chunk_id, score, ...). Legs are numbered 0 vector,
1 sparse, 2 graph; equal fused scores go to the first list, then the better rank, then the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FusionConfig, SearchConfig
from .joins import small

LEGS = ("vector", "sparse", "graph")
MODES = {"all": LEGS, "dense": LEGS[:1], "sparse": LEGS[1:2], "graph": LEGS[2:]}


def in_mode(hits: DataFrame, mode: str) -> DataFrame:
    """Only the legs that a mode turns on."""
    return hits.where(F.col("leg").isin(*MODES[mode]))


def leg_number() -> Column:
    return F.when(F.col("leg") == "vector", 0).when(F.col("leg") == "sparse", 1).otherwise(2)


def ranked_lists(hits: DataFrame) -> DataFrame:
    """Ranks within each list of a corpus and leg, by score."""
    w = Window.partitionBy("query_id", "corpus_id", "leg").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w))


def _fused(hits: DataFrame, part: Column, k: int) -> DataFrame:
    first = F.min(F.struct(leg_number().alias("list"), F.col("rank").alias("rank")))
    fused = hits.groupBy("query_id", "corpus_id", "chunk_id").agg(F.sum(part).alias("fused"), first.alias("first"))
    fused = fused.withColumn("fused", F.round("fused", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), "first", "corpus_id", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "corpus_id", "chunk_id", F.col("fused").alias("score"), "rank")


def reciprocal_rank(hits: DataFrame, k: int, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Sum over lists of 1 / (k + rank), rank from 1; chunks of different corpora never meet."""
    return _fused(hits, F.lit(1.0) / (F.lit(float(config.rrf_k)) + F.col("rank")), k)


def weighted(hits: DataFrame, k: int, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Weighted sum of scores, each leg divided by its largest over all corpora (R2)."""
    w = config.weights()
    weight = F.when(F.col("leg") == "vector", w["vector"]).when(F.col("leg") == "sparse", w["sparse"]).otherwise(w["graph"])
    score = F.col("score")
    if config.normalize_scores:
        top = F.max("score").over(Window.partitionBy("query_id", "leg"))
        score = F.when(top > 0, F.col("score") / top).otherwise(F.col("score"))
    scaled = hits.withColumn("scaled", score * weight)
    return _fused(scaled, F.col("scaled"), k)


def merge_hits(hits: DataFrame, fill: list[str]) -> DataFrame:
    """One row for each chunk: the first list's record, its missing fields filled from later ones."""
    order = F.struct(leg_number().alias("list"), F.col("rank").alias("rank"))
    filled = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), order)).alias(c) for c in fill]
    return hits.groupBy("query_id", "corpus_id", "chunk_id").agg(F.min_by("score", order).alias("score"), F.min_by("leg", order).alias("leg"), *filled)


def dedup(hits: DataFrame, by: list[str]) -> DataFrame:
    """The first hit of each key."""
    return cap(hits, by, 1)


def cap(hits: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most so many hits of each key."""
    w = Window.partitionBy("query_id", *by).orderBy("rank")
    return hits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def word_set(text: Column) -> Column:
    """The first 64 distinct words of 2 to 64 letters, digits or underscores."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]{2,64}"), F.lit(0))), 1, 64)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def mmr(hits: DataFrame, k: int, lam: float) -> DataFrame:
    """Maximal marginal relevance (R7): greedy within a query, over a pool of at most 200 hits.

    Hits need ``words`` (array) and may have ``embedding``; similarity is cosine where both have
    one, else the Jaccard similarity of the words. Ties go to the better rank.
    """
    pool = max(min(5 * k, 200), min(50, 200))

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        words = [set(w) if w is not None else set() for w in pdf["words"]]
        vectors = [np.asarray(e, float) if e is not None and len(e) else None for e in pdf["embedding"]]
        closest, chosen = np.zeros(len(pdf)), []
        left = list(range(len(pdf)))

        def similarity(i: int, j: int) -> float:
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b):
                scale = np.linalg.norm(a) * np.linalg.norm(b)
                return float(a @ b / scale) if scale else 0.0
            union = len(words[i] | words[j])
            return len(words[i] & words[j]) / union if union else 0.0

        while left and len(chosen) < k:
            value = [lam * pdf["score"][i] - (1 - lam) * closest[i] for i in left]
            i = left.pop(int(np.argmax(value)))
            chosen.append(i)
            for j in left:
                closest[j] = max(closest[j], similarity(i, j)) if len(chosen) > 1 else similarity(i, j)
        out = pdf.loc[chosen, ["query_id", "chunk_id", "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    kinds = dict(hits.dtypes)
    bounded = hits.where(F.col("rank") <= pool)  # at most 200 rows a query reach the function
    if "embedding" not in kinds:
        bounded = bounded.withColumn("embedding", F.lit(None).cast("array<double>"))
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, rank int"
    return bounded.select("query_id", "chunk_id", "score", "rank", "words", "embedding").groupBy("query_id").applyInPandas(select, schema)


def neighbours(hits: DataFrame, chunks: DataFrame, config: SearchConfig = SearchConfig(), first_is_missing: bool = False) -> DataFrame:
    """Neighbouring chunks of the leading hits, placed after their seed.

    Seeds are the first ceil(final_k / (2 w + 1)) hits; a neighbour at distance d scores its seed's
    score times max(0.5, 1 - 0.1 d). A chunk keeps its first place; the result is cut to final_k.
    ``first_is_missing`` treats ordinal 0 as having no ordinal.
    """
    w = config.neighbor_window
    seeds = -(-config.final_k // (2 * w + 1))
    known = chunks.where("chunk_ordinal > 0") if first_is_missing else chunks
    at = known.select("corpus_id", "chunk_id", "file_path", "chunk_ordinal")
    met = at.join(small(hits.select("corpus_id", "chunk_id").distinct()), ["corpus_id", "chunk_id"])  # a few chunks a query
    placed = hits.join(met, ["corpus_id", "chunk_id"], "left")
    near = placed.where((F.col("rank") <= seeds) & F.col("chunk_ordinal").isNotNull())
    near = near.select("query_id", "corpus_id", "file_path", "score", "rank", F.col("chunk_ordinal").alias("seed"), F.explode(F.sequence(F.col("chunk_ordinal") - w, F.col("chunk_ordinal") + w)).alias("chunk_ordinal"))
    near = at.join(small(near.where("chunk_ordinal <> seed")), ["corpus_id", "file_path", "chunk_ordinal"])
    distance = F.abs(F.col("chunk_ordinal") - F.col("seed"))
    found = near.select("query_id", "corpus_id", "chunk_id", (F.col("score") * F.greatest(F.lit(0.5), F.lit(1.0) - F.lit(0.1) * distance)).alias("score"), "rank", F.lit(1).alias("place"), F.col("chunk_ordinal").alias("sub"))
    own = placed.select("query_id", "corpus_id", "chunk_id", "score", "rank", F.lit(0).alias("place"), F.coalesce("chunk_ordinal", F.lit(0)).alias("sub"))
    every = own.unionByName(found)
    once = every.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "corpus_id", "chunk_id").orderBy("place", "rank", "sub"))).where("nth = 1")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "place", "sub", "chunk_id"))
    return once.withColumn("final_rank", order).where(F.col("final_rank") <= config.final_k).select("query_id", "corpus_id", "chunk_id", "score", "final_rank")


def rerank_blend(hits: DataFrame, alpha: float = 0.7, top_n: int = 50) -> DataFrame:
    """Blend of min-max scaled fused and re-ranking scores over the first ``top_n``; the tail stays."""
    head = F.col("rank") <= top_n
    w = Window.partitionBy("query_id")

    def scaled(c: str) -> Column:
        low, high = F.min(F.when(head, F.col(c))).over(w), F.max(F.when(head, F.col(c))).over(w)
        return F.when(high - low <= 1e-12, F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))

    blended = hits.withColumn("blended", F.when(head, F.round((1 - alpha) * scaled("score") + alpha * scaled("rerank_score"), 9)).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy((~head).cast("int"), F.when(head, -F.col("blended")), F.when(head, F.col("chunk_id")), "rank")
    return blended.withColumn("new_rank", F.row_number().over(order)).select("query_id", "chunk_id", F.col("blended").alias("score"), F.col("new_rank").alias("rank"))


Reranker = Callable[[pd.Series, pd.Series], pd.Series]


def overlap_reranker(questions: pd.Series, texts: pd.Series) -> pd.Series:
    """Deterministic lexical score: the share of the question's words that the text holds."""

    def one(q: str, t: str) -> float:
        asked = set(q.lower().split())
        return len(asked & set(t.lower().split())) / len(asked) if asked else 0.0

    return pd.Series([one(q, t) for q, t in zip(questions.fillna(""), texts.fillna(""))])


#: Why a query keeps its order: nothing to score with, nothing asked, or the model failed.
MISSING_MODEL, EMPTY_QUERY, ERROR = "missing_model", "empty_query", "error"


def rerank(hits: DataFrame, reranker: Reranker | None = overlap_reranker, snippet: int = 700, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Score (question, content) of the leading hits with a pluggable vectorised model and blend.

    It fails open: a query keeps its scores and order, and ``skipped_reason`` says why, if there is no
    model, the question is blank, or the model raised an error on one of its hits.
    """

    @F.pandas_udf("score double, reason string")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for questions, texts in batches:
            out = pd.DataFrame({"score": 0.0, "reason": None}, index=questions.index)
            blank = questions.fillna("").str.strip() == ""
            out.loc[blank, "reason"] = EMPTY_QUERY
            if reranker is None:
                out.loc[~blank, "reason"] = MISSING_MODEL
            elif not blank.all():
                try:
                    out.loc[~blank, "score"] = np.asarray(reranker(questions[~blank], texts[~blank]), float)
                except Exception:  # whatever a model raises, its queries keep their order
                    out.loc[~blank, "reason"] = ERROR
            yield out

    head = F.col("rank") <= config.rerank_top_n
    scored = hits.withColumn("scored", score("question", F.substring("content", 1, snippet)))
    reason = F.max(F.when(head, F.col("scored.reason"))).over(Window.partitionBy("query_id"))
    scored = scored.withColumn("skipped_reason", reason).withColumn("rerank_score", F.when(head, F.col("scored.score")).otherwise(0.0))
    blended = rerank_blend(scored.where("skipped_reason is null"), config.rerank_alpha, config.rerank_top_n).withColumn("skipped_reason", F.lit(None).cast("string"))
    return blended.unionByName(scored.where("skipped_reason is not null").select("query_id", "chunk_id", "score", "rank", "skipped_reason"))


def graph_blend(seeds: DataFrame, expanded: DataFrame, weight: float, k: int) -> DataFrame:
    """The larger of a chunk's seed score and its weighted expansion score (R12); by query, without corpora."""
    both = seeds.select("query_id", "chunk_id", "score").unionByName(expanded.select("query_id", "chunk_id", (F.col("score") * weight).alias("score")))
    best = both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recency_blend(hits: DataFrame, weight: float) -> DataFrame:
    """Score over the best mixed with age between the oldest and newest hit."""
    weight = min(1.0, max(0.0, weight))
    w = Window.partitionBy("query_id")
    top, low, high = F.max("score").over(w), F.min("ts").over(w), F.max("ts").over(w)
    relevance = F.when(top > 0, F.col("score") / top).otherwise(F.col("score"))
    age = (F.col("ts") - low) / (high - low)
    return hits.withColumn("blended", F.when(high > low, (1 - weight) * relevance + weight * age).otherwise(F.col("score")))


def confidence(hits: DataFrame, legs: int = 3, rrf_k: int = 60, method: str = "rrf") -> DataFrame:
    """Best fused score against the best possible one, and the mean of the first five."""
    top = F.max(F.when(F.col("rank") == 1, F.col("score")))
    scale = legs / (rrf_k + 1) if method == "rrf" else 1.0
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / F.lit(scale)))
    return hits.groupBy("query_id").agg(clamp(top).alias("conf_top1"), clamp(F.avg(F.when(F.col("rank") <= 5, F.col("score")))).alias("conf_avg5"))


def leg_counts(hits: DataFrame) -> DataFrame:
    """Hits by corpus and leg."""
    one = lambda leg: F.sum((F.col("leg") == leg).cast("long")).alias(f"n_{leg}")
    return hits.groupBy("query_id", "corpus_id").agg(*[one(x) for x in LEGS], F.count("*").alias("n_hits"))


def context(hits: DataFrame, most: int = 8, chars: int = 220) -> DataFrame:
    """The leading hits as one numbered text for each query."""
    line = F.format_string("[%d] %s\n%s", F.col("rank"), F.col("file_path"), F.substring(F.regexp_replace("content", r"\s+", " "), 1, chars))
    kept = hits.where(F.col("rank") <= most).select("query_id", F.struct("rank", line.alias("line")).alias("entry"))
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda x: x["line"]), "\n\n").alias("context"))
