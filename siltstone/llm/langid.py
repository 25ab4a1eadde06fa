"""Word-first backoff language identification.

Known words score by their log frequency in each language; a word that training never saw falls
back to its character n-grams, longest order first, and stops at the first order of which any
gram is known. The model is fitted on a sample of labelled rows whose size for each language is a
parameter. Every label is learned and every word and gram of the sample is kept, so a language
with few rows has its whole vocabulary. Spark counts the words and grams; the model is their
64-bit hashes in order, each with the languages that have it, so it is as large as the sample's
vocabulary (about 16 bytes for each word or gram and language that has it).

Defined results: null text or text without a letter gives ``und`` with score 0. Repeated rows are
predicted alike. A null ``doc_id`` hashes as the empty text. Ties between languages go to the
first by code point. With no labelled row at all every document is ``und``. Columns other than
``doc_id``, ``text`` and (for fitting) ``lang`` are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches, stage

LETTERS = re.compile(r"[^\W\d_]+")
#: Seed of Spark's xxhash64.
SEED = 42


@dataclass(frozen=True)
class LangIdConfig:
    #: Labelled rows of each language to fit on; chosen by hash, so about this many at most.
    sample_rows: int = 8_000
    max_order: int = 4
    smoothing: float = 0.5
    #: Documents scoring less are rejected by the filter.
    min_score: float = 0.5


@dataclass(frozen=True)
class LogFrequencies:
    """Log frequencies of hashed items: ``base`` for each language, and for the languages that have an
    item a gain over it. The gains of ``keys[i]`` are those from ``starts[i]`` to ``starts[i + 1]``."""

    keys: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    gains: np.ndarray
    base: np.ndarray

    @staticmethod
    def of_counts(keys: np.ndarray, languages: np.ndarray, n: np.ndarray, n_languages: int, smoothing: float) -> LogFrequencies:
        order = np.lexsort((languages, keys))
        keys, languages, n = keys[order], languages[order], n[order].astype(np.float64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        total = np.bincount(languages, n, n_languages)
        base = np.log(smoothing) - np.log(total + smoothing * max(1, len(starts)))
        return LogFrequencies(keys[starts], np.r_[starts, len(keys)], languages.astype(np.int32), np.log((n + smoothing) / smoothing).astype(np.float32), base.astype(np.float32))

    def rows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which items are known, and a row of log frequencies for each of those."""
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == wanted if len(self.keys) else np.zeros(len(wanted), bool)
        first, end = self.starts[at[known]], self.starts[at[known] + 1]
        row = np.repeat(np.arange(len(first)), end - first)
        gain = np.arange(len(row)) + np.repeat(first - np.r_[0, (end - first).cumsum()[:-1]], end - first) if len(first) else np.empty(0, np.int64)
        out = np.tile(self.base, (len(first), 1))
        out[row, self.languages[gain]] += self.gains[gain]
        return known, out


@dataclass(frozen=True)
class LangIdModel:
    languages: list[str]
    max_order: int
    words: LogFrequencies | None = None
    grams: LogFrequencies | None = None


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def hashes(items: list[str]) -> np.ndarray:
    """Spark's xxhash64 of each string."""
    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED) for x in items], np.uint64).view(np.int64)


def grams_of(word: str, order: int) -> list[str]:
    marked = f"^{word}$" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def fit(labelled: DataFrame, config: LangIdConfig = LangIdConfig()) -> LangIdModel:
    """Fit on rows (doc_id, text, lang); null texts and labels are passed over."""
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language, as the model has
    languages = sorted(sizes)
    if not languages:
        return LangIdModel([], config.max_order)
    shares = rows.sparkSession.createDataFrame([(x, i, min(1.0, config.sample_rows / sizes[x])) for i, x in enumerate(languages)], "lang string, language int, share double")
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("language", "text")

    def counted(batch: pd.DataFrame, count: Callable[[pd.DataFrame], Counter]) -> Iterator[pd.DataFrame]:
        for language, part in batch.groupby("language"):
            if counts := count(part):
                yield pd.DataFrame({"language": language, "item": list(counts), "n": list(counts.values())})

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from counted(pdf, lambda part: Counter(w for t in part["text"] for w in LETTERS.findall(t.lower())))

    orders = range(1, config.max_order + 1)

    def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def count(part: pd.DataFrame) -> Counter:
            counts: Counter = Counter()
            for word, n in zip(part["item"], part["n"]):
                for order in orders:
                    for gram in grams_of(word, order):
                        counts[gram] += n
            return counts

        for pdf in batches:
            yield from counted(pdf, count)

    schema = "language int, item string, n long"
    words = stage(sample.mapInPandas(count_words, schema).groupBy("language", "item").agg(F.sum("n").alias("n")), "langid-words")
    grams = words.mapInPandas(count_grams, schema).groupBy("language", "item").agg(F.sum("n").alias("n"))

    def table(counts: DataFrame) -> LogFrequencies:
        found = counts.select(F.xxhash64("item").alias("key"), "language", "n").toArrow()  # bounded by the sample
        return LogFrequencies.of_counts(*[found[c].to_numpy() for c in ("key", "language", "n")], len(languages), config.smoothing)

    return LangIdModel(languages, config.max_order, table(words), table(grams))


class WordScores:
    """Log frequencies of the words met so far, a row each; words are scored anew, alike, after ``clear``."""

    def __init__(self, model: LangIdModel, most_cells: int = 1_000_000):
        self.model, self.most_rows = model, max(1, most_cells // max(1, len(model.languages)))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.model.languages)), np.float32)

    def back_off(self, words: list[str]) -> np.ndarray:
        """The mean over the known grams of the longest order that has any; zeros without any."""
        out, left = np.zeros((len(words), len(self.model.languages)), np.float32), list(range(len(words)))
        for order in range(self.model.max_order, 0, -1):
            grams = [(i, g) for i in left for g in grams_of(words[i], order)]
            if not grams:
                continue
            known, rows = self.model.grams.rows(hashes([g for _, g in grams]))
            owner = np.array([i for i, _ in grams])[known]
            n = np.bincount(owner, minlength=len(words))
            np.add.at(out, owner, rows)
            met = n > 0
            out[met] /= n[met, None]
            left = [i for i in left if not met[i]]
        return out

    def learn(self, words: list[str]) -> None:
        if len(self.at) + len(words) > self.most_rows:
            self.clear()
        words = [w for w in words if w not in self.at]
        if not words:
            return
        known, rows = self.model.words.rows(hashes(words))
        fresh = np.empty((len(words), rows.shape[1]), np.float32)
        fresh[known] = rows
        fresh[~known] = self.back_off([w for w, k in zip(words, known) if not k])
        n = len(self.at)
        while n + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[n : n + len(words)] = fresh
        self.at.update(zip(words, range(n, n + len(words))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        languages = self.model.languages
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if languages:
            self.learn(list({w for words in found for w in words}))
        out = []
        for words in found:
            if not languages or not any(c.isalpha() for w in words for c in w):
                out.append(("und", 0.0))
                continue
            total = self.rows[[self.at[w] for w in words]].sum(0, dtype=np.float64)
            logits = total / len(words) * min(len(words), 12)
            odds = np.exp(logits - logits.max())
            best = int(odds.argmax())
            out.append((languages[best], float(odds[best] / odds.sum())))
        return out


def predictor(spark: SparkSession, model: LangIdModel) -> Callable[[Column], Column]:
    """Column function from a text to struct(lang_pred, score)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = WordScores(shared.value)
        for texts in batches:
            rows = texts.tolist()
            found = [x for a in range(0, len(rows), 200) for x in scores.predict(rows[a : a + 200])]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    # Else Catalyst copies the call into the filters above it, and every text is scored twice.
    return run.asNondeterministic()


def predict(docs: DataFrame, model: LangIdModel) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of ``docs``."""
    guess = predictor(docs.sparkSession, model)
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), guess(F.col("text")).alias("guess"))
    return rows.select("doc_id", "held_out", "guess.lang_pred", "guess.score")


def fit_documents(docs: DataFrame, config: LangIdConfig = LangIdConfig()) -> LangIdModel:
    """Fit on the labelled documents outside the held-out fold."""
    return fit(docs.where(fold(F.col("doc_id")) != 1), config)


def keep_identified(docs: DataFrame, model: LangIdModel, config: LangIdConfig = LangIdConfig()) -> DataFrame:
    """Documents with a language scoring ``min_score`` or more; a missing label is filled in."""
    guess = predictor(docs.sparkSession, model)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), guess(F.col("text")).alias("guess"))
    kept = rows.where((F.col("guess.lang_pred") != "und") & (F.col("guess.score") >= config.min_score))
    return kept.select(*[F.coalesce("doc.lang", "guess.lang_pred").alias(c) if c == "lang" else F.col("doc").getField(c).alias(c) for c in docs.columns])


def op4_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, fit_documents(docs))
