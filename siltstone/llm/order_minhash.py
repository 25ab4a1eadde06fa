"""Near-duplicates by Order MinHash, verified by banded alignment.

Words are runs of letters and digits in lower case. A text's k-mers are its windows of five words,
labelled with their occurrence number. A sketch takes the several k-mers that are smallest under
its hash and retains their text order; texts that share a sketch are candidates. A candidate pair
is linked if a banded alignment of the two word sequences matches 0.8 or more of the longer one's
words in order (edit similarity). Linked texts and their copies form classes.

Texts of few words have few or no five-word windows in common with a near copy, so they get buckets
of their own beside these. Up to ``exact_words`` words a text is also placed under every sequence
of its words that a similar text of at most as many words can share with it: such texts share a
bucket if and only if they are similar. Up to ``short_words`` words it is also placed under sketches
of single words, by band of length.

A word replaced, put in or taken out here and there spoils five-word windows around it, so longer texts also
have sketches of word pairs, labelled and ordered alike: they find texts that differ in up to a fifth of
their words, which the alignment accepts and five-word sketches mostly miss.

Exact copies are collapsed to one text first. A bucket of texts with one sketch is never expanded
into its pairs while they can be spared: in some rounds every member is aligned with one
representative, a different one each round, and members already in its class are passed over;
of the pairs of different classes that still share a bucket after these rounds, all are aligned
that their lengths and word parities allow. A pair within a class can't change the classes, and
the bounds by length and parity leave out no similar pair, so classes come out as if all
candidates had been aligned.

Defined results: a null text is an empty one. A text with fewer than five words has one k-mer, all
its words; a text without words is similar to its exact copies alone. Repeated rows are copies of
each other. A class is named by its smallest non-null ``doc_id`` (null if it has none). Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, letter_or_digit_table, mix, read_table, small_batches, stage, word_hashes


@dataclass(frozen=True)
class OrderMinHashConfig:
    k: int = 5
    #: k-mers of a sketch: two texts with i of u k-mers in common share one with probability C(i, l) / C(u, l).
    l: int = 5
    #: Sketches: at i / u = 0.8 all of them miss a pair of long texts with probability 0.008, which the word pairs
    #: below hardly ever miss then.
    sketches: int = 12
    #: Pairs of texts of up to so many words are found without fail. At 14 a text has up to 91 such buckets.
    exact_words: int = 14
    #: Texts of up to so many words have as many sketches of ``short_l`` words again in each of two bands.
    #: At 12 of 18 words in common (15 words, 3 replaced) all of them miss a pair with probability 8e-5.
    short_words: int = 40
    short_l: int = 3
    short_sketches: int = 30
    #: Sketches of word pairs for texts over ``short_words`` words and those similar to them. With a fifth of the
    #: words moved, or deleted and as many put in elsewhere, two texts share 0.51 / 1.49 of their pairs, and all
    #: of these sketches miss them with probability 0.04; with a fifth replaced, 0.0002.
    loose_k: int = 2
    loose_l: int = 3
    loose_sketches: int = 80
    similarity: float = 0.8
    #: Rounds of alignment with representatives before what is left is aligned pair by pair.
    rounds: int = 2
    #: Cells to which a text's labelled words are dealt, a multiple of 64. A bit tells whether a cell
    #: has an odd number of them; by these bits unlike pairs are told before they are aligned.
    cells: int = 2048


#: Hashes that are ranked at once, and rows of a batch that a worker holds the words of.
MOST_RANKS, WORKER_ROWS = 1_000_000, 500


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the windows of ``k`` word hashes; of all words if there are fewer."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def occurrences(kmer: np.ndarray) -> np.ndarray:
    """How many equal k-mers stand before each."""
    order = np.argsort(kmer, kind="stable")
    ordered = kmer[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    starts = np.flatnonzero(first)
    out = np.empty(len(kmer), np.uint64)
    out[order] = np.arange(len(kmer)) - np.repeat(starts, np.diff(np.r_[starts, len(kmer)]))
    return out


def with_occurrence(items: np.ndarray) -> np.ndarray:
    """Hash of each item and its occurrence number."""
    return mix(items + occurrences(items) * np.uint64(0xD1B54A32D192ED03)) if len(items) else items


def order_sketches(kmer: np.ndarray, config: OrderMinHashConfig) -> np.ndarray:
    """One number for each sketch: its smallest labelled k-mers in text order."""
    labelled = with_occurrence(kmer)
    every = mix(np.arange(1, config.sketches + 1, dtype=np.uint64))
    some = max(1, MOST_RANKS // max(1, len(kmer)))
    return np.concatenate([_sketches(labelled, every[i : i + some], config.l) for i in range(0, len(every), some)])


def _sketches(labelled: np.ndarray, seeds: np.ndarray, l: int) -> np.ndarray:
    ranks = (labelled[None, :] ^ seeds[:, None]) * np.uint64(0x9FB21C651E98DF25)
    ranks ^= ranks >> np.uint64(32)
    if len(labelled) > l:
        chosen, row = np.empty((len(seeds), l), np.int64), np.arange(len(seeds))
        for i in range(l):  # few are wanted, so that many least ones are faster than a partition
            chosen[:, i] = ranks.argmin(1)
            ranks[row, chosen[:, i]] = np.uint64(2**64 - 1)
        chosen.sort(axis=1)
    else:
        chosen = np.broadcast_to(np.arange(len(labelled)), (len(seeds), len(labelled)))
    out = seeds.copy()
    for column in chosen.T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + labelled[column])
    return out


def least_matches(longer: int, similarity: float) -> int:
    """Words that a similar pair has in common if its longer text has ``longer``."""
    return int(np.ceil(similarity * longer - 1e-9))


@functools.cache
def choices(n: int, size: int) -> np.ndarray:
    """All ways to choose ``size`` of ``n`` places, in order; made once in a worker process."""
    return np.array(list(itertools.combinations(range(n), size)), np.int64)


def exact_keys(words: np.ndarray, config: OrderMinHashConfig) -> np.ndarray:
    """Hashes of the word sequences that a similar text of ``exact_words`` words or fewer may share.

    Texts of n and m >= n words are similar if they share a sequence of least_matches(m) words, so
    each takes all its sequences of that length for every m from its own count up. Sequences of a
    length that suffices for m also suffice for fewer words: all texts of a bucket are similar.
    """
    n = len(words)
    found = []
    for size in {least_matches(m, config.similarity) for m in range(n, config.exact_words + 1)}:
        if 0 < size <= n:
            out = np.full(math.comb(n, size), size, np.uint64)
            for places in choices(n, size).T:
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[places])
            found.append(out)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def short_sketches(words: np.ndarray, config: OrderMinHashConfig) -> np.ndarray:
    """Sketches of single words under the text's band of length and the next; similar texts share one of the two."""
    sketches = order_sketches(words, replace(config, l=config.short_l, sketches=config.short_sketches))
    band = math.floor(math.log(len(words)) / math.log(1 / config.similarity))
    return np.concatenate([mix(sketches * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b)) for b in (band + 1, band + 2)])


def text_buckets(words: np.ndarray, config: OrderMinHashConfig) -> np.ndarray:
    """All buckets of a text; none without words."""
    if not len(words):
        return np.empty(0, np.int64)
    found = [order_sketches(kmers(words, config.k), config)]
    if len(words) <= config.exact_words:
        found.append(exact_keys(words, config))
    # A pair with a longer text than exact_words may have a shorter one below it.
    if least_matches(config.exact_words + 1, config.similarity) <= len(words) <= config.short_words:
        found.append(short_sketches(words, config))
    if len(words) >= least_matches(config.short_words + 1, config.similarity):
        loose = replace(config, l=config.loose_l, sketches=config.loose_sketches)
        found.append(mix(order_sketches(kmers(words, config.loose_k), loose)))
    return np.unique(np.concatenate(found)).astype(np.int64)


def banded_match(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Longest common subsequence of two word sequences within the band that ``least`` matches need.

    Bit-parallel: bit j of ``row`` is 0 where the count grows at the j-th place of the band. With
    ``least`` matches or more the alignment leaves the diagonal by the unmatched words at most, so
    the band holds it and the count is exact; otherwise the count is below ``least``.
    """
    if min(len(a), len(b)) < least:
        return 0
    left, right = len(a) - least, len(b) - least
    width = left + right + 1
    full = (1 << width) - 1
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << (j + left)
    # The band of row i covers the columns i - left to i + right; columns before 0 never match.
    row, passed = full, 0
    for i, x in enumerate(a.tolist()):
        if i:
            passed += not row & 1
            row = row >> 1 | 1 << (width - 1)
        matches = places.get(x, 0) >> i & full
        if matches:
            kept = row & matches
            row = (row + kept | row & ~matches) & full
    return passed + width - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the words matched in order / the longer text's words reach ``similarity``."""
    longer = max(len(a), len(b))
    if not longer:
        return False
    least = least_matches(longer, similarity)
    if min(len(a), len(b)) < least or len(np.intersect1d(with_occurrence(a), with_occurrence(b), assume_unique=True)) < least:
        return False  # not even without order
    return banded_match(a, b, least) >= least


def odd_cells(words: np.ndarray, cells: int) -> np.ndarray:
    """Bits of the cells that hold an odd number of the labelled words, 64 to a number.

    A labelled word that one text has and the other lacks flips one bit, so two texts differ in as
    many bits as they have unmatched words, or fewer.
    """
    odd = np.bincount((with_occurrence(words) % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_texts(docs: DataFrame, config: OrderMinHashConfig) -> DataFrame:
    """Rows (doc_id, text_key, n_words, buckets, cells), one for each document; copies have equal ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_word = letter_or_digit_table()
        for pdf in batches:
            for i in range(0, len(pdf), WORKER_ROWS):
                part = pdf.iloc[i : i + WORKER_ROWS]
                words = [word_hashes(t.lower(), is_word) for t in part["text"]]
                buckets = [text_buckets(w, config) for w in words]
                cells = [odd_cells(w, config.cells) for w in words]
                yield pd.DataFrame({"doc_id": part["doc_id"], "text_key": part["text_key"], "n_words": [len(w) for w in words], "buckets": buckets, "cells": cells})

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    return rows.mapInPandas(run, "doc_id long, text_key binary, n_words int, buckets array<long>, cells array<long>")


def aligned(pairs: DataFrame, texts: DataFrame, config: OrderMinHashConfig) -> DataFrame:
    """The pairs (a, b) of text keys whose texts are similar."""

    @F.pandas_udf("boolean")
    def verify(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        is_word = letter_or_digit_table()
        for left, right in columns:
            found: list[bool] = []
            for i in range(0, len(left), WORKER_ROWS):
                a, b = left.iloc[i : i + WORKER_ROWS], right.iloc[i : i + WORKER_ROWS]
                words = {t: word_hashes(t.lower(), is_word) for t in {*a, *b}}
                found += [similar(words[x], words[y], config.similarity) for x, y in zip(a, b)]
            yield pd.Series(found, dtype=bool)

    named = lambda side: texts.select(F.col("text_key").alias(side), F.col("text").alias(f"text_{side}"))
    both = pairs.join(named("b"), "b").join(named("a"), "a")
    return both.where(verify("text_a", "text_b")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for the nodes of the edges (a, b): the smallest node that each reaches.

    Every round a node takes the smallest label among its neighbours' and its own, then the label
    of that label; labels only fall, and a round that changes none is the last.
    """
    both = stage(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("label"))
    labels = stage(labels, "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jumps = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        fresh = stage(lower.join(jumps, "label").select("node", "old", F.least("jump", "label").alias("label")), "labels")
        done = fresh.where("label <> old").isEmpty()
        discard(labels)
        labels = fresh
        if done:
            discard(both)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (text_key, label) after the classes that ``links`` connect become one."""
    of = lambda side: labels.select(F.col("text_key").alias(side), F.col("label").alias(f"label_{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b")
    found = components(edges)
    roots = found.select(F.col("node").alias("label"), F.col("label").alias("root"))
    out = stage(labels.join(roots, "label", "left").select("text_key", F.coalesce("root", "label").alias("label")), "classes")
    discard(found, labels)
    return out


def may_be_similar(x: Callable[[str], Column], y: Callable[[str], Column], config: OrderMinHashConfig) -> Column:
    """Whether n_words and cells of two texts allow that they are similar; true of all similar pairs."""
    longer, shorter = F.greatest(x("n_words"), y("n_words")), F.least(x("n_words"), y("n_words"))
    least = F.ceil(longer * F.lit(config.similarity) - 1e-9)
    differ = F.aggregate(F.zip_with(x("cells"), y("cells"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)
    return (shorter >= least) & (differ <= longer + shorter - 2 * least)


def head_pairs(placed: DataFrame, round_: int) -> DataFrame:
    """Pairs (x, y) of a bucket's representative x and its members y of other classes. In the first
    round a member meets the first of its buckets' representatives only: most classes form there."""
    chosen = F.struct(F.xxhash64("text_key", F.lit(round_)).alias("order"), "text_key", "label")
    heads = placed.groupBy("bucket").agg(F.min(chosen).alias("head"))
    met = placed.join(heads, "bucket").where(F.col("label") != F.col("head.label"))
    if round_ == 0:
        met = met.groupBy("text_key").agg(F.min("head").alias("head"))
    return met.select(F.col("head.text_key").alias("x"), F.col("text_key").alias("y"))


def possible_pairs(pairs: DataFrame, shapes: DataFrame, config: OrderMinHashConfig) -> DataFrame:
    """The pairs (a, b) of text keys that may be similar."""
    side = lambda s: shapes.select(F.col("text_key").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n_words", "cells")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(may_be_similar(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), config)).select("a", "b")


def cross_pairs(placed: DataFrame, shapes: DataFrame, config: OrderMinHashConfig) -> DataFrame:
    """Pairs (x, y) of different classes that still share a bucket and may be similar. A pair is made
    once, at its smallest common bucket."""
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    left = placed.join(mixed, "bucket")
    met = left.groupBy("text_key").agg(F.collect_set("bucket").alias("buckets")).join(shapes, "text_key")  # a few dozen each
    left = left.join(met, "text_key")
    side = lambda s: left.select("bucket", *[F.col(c).alias(f"{s}_{c}") for c in ("text_key", "label", "n_words", "cells", "buckets")])
    possible = (F.col("x_label") < F.col("y_label")) & may_be_similar(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"), config)
    possible = possible & (F.array_min(F.array_intersect("x_buckets", "y_buckets")) == F.col("bucket"))
    return side("x").join(side("y"), "bucket").where(possible).select(F.col("x_text_key").alias("x"), F.col("y_text_key").alias("y"))


def near_duplicates(docs: DataFrame, config: OrderMinHashConfig = OrderMinHashConfig()) -> DataFrame:
    """One row for each document: doc_id, text_key, label (its class by key), class_id (its class by
    smallest doc_id) and class_size (its documents)."""
    small_batches(docs.sparkSession)
    sketched = stage(sketch_texts(docs, config), "sketches")
    once = sketched.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    # Dealt by bucket once, for the counts and for what is kept.
    sketches = sketched.groupBy("text_key").agg(F.first("buckets").alias("buckets"))
    buckets = sketches.select("text_key", F.explode("buckets").alias("bucket")).repartition("bucket")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stage(buckets.join(shared, "bucket"), "buckets")
    nodes = members.select("text_key").distinct()
    shapes = sketched.select("text_key", "n_words", "cells").join(nodes, "text_key", "left_semi").dropDuplicates(["text_key"])
    shapes = stage(shapes, "shapes")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.unhex(F.md5(text)).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    wanted = nodes.join(once.select("text_key", "first"), "text_key")
    texts = texts.join(wanted, "text_key").where(F.col("doc_id").eqNullSafe(F.col("first")))
    texts = stage(texts.select("text_key", "text").dropDuplicates(["text_key"]), "candidate-texts")

    labels, tried, done = nodes.select("text_key", F.col("text_key").alias("label")), None, [members, shapes, texts]
    for round_ in range(config.rounds + 1):
        placed = members.join(labels, "text_key")
        last = round_ == config.rounds
        pairs = cross_pairs(placed, shapes, config) if last else head_pairs(placed, round_)
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        if not last:
            pairs = possible_pairs(pairs, shapes, config)
        pairs = stage(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        links = stage(aligned(pairs, texts, config), "links")
        done += [pairs, links]
        if not links.isEmpty():
            labels = merged(labels, links)

    labels = stage(labels, "labels")
    discard(*done)
    named = once.join(labels, "text_key", "left").select("text_key", "first", "copies", F.coalesce("label", "text_key").alias("label"))
    classes = named.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(classes, "label").select("text_key", "label", "class_id", "class_size")
    return sketched.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "text_key", "label", "class_id", "class_size")


def first_of_class(docs: DataFrame, config: OrderMinHashConfig = OrderMinHashConfig()) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest ``doc_id``, null last."""
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    kept = near_duplicates(docs, config).groupBy("label").agg(F.min(order).alias("kept")).select(F.col("kept.text_key").alias("text_key"), F.col("kept.doc_id").alias("kept_id"))
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("text_key"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.join(kept, "text_key").where(F.col("id").eqNullSafe(F.col("kept_id"))).dropDuplicates(["text_key", "id"])
    return rows.select("doc.*")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
