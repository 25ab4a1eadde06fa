"""Quality rules by n-gram perplexity.

Spark counts the character 5-grams of every document, by language, and estimates an interpolated
modified Kneser-Ney model of orders 1 to 5 by grouping and joining the counts. Each language has a
lower and an upper band of log perplexity around the median of its own documents; documents outside
are rejected.

A document is never scored by counts of its own: documents fall in two folds by a hash of their
text, copies in the same one, and each fold is scored by the model of the other.

A gram is five code points of 21 bits in two numbers, so contexts and suffixes are shifts and masks
and every character is told apart. The model is stored as sorted arrays: for each language, fold
and order the 64-bit hashes of its grams beside log probabilities, and of its contexts beside
back-off weights. Only grams and contexts that occur in the fold to be scored can be looked up, so
the others are left out, which changes no score; grams of a single document are among these.

Languages are scored in blocks of up to ``block_grams`` entries, broadcast one after the other; a
language is never split, so an executor must hold the largest one (12 bytes an entry) and results
are the same whatever the blocks.

Defined results: a null text has no words and fails the base rules; a document without characters
has perplexity 1. A null language is a language named by the empty string. Every language, however small, has a
model and bands of its own; the fewer documents it has, the wider its bands, as its model and its median are less
certain. Where all documents of a language fall in one fold, each character has the probability 2 ** -21. Repeated rows count and score each. Extra
columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, mix, read_table, stage

ORDER = 5
BITS = 21
CHARACTER = (1 << BITS) - 1
START, END = 1, 2
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WORD = re.compile(WORD_PATTERN)
#: Characters of texts that are counted, or scored, together.
COUNT_CHARS, SCORE_CHARS = 1_000_000, 500_000
#: Bits of a character's number among those of a chunk.
SHORT_BITS = 12


@dataclass(frozen=True)
class PerplexityConfig:
    #: Documents of a language from which on its bands hardly widen for want of documents.
    enough_documents: int = 200
    #: Entries of the arrays of all languages that are broadcast at once, unless one alone has more.
    block_grams: int = 6_000_000
    #: Bands: so many scaled median absolute deviations below and above the median, and at least
    #: so far from it in log perplexity.
    lower_deviations: float = 6.0
    upper_deviations: float = 5.0
    least_distance: float = 0.12
    #: Base rules.
    least_words: int = 50
    most_repeated_percent: int = 50


def characters(text: str) -> np.ndarray:
    """Code points of the folded text: lower case, white space runs as one space, digits alike."""
    cp = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cp[(cp >= 48) & (cp <= 57)] = 48
    cp[cp <= END] = 3
    return cp


Grams = tuple[np.ndarray, np.ndarray]


def suffix(grams: Grams, order: int) -> Grams:
    """The last ``order`` characters: up to three in the second number, the others in the first."""
    high, low = grams
    return high & ((1 << BITS * max(0, order - 3)) - 1), low & ((1 << BITS * min(3, order)) - 1)


def context(grams: Grams) -> Grams:
    """All characters but the last."""
    high, low = grams
    return high >> BITS, low >> BITS | (high & CHARACTER) << 2 * BITS


def keys_of(grams: Grams) -> np.ndarray:
    high, low = (x.astype(np.uint64) for x in grams)
    return mix(mix(high) + low)


def code_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in order, each after starts and before an end, and the number of grams of
    each text; a text has a gram for each character and one for its end."""
    parts, sizes = [np.empty(0, np.int64)], []
    for t in texts:
        c = characters(t) if t else np.empty(0, np.int64)
        parts += [np.full(ORDER - 1, START), c, np.array([END])] if len(c) else []
        sizes.append(len(c) + 1 if len(c) else 0)
    return np.concatenate(parts), np.array(sizes)


def packed(codes: list[np.ndarray]) -> Grams:
    a, b, c, d, e = codes
    return a << BITS | b, c << 2 * BITS | d << BITS | e


def windows(codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The five columns of all windows, and which of these are grams: those that don't end in a start."""
    n = max(0, len(codes) - ORDER + 1)
    return [codes[k : k + n] for k in range(ORDER)], codes[ORDER - 1 :][:n] != START


def gram_stream(texts: list[str]) -> tuple[Grams, np.ndarray]:
    """Grams of all texts in order and the number of grams of each."""
    codes, sizes = code_stream(texts)
    columns, is_gram = windows(codes)
    high, low = packed(columns)
    return (high[is_gram], low[is_gram]), sizes


def distinct_grams(texts: list[str], inverse: bool) -> tuple[Grams, np.ndarray, np.ndarray]:
    """The different grams of all texts, for each gram in order its number among these or, without
    ``inverse``, for each different gram its count, and the number of grams of each text.

    A chunk has few different characters, so a gram of their numbers fits one integer and sorts fast.
    """
    codes, sizes = code_stream(texts)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    wanted = {"return_inverse": True} if inverse else {"return_counts": True}
    if len(alphabet) > 1 << SHORT_BITS:
        columns, is_gram = windows(codes)
        high, low = packed(columns)
        high, low = high[is_gram], low[is_gram]
        _, at, more = np.unique(keys_of((high, low)), return_index=True, **wanted)
        return (high[at], low[at]), more, sizes
    number = np.zeros(0x110000, np.int16)
    number[alphabet] = np.arange(len(alphabet))
    columns, is_gram = windows(number[codes].astype(np.int64))
    short = np.zeros(len(is_gram), np.int64)
    for column in columns:
        short <<= SHORT_BITS
        short |= column
    short, more = np.unique(short[codes[ORDER - 1 :][: len(is_gram)] != START], **wanted)
    return packed([alphabet[short >> SHORT_BITS * (ORDER - 1 - k) & ((1 << SHORT_BITS) - 1)] for k in range(ORDER)]), more, sizes


def chunks(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def language_of() -> Column:
    """Column with the name under which a document's language is modelled."""
    return F.coalesce("lang", F.lit(""))


FOLDS = (0, 1)
GRAM = ["lang", "high", "low"]


def count_grams(texts: DataFrame) -> DataFrame:
    """Rows (lang, high, low, n0, n1) with a gram's counts in both folds, from rows (lang, fold, text),
    summed in each batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (lang, fold), part in pdf.groupby(["lang", "fold"]):
                rows = part["text"].fillna("").tolist()
                for a, b in chunks(rows, COUNT_CHARS):
                    grams, n, _ = distinct_grams(rows[a:b], inverse=False)
                    yield pd.DataFrame({"lang": lang, "high": grams[0], "low": grams[1], "n0": n * (fold == 0), "n1": n * (fold == 1)})

    counted = texts.mapInPandas(run, "lang string, high long, low long, n0 long, n1 long")
    return counted.groupBy(*GRAM).agg(*[F.sum(f"n{f}").alias(f"n{f}") for f in FOLDS])


def suffix_columns(order: int) -> list[Column]:
    return [F.col("high").bitwiseAND((1 << BITS * max(0, order - 3)) - 1).alias("high"), F.col("low").bitwiseAND((1 << BITS * min(3, order)) - 1).alias("low")]


def context_columns() -> list[Column]:
    low = F.shiftright("low", BITS).bitwiseOR(F.shiftleft(F.col("high").bitwiseAND(CHARACTER), 2 * BITS))
    return [F.shiftright("high", BITS).alias("high"), low.alias("low")]


def discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of one order, a row for each language with those of both folds."""
    n = counts.groupBy("lang").agg(*[F.count_if(F.col(f"n{f}") == i).cast("double").alias(f"n{f}_{i}") for f in FOLDS for i in (1, 2, 3, 4)])

    def discount(f: int, i: int) -> Column:
        of = lambda k: F.col(f"n{f}_{k}")
        y = F.when(of(1) > 0, of(1) / (of(1) + 2 * of(2))).otherwise(F.lit(0.5))
        value = F.lit(float(i)) - (i + 1) * y * of(i + 1) / F.when(of(i) > 0, of(i))
        return F.least(F.greatest(F.coalesce(value, F.lit(0.5)), F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{f}_{i}")

    return n.select("lang", *[discount(f, i) for f in FOLDS for i in (1, 2, 3)])


def in_both(a: str, b: str) -> Column:
    return (F.col(a) > 0) & (F.col(b) > 0)


def kneser_ney(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Tables (lang, high, low, p0, p1) of orders 1 to ORDER and (lang, high, low, b0, b1) of contexts of 1 to
    ORDER - 1 characters, both less what isn't in both folds, and rows (lang, p0, p1) for a character
    never seen, from the counts (lang, high, low, n0, n1) of the highest order. A number at the end of a
    name is the fold whose counts it is made of.

    ``n`` of a lower order is the number of distinct characters seen before the gram. A back-off
    weight is that of the lower order after a context.
    """
    by_order = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        longer = by_order[order + 1].groupBy("lang", *suffix_columns(order))
        by_order[order] = stage(longer.agg(*[F.count_if(F.col(f"n{f}") > 0).alias(f"n{f}") for f in FOLDS]), f"grams-{order}")
    tables: list[DataFrame] = []
    backoffs: list[DataFrame] = []
    unseen = None
    for order in range(1, ORDER + 1):
        t = by_order[order].join(F.broadcast(discounts(by_order[order])), "lang")  # a row a language
        n = [F.col(f"n{f}") for f in FOLDS]
        d = [F.when(n[f] == 0, 0.0).when(n[f] == 1, F.col(f"d{f}_1")).when(n[f] == 2, F.col(f"d{f}_2")).otherwise(F.col(f"d{f}_3")).alias(f"d{f}") for f in FOLDS]
        before = [c.alias(f"c_{name}") for c, name in zip(context_columns(), ("high", "low"))]
        t = t.select(*GRAM, "n0", "n1", *d, *before)
        sums = [F.sum(f"{x}{f}").alias(f"{y}{f}") for f in FOLDS for x, y in (("n", "total"), ("d", "kept"))]
        kinds = [F.count_if(F.col(f"n{f}") > 0).alias(f"kinds{f}") for f in FOLDS]
        weights = stage(t.groupBy("lang", "c_high", "c_low").agg(*sums, *kinds).where(in_both("total0", "total1") if order > 1 else F.lit(True)), f"weights-{order}")
        t = t.where(in_both("n0", "n1")).join(weights, ["lang", "c_high", "c_low"])
        own, left = ([(F.col(f"n{f}") - F.col(f"d{f}")) / F.col(f"total{f}") for f in FOLDS], [F.col(f"kept{f}") / F.col(f"total{f}") for f in FOLDS])
        if order == 1:
            each = [F.try_divide(F.col(f"kept{f}"), F.col(f"total{f}")) / (F.col(f"kinds{f}") + 1) for f in FOLDS]
            t = t.select(*GRAM, *[(own[f] + each[f]).alias(f"p{f}") for f in FOLDS])
            unseen = weights.select("lang", *[each[f].alias(f"p{f}") for f in FOLDS])
        else:
            shorter = [c.alias(f"s_{name}") for c, name in zip(suffix_columns(order - 1), ("high", "low"))]
            lower = tables[-1].select("lang", F.col("high").alias("s_high"), F.col("low").alias("s_low"), *[F.col(f"p{f}").alias(f"lower{f}") for f in FOLDS])
            t = t.select("*", *shorter).join(lower, ["lang", "s_high", "s_low"])
            t = t.select(*GRAM, *[(own[f] + left[f] * F.col(f"lower{f}")).alias(f"p{f}") for f in FOLDS])
            backoffs.append(weights.select("lang", F.col("c_high").alias("high"), F.col("c_low").alias("low"), *[left[f].alias(f"b{f}") for f in FOLDS]))
        tables.append(stage(t, f"order-{order}"))
    return tables, backoffs, unseen


ENTRIES = "lang string, part int, key long, value float"


def entries(counts: DataFrame) -> DataFrame:
    """Rows (lang, part, key, value) of all arrays from ``counts`` (lang, high, low, n0, n1).

    ``part`` is the number of arrays of a model times the fold that it scores, plus the array's slot.
    Slots 0 to ORDER - 1 are log probabilities by order, the next ones back-off weights by length of
    context, the last one a character never seen. The model of a fold is that of the other fold's counts.
    """
    tables, backoffs, unseen = kneser_ney(counts)
    lone = unseen.select("lang", F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"), *[F.col(f"p{f}") for f in FOLDS])
    slots = [(t, "p") for t in tables] + [(t, "b") for t in backoffs] + [(lone, "p")]
    parts = [t.select(*GRAM, F.lit(slot).alias("slot"), *[F.col(f"{x}{f}").alias(f"x{f}") for f in FOLDS]) for slot, (t, x) in enumerate(slots)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = keys_of((pdf["high"].to_numpy(), pdf["low"].to_numpy())).view(np.int64)
            for fold in FOLDS:
                made = pd.DataFrame({"lang": pdf["lang"], "part": pdf["slot"] + 2 * ORDER * fold, "key": keys, "value": np.log(pdf[f"x{1 - fold}"]).astype(np.float32)})
                yield made[made["value"].notna()]

    return functools.reduce(DataFrame.union, parts).mapInPandas(run, ENTRIES)


NO_ENTRIES = (np.empty(0, np.int64), np.empty(0, np.float32))


class SortedArrays:
    """A model: for each slot a sorted array of hashes and one of values."""

    def __init__(self, slots: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.slots = slots

    def find(self, slot: int, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Values of the grams in a slot, and which of them it has."""
        keys, values = self.slots.get(slot, NO_ENTRIES)
        wanted = keys_of(grams).view(np.int64)
        if not len(keys):
            return np.zeros(len(wanted), np.float32), np.zeros(len(wanted), bool)
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return values[at], keys[at] == wanted

    def log_probabilities(self, grams: Grams) -> np.ndarray:
        """Longest order first; what an order lacks backs off, weighted by its context."""
        n = len(grams[0])
        out, left, weight = np.zeros(n), np.arange(n), np.zeros(n)
        for order in range(ORDER, 0, -1):
            part = suffix((grams[0][left], grams[1][left]), order)
            values, hit = self.find(order - 1, part)
            out[left[hit]] = values[hit] + weight[left[hit]]
            left, part = left[~hit], (part[0][~hit], part[1][~hit])
            if not len(left):
                break
            if order > 1:
                values, hit = self.find(ORDER + order - 2, context(part))
                weight[left[hit]] += values[hit]
        unseen = self.slots.get(2 * ORDER - 1)
        out[left] = weight[left] + (unseen[1][0] if unseen else -BITS * np.log(2.0))
        return out


def sorted_arrays(rows: DataFrame) -> dict[str, SortedArrays]:
    """The entries as arrays on the driver, by language and fold."""
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return {}
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    found = rows.select((number * 4 * ORDER + F.col("part")).alias("place"), "key", "value").toArrow()
    place, key, value = (found[c].to_numpy() for c in ("place", "key", "value"))
    del found
    order = np.lexsort((key, place))
    place, key, value = place[order], key[order], value[order]
    ends = np.searchsorted(place, np.arange(4 * ORDER * len(langs) + 1))
    models: dict[str, dict] = {}
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        if b > a:
            models.setdefault(f"{langs[i // (4 * ORDER)]}/{i // (2 * ORDER) % 2}", {})[i % (2 * ORDER)] = (key[a:b], value[a:b])
    return {name: SortedArrays(slots) for name, slots in models.items()}


def blocks(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Languages in order, as many at a time as have ``most`` entries together, one at least."""
    found: list[list[str]] = []
    room = 0
    for lang in sorted(sizes):
        if not found or sizes[lang] > room:
            found.append([])
            room = most
        found[-1].append(lang)
        room -= sizes[lang]
    return found


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text)
    size = len(words)
    seen: dict[str, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, range(size)), np.int64, size)  # a word's first place
    repeated = 0
    if size > 3:
        pair = ids[:-1] * size + ids[1:]
        if size >= 2_000_000:  # three places don't fit one number
            _, pair = np.unique(pair, return_inverse=True)
        _, window, n = np.unique(pair[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
        again = n[window] > 1
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeated = int(covered.sum())
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, log_sum double"


def measure(texts: DataFrame, models: dict[str, SortedArrays]) -> DataFrame:
    """Rows (doc_id, lang, measures) from rows (doc_id, lang, fold, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            rows = pdf["text"].fillna("").tolist()
            out = pd.DataFrame([base_measures(t) for t in rows], columns=[c.split()[0] for c in MEASURES.split(", ")][:5])
            n_grams, log_sum = np.zeros(len(rows), np.int64), np.zeros(len(rows))
            for (lang, fold), part in pdf.groupby(["lang", "fold"]):
                model = shared.value.get(f"{lang}/{fold}") or SortedArrays({})
                at = part.index.to_numpy()
                mine = [rows[i] for i in at]
                for a, b in chunks(mine, SCORE_CHARS):
                    grams, number, sizes = distinct_grams(mine[a:b], inverse=True)
                    n_grams[at[a:b]] = sizes
                    ends = sizes.cumsum()
                    sums = np.append(0.0, model.log_probabilities(grams)[number].cumsum())
                    log_sum[at[a:b]] = sums[ends] - sums[ends - sizes]
            out["n_grams"], out["log_sum"] = n_grams, log_sum
            out.insert(0, "doc_id", pdf["doc_id"].array)
            out.insert(1, "lang", pdf["lang"].array)
            yield out

    return texts.mapInPandas(run, f"doc_id long, lang string, {MEASURES}")


def bands(measured: DataFrame, config: PerplexityConfig) -> DataFrame:
    """Rows (lang, lower, upper) from a histogram of log perplexity in steps of a thousandth.

    Widths grow by the square root of one more than ``enough_documents`` over the language's documents.
    """
    known = measured.where((F.col("n_words") >= config.least_words) & F.col("log_ppl").isNotNull())
    steps = known.groupBy("lang", F.round(F.col("log_ppl") * 1000).cast("long").alias("step")).count()

    def middle(histogram: DataFrame, value: str) -> DataFrame:
        up_to = F.sum("count").over(Window.partitionBy("lang").orderBy(value))
        whole = F.sum("count").over(Window.partitionBy("lang"))
        return histogram.withColumn("half", up_to * 2 >= whole).where("half").groupBy("lang").agg(F.min(value).alias("middle"))

    centre = middle(steps, "step")
    away = steps.join(centre, "lang").withColumn("away", F.abs(F.col("step") - F.col("middle")))
    spread = middle(away.groupBy("lang", "away").agg(F.sum("count").alias("count")), "away").withColumnRenamed("middle", "spread")
    n = steps.groupBy("lang").agg(F.sum("count").alias("n"))
    width = lambda k: F.greatest(1.4826 * k * F.col("spread") / 1000, F.lit(config.least_distance)) * F.sqrt(1 + config.enough_documents / F.col("n"))
    both = centre.join(spread, "lang").join(n, "lang")
    return both.select("lang", (F.col("middle") / 1000 - width(config.lower_deviations)).alias("lower"), (F.col("middle") / 1000 + width(config.upper_deviations)).alias("upper"))


def judge(docs: DataFrame, config: PerplexityConfig = PerplexityConfig()) -> DataFrame:
    """One row for each document: base measures, log perplexity a character, bands and verdict."""
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language_of().alias("lang"), fold.alias("fold"), "text")
    arrays = stage(entries(stage(count_grams(texts.select("lang", "fold", "text")), "grams")), "model")
    sizes = {r["lang"]: 0 for r in texts.select("lang").distinct().collect()}
    sizes |= {r["lang"]: r["n"] for r in arrays.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    parts = []
    for langs in blocks(sizes, config.block_grams) or [[""]]:
        models = sorted_arrays(arrays.where(F.col("lang").isin(langs)))
        parts.append(stage(measure(texts.where(F.col("lang").isin(langs)), models), "measures"))
    measured = functools.reduce(DataFrame.union, parts)
    measured = measured.withColumn("log_ppl", F.when(F.col("n_grams") == 0, F.lit(0.0)).otherwise(-F.col("log_sum") / F.col("n_grams"))).drop("log_sum")
    found = measured.join(F.broadcast(bands(measured, config)), "lang", "left")  # a row a language
    failed = (F.col("n_words") < config.least_words) | (100 * F.col("n_repeat_words") > config.most_repeated_percent * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), "log_ppl", "lower", "upper")


def op1_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))
