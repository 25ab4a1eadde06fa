"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Which lengths share a sequence is decided
on the histogram of lengths, which has at most ``capacity`` rows whatever the corpus: for the
longest length left, bitset subset-sum dynamic programming over the available lengths finds the
fullest feasible combination, which is removed as often as its lengths last. Pieces then take the
slots of their length in a fixed order, numbered by distributed prefix sums.

Defined results: a null or empty text is one piece, the closing id alone. Each row of repeated
rows is packed on its own. Ties in the order of pieces go to equal rows only. An empty table gives
no rows. Special-token strings in a text get the ids that the tokenizer gives them. Extra columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, read_table, root_buckets, small_batches, stage

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackConfig:
    capacity: int = 2048
    #: Id that closes every document.
    end_id: int = 0
    #: Tokenizer file; None is the public byte-level BPE of 50k entries.
    tokenizer_path: str | None = None
    #: Words whose ids a worker process remembers, about 200 bytes each: the first ones it meets.
    cache_words: int = 900_000


@dataclass(frozen=True)
class Pattern:
    """``repeats`` sequences, each holding ``slots``: (length, pieces of that length)."""

    slots: tuple[tuple[int, int], ...]
    repeats: int


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """Pieces by length whose sum is the largest that ``room`` holds.

    Bit t of ``reach`` tells that some combination sums to t; each group of equal lengths is added
    in powers of two, and the states before are kept to walk back from the best sum.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, group = min(available[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(group, left)
            more = (reach | reach << take * length) & mask
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left -= take
            group *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * length
            used[length] = used.get(length, 0) + take
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    left = {length: n for length, n in histogram.items() if n > 0}
    patterns = []
    while left:
        seed = max(left)
        rest = {x: n - (x == seed) for x, n in left.items() if n > (x == seed)}
        slots = fullest(rest, capacity - seed)
        slots[seed] = slots.get(seed, 0) + 1
        repeats = min(left[x] // n for x, n in slots.items())
        patterns.append(Pattern(tuple(sorted(slots.items(), reverse=True)), repeats))
        for x, n in slots.items():
            left[x] -= n * repeats
            if not left[x]:
                del left[x]
    return patterns


def slot_table(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: rows (first number in its length, pieces in a sequence, first sequence, offset)."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for length, n in p.slots:
            rows.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * p.repeats
            offset += n * length
        sequence += p.repeats
    return {length: np.array(x, np.int64) for length, x in rows.items()}


#: Words that a worker process has encoded, with their ids as bytes; kept from task to task.
_KNOWN: dict[tuple[str | None, bool], dict[str, bytes]] = {}
#: Texts whose words are looked up together.
TEXTS = 200
#: White space other than the space and the line end.
_OTHER_SPACE = re.compile(r"[^\S \n]")
_ADJACENT = ("  ", " \n", "\n ", "\n\n")


def _plainly_spaced(text: str) -> bool:
    """Whether every white space is a space or line end between two characters that aren't."""
    return not (text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _ADJACENT) or _OTHER_SPACE.search(text))


def splits_before_spaces(tokenizer: Any) -> bool:
    """Whether the tokenizer's one step before merging is the byte-level split, which ``encoder`` relies on."""
    told = json.loads(tokenizer.to_str())
    split = told.get("pre_tokenizer") or {}
    plain = told.get("normalizer") is None and told.get("truncation") is None and told.get("padding") is None
    return plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


def encoder(config: PackConfig) -> Callable[[list[str]], list[bytes]]:
    """Function from texts to their ids as little-endian unsigned 32-bit numbers.

    The tokenizer splits texts before it merges: a space alone between two other characters goes
    with the word after it, a line end alone is by itself, and so is a comma or full stop after a
    letter. Such words have ids of their own, and a word seen before isn't encoded again. Texts
    with other spacing or with a special token's string are encoded whole, and so is everything if
    the tokenizer splits in another way.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = config.tokenizer_path
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    by_word, special = splits_before_spaces(tokenizer), [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    leading, inner = _KNOWN.setdefault((path, True), {}), _KNOWN.setdefault((path, False), {})

    def ids_of(texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not by_word:
        return ids_of
    line_end, comma, stop = ids_of(["\n", ",", "."])
    marks = {",": comma, ".": stop}

    def fresh(words: list[str], prefix: str) -> dict[str, bytes]:
        """Ids of each word, encoded in one text with a line end after each."""
        ids = np.frombuffer(ids_of(["".join([f"{prefix}{w}\n" for w in words])])[0], "<u4")
        ends = np.flatnonzero(ids == int.from_bytes(line_end, "little"))
        if len(ends) != len(words):
            return dict(zip(words, ids_of([prefix + w for w in words])))
        return {w: ids[a:b].tobytes() for w, a, b in zip(words, [0, *(ends + 1).tolist()], ends.tolist())}

    def learn(words: set[str], known: dict[str, bytes], prefix: str) -> list[str]:
        """Put the ids of all words into ``known``; those that are new."""
        missing = words.difference(known)
        if not missing:
            return []
        bare = {w: w[:-1] if len(w) > 1 and w[-1] in marks and w[-2].isalpha() else w for w in missing}
        new = fresh([w for w in dict.fromkeys(bare.values()) if w not in known], prefix)
        for w, b in bare.items():
            if b is not w:
                new[w] = (new[b] if b in new else known[b]) + marks[w[-1]]
        known.update(new)
        return list(new)

    def encode(texts: list[str]) -> list[bytes]:
        lines: list[list[tuple[str, list[str]]] | None] = []
        firsts: set[str] = set()
        others: set[str] = set()
        for t in texts:
            if not t or not _plainly_spaced(t) or any(x in t for x in special):
                lines.append(None)
                continue
            parts = []
            for line in t.split("\n"):
                words = line.split(" ")
                head = words.pop(0)
                firsts.add(head)
                others.update(words)
                parts.append((head, words))
            lines.append(parts)
        passing = [(known, learn(words, known, prefix)) for words, known, prefix in ((firsts, leading, ""), (others, inner, " "))]
        first, rest = leading.__getitem__, inner.__getitem__
        out = []
        for text, parts in zip(texts, lines):
            if parts is None:
                out.append(ids_of([text])[0] if text else b"")
            else:
                out.append(line_end.join([first(head) + b"".join(map(rest, words)) for head, words in parts]))
        for known, new in passing:  # what is beyond the bound isn't remembered
            if len(known) > config.cache_words:
                for w in new:
                    del known[w]
        return out

    return encode


def cut(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(config)
        end = np.array([config.end_id], "<u4").tobytes()
        for pdf in batches:
            rows = []
            texts = pdf["text"].fillna("").tolist()
            for a in range(0, len(texts), TEXTS):
                for doc_id, found in zip(pdf["doc_id"][a : a + TEXTS], encode(texts[a : a + TEXTS])):
                    ids = found + end
                    n = len(ids) // 4
                    first = n % config.capacity or config.capacity
                    bounds = [0, *range(first, n + 1, config.capacity)]
                    for k, (x, y) in enumerate(zip(bounds, bounds[1:])):
                        rows.append((doc_id, k, x, y - x, zlib.crc32(ids[4 * x : 4 * y])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECE_SCHEMA)


def pack(pieces: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """``pieces`` with sequence_id and offset, gapless in every sequence."""
    histogram = pieces.groupBy("length").count()
    counts = {int(r["length"]): int(r["count"]) for r in histogram.collect()}  # at most ``capacity`` rows
    slots = pieces.sparkSession.sparkContext.broadcast(slot_table(minimum_bin_slack(counts, config.capacity)))

    n_buckets = root_buckets(sum(counts.values()))
    dealt = pieces.withColumn("bucket", bucket_of(n_buckets, F.col("doc_id"), F.col("piece"), F.col("ids_crc32")))
    before = dealt.groupBy("length", "bucket").count().select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(inside) - 1).join(before, ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(), number.to_numpy()
        out = np.empty((len(size), 2), np.int64)
        for x in np.unique(size):
            here, table = size == x, slots.value[int(x)]
            row = table[np.searchsorted(table[:, 0], at[here], "right") - 1]
            nth = at[here] - row[:, 0]
            out[here] = np.stack([row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * x], 1)
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = numbered.withColumn("slot", place(F.col("length"), F.col("number") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")


def pack_documents(docs: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    return pack(stage(cut(docs, config), "pieces"), config)


def op10_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
