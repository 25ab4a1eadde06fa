"""Embedding with a model of the caller's (V5, V6, V7): text preparation, the hook, late chunking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.tokenizer import TokenizerConfig, token_spans, truncated

#: From texts to a matrix, a row each.
Embedder = Callable[[list[str]], np.ndarray]
#: From a text and its token spans to a matrix, a row for each token.
TokenEmbedder = Callable[[str, list[tuple[int, int]]], np.ndarray]


@dataclass(frozen=True)
class EmbeddingConfig:
    dim: int = 64
    prefix: str = ""
    suffix: str = ""
    #: Tokens that a model takes; 0 for no limit. The smaller of the two that are set holds.
    max_tokens: int = 0
    hard_max_tokens: int = 0
    truncation: str = "truncate_end"
    #: Tries of a batch before its error is raised.
    tries: int = 3
    tokenizer: TokenizerConfig = field(default_factory=TokenizerConfig)


#: Token vectors that a worker remembers between tasks, by length of a vector: a token's signs, a byte each.
_SIGNS: dict[int, dict[str, bytes]] = {}
REMEMBERED = 200_000


def hashed_tokens(dim: int) -> TokenEmbedder:
    """Deterministic token vectors: signs drawn from a hash of the token, once for a token that comes again."""
    import zlib

    def drawn(token: str) -> bytes:
        """What ``default_rng(hash).choice((-1, 1), dim)`` draws: the upper bits of its 32-bit words."""
        words = np.random.PCG64(zlib.crc32(token.encode())).random_raw(-(-dim // 2)).astype("<u8").view("<u4")[:dim]
        return ((words >> 31).astype(np.int8) * 2 - 1).tobytes()

    def embed(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        known = _SIGNS.setdefault(dim, {})
        if len(known) > REMEMBERED:
            known.clear()
        rows = []
        for a, b in spans:
            token = text[a:b].lower()
            signs = known.get(token)
            if signs is None:
                signs = known[token] = drawn(token)
            rows.append(signs)
        return np.frombuffer(b"".join(rows), np.int8).astype(float).reshape(-1, dim)

    return embed


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def pooled(tokens: TokenEmbedder, config: EmbeddingConfig) -> Embedder:
    """An embedder of texts from one of tokens: their mean, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        rows = [tokens(t, token_spans(t, config.tokenizer)) for t in texts]
        return unit(np.array([r.mean(0) if len(r) else np.zeros(config.dim) for r in rows]).reshape(-1, config.dim))

    return embed


def prepared(text: str, config: EmbeddingConfig) -> str:
    """The text between prefix and suffix, cut to the model's limit (V5)."""
    whole = f"{config.prefix}{text}{config.suffix}"
    limits = [x for x in (config.max_tokens, config.hard_max_tokens) if x > 0]
    return truncated(whole, min(limits), config.tokenizer, config.truncation) if limits else whole


def prepare(rows: DataFrame, text: str, config: EmbeddingConfig = EmbeddingConfig()) -> DataFrame:
    """``rows`` with a column ``prepared``; a null text is an empty one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([prepared(t or "", config) for t in texts], dtype=object)

    return rows.withColumn("prepared", run(F.col(text)))


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder | None = None, config: EmbeddingConfig = EmbeddingConfig()) -> DataFrame:
    """(key, embedding) by a pluggable model over batches of prepared texts (V6).

    A vector of another length than ``dim`` is an error; a batch whose call fails is tried again. Without
    a model the hashed token vectors are pooled.
    """
    model = embedder or pooled(hashed_tokens(config.dim), config)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = [prepared(t or "", config) for t in texts]
            for attempt in range(1, config.tries + 1):
                try:
                    rows_ = np.asarray(model(given), float)
                    break
                except (OSError, RuntimeError):
                    if attempt == config.tries:
                        raise
            if rows_.shape != (len(given), config.dim):
                raise ValueError(f"embeddings of shape {rows_.shape}, not {(len(given), config.dim)}")
            yield pd.Series(list(rows_))

    return rows.select(key, run(F.col(text)).alias("embedding"))


def late_chunks(files: DataFrame, tokens: TokenEmbedder | None = None, config: EmbeddingConfig = EmbeddingConfig(), chunking: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(corpus_id, file_path, chunk_ordinal, char_start, char_end, start_line, end_line, token_count, embedding):
    a file's tokens are embedded in one go, windows of them pooled (V7)."""
    model = tokens or hashed_tokens(config.dim)
    step = chunking.target_tokens - chunking.overlap_tokens

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for corpus, path, text in zip(pdf["corpus_id"], pdf["file_path"], pdf["content"]):
                spans = token_spans(text, config.tokenizer)
                vectors = np.asarray(model(text, spans), float) if spans else np.empty((0, config.dim))
                if vectors.shape != (len(spans), config.dim):
                    raise ValueError(f"token embeddings of shape {vectors.shape}, not {(len(spans), config.dim)}")
                line, at = 1, 0
                for i, first in enumerate(range(0, max(1, len(spans) - chunking.overlap_tokens), step) if spans else ()):
                    part = spans[first : first + chunking.target_tokens]
                    start, end = part[0][0], part[-1][1]
                    line, at = line + text.count("\n", at, start), start
                    rows.append((corpus, path, i, start, end, line, line + text.count("\n", start, end), len(part), unit(vectors[first : first + len(part)].mean(0))))
            yield pd.DataFrame(rows, columns=["corpus_id", "file_path", "chunk_ordinal", "char_start", "char_end", "start_line", "end_line", "token_count", "embedding"])

    schema = "corpus_id string, file_path string, chunk_ordinal int, char_start int, char_end int, start_line int, end_line int, token_count int, embedding array<double>"
    return files.where("content is not null").select("corpus_id", "file_path", "content").mapInPandas(run, schema)
