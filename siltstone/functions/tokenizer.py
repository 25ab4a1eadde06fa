"""Tokenisers as switches (C12, V5): places of tokens in a text, counts and truncation.

Small helpers for functions that Spark runs over batches of rows. A tokeniser file is one of the
``tokenizers`` library; its path is the caller's.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from dataclasses import dataclass

STRATEGIES = ("whitespace", "estimate", "file")


@dataclass(frozen=True)
class TokenizerConfig:
    strategy: str = "whitespace"
    path: str | None = None
    normalize_unicode: bool = True
    lowercase: bool = False

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"no such tokeniser: {self.strategy}")
        if (self.strategy == "file") != (self.path is not None):
            raise ValueError("a path goes with the strategy 'file' and with no other")


@functools.cache
def _loaded(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def normalized(text: str, config: TokenizerConfig) -> str:
    """Compatibility form and lower case, as the switches say."""
    out = unicodedata.normalize("NFKC", text) if config.normalize_unicode else text
    return out.lower() if config.lowercase else out


def same_length(text: str, config: TokenizerConfig) -> str:
    """As ``normalized``, each step only if it keeps the length, so that places stay those of the text."""
    for step in (config.normalize_unicode and functools.partial(unicodedata.normalize, "NFKC"), config.lowercase and str.lower):
        if step and len(changed := step(text)) == len(text):
            text = changed
    return text


def token_spans(text: str, config: TokenizerConfig) -> list[tuple[int, int]]:
    """Start and end of every token; estimated tokens have four characters."""
    if config.strategy == "estimate":
        return [(i, min(i + 4, len(text))) for i in range(0, len(text), 4)]
    if config.strategy == "file":
        return list(_loaded(config.path).encode(same_length(text, config), add_special_tokens=False).offsets)
    return [m.span() for m in re.finditer(r"\S+", text)]


def count(text: str, config: TokenizerConfig) -> int:
    return math.ceil(len(normalized(text, config)) / 4) if config.strategy == "estimate" else len(token_spans(text, config))


def truncated(text: str, most: int, config: TokenizerConfig, mode: str = "truncate_end") -> str:
    """The normalised text cut to ``most`` tokens: its beginning, or beginning and end around an ellipsis;
    with mode ``error`` a longer text is refused."""
    if mode not in ("truncate_end", "truncate_middle", "error"):
        raise ValueError(f"no such mode: {mode}")
    if most <= 0:
        return ""
    text = normalized(text, config)
    starts = [a for a, _ in token_spans(text, config)]
    if len(starts) <= most:
        return text
    if mode == "error":
        raise ValueError(f"text exceeds max tokens ({len(starts)} > {most})")
    if mode == "truncate_end":
        return text[: starts[most]]
    head = most // 2
    tail = most - head
    return (text[: starts[head]] + "…" + text[starts[len(starts) - tail] :]).strip()
