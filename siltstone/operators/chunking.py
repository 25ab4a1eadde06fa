"""Chunking (C1-C13): windows in SQL expressions, structure-aware strategies as table functions."""

from __future__ import annotations

import ast
import bisect
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import estimated_tokens, line_ends
from ..functions.tokenizer import token_spans


def pieces(content: Column, size: int, step: int) -> tuple[Column, Column]:
    """The number of windows of a text and its consecutive stretches of ``step`` characters; window i
    begins with stretch i. Texts are walked once, whatever their length."""
    n = F.length(content)
    count = (F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))) + 1).cast("int")
    return count, F.regexp_extract_all(content, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))


def window_at(stretches: Column, i: Column, size: int, step: int) -> Column:
    return F.substring(F.array_join(F.slice(stretches, i + 1, -(-size // step)), ""), 1, size)


def fixed_chars(files: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Overlapping character windows; the last one ends with the text.

    Lines are counted once for each stretch between two windows, so neither the text nor what stands
    before a window is carried along with it.
    """
    size, step = max(100, config.size), max(100, config.size) - config.overlap
    count, stretches = pieces(F.col("content"), size, step)
    cut = files.where(F.length("content") > 0).select("corpus_id", "file_path", "doc_id", count.alias("count"), stretches.alias("stretches"))
    lines = F.transform("stretches", line_ends)
    before = F.aggregate(lines, F.array(F.lit(0)), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x))
    cut = cut.withColumn("before", before)
    made = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.struct(window_at(F.col("stretches"), i, size, step).alias("content"), (F.get("before", i) + 1).alias("start_line")))
    out = cut.select("corpus_id", "file_path", "doc_id", F.posexplode(made).alias("chunk_ordinal", "made"), (F.col("count") == 1).alias("lone"))
    piece, start = F.col("made.content"), F.col("chunk_ordinal") * step
    out = out.where((F.length(piece) >= config.min_chars) | F.col("lone"))
    return out.select(
        "corpus_id", "file_path", "doc_id", "chunk_ordinal", start.alias("char_start"), (start + F.length(piece)).alias("char_end"), piece.alias("content"),
        F.col("made.start_line").alias("start_line"), (F.col("made.start_line") + line_ends(piece)).alias("end_line"),
        F.concat_ws(":", "file_path", start.cast("string")).alias("chunk_id"), estimated_tokens(piece).alias("token_count"),
    )


def estimated_token_windows(files: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Windows of estimated tokens, four characters each (C2 with the estimating tokeniser)."""
    size, step = config.target_tokens * 4, (config.target_tokens - config.overlap_tokens) * 4
    count, stretches = pieces(F.col("content"), size, step)
    cut = files.where(F.length("content") > 0).select("file_path", count.alias("count"), stretches.alias("stretches"))
    made = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: window_at(F.col("stretches"), i, size, step))
    cut = cut.select("file_path", F.posexplode(made).alias("chunk_ordinal", "piece"))
    return cut.select("file_path", "chunk_ordinal", (F.col("chunk_ordinal") * step).alias("char_start"), estimated_tokens(F.col("piece")).alias("token_count"), F.md5("piece").alias("piece_md5"))


# Strategies: a text to spans (start, end). Small helpers; Spark spreads the rows.

Span = tuple[int, int]


def token_windows(text: str, config: ChunkConfig) -> list[Span]:
    """Windows of the tokeniser's tokens with overlap."""
    at = token_spans(text, config.tokenizer)
    step = config.target_tokens - config.overlap_tokens
    spans = []
    for i in range(0, max(1, len(at)), step):
        part = at[i : i + config.target_tokens]
        if part:
            spans.append((part[0][0], part[-1][1]))
        if i + config.target_tokens >= len(at):
            break
    return spans


def packed(units: list[Span], text: str, budget: int) -> list[Span]:
    """Neighbouring units joined while their estimated tokens fit (C11)."""
    out: list[Span] = []
    for start, end in units:
        if out and math.ceil((end - out[-1][0]) / 4) <= budget:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return [(a, b) for a, b in out if text[a:b].strip()]


def boundaries(text: str, pattern: str) -> list[Span]:
    """The text cut before every match of ``pattern``."""
    cuts = sorted({0, len(text), *(m.start() for m in re.finditer(pattern, text, re.M))})
    return list(zip(cuts, cuts[1:]))


def recursive(text: str, config: ChunkConfig, span: Span | None = None, depth: int = 0) -> list[Span]:
    """Cut at the coarsest separator that helps, finer ones where a piece is still too long."""
    start, end = span or (0, len(text))
    if math.ceil((end - start) / 4) <= config.target_tokens or depth >= config.max_depth:
        return [(start, end)] if text[start:end].strip() else []
    separators = ("\n\n", "\n", ". ", " ")
    separator = separators[min(depth, len(separators) - 1)]
    size = len(separator)
    marks, at = [], text.find(separator, start, end)
    while at >= 0:
        marks.append(at)
        at = text.find(separator, at + size, end)
    # What stands between two cuts is left out; with "suffix" a separator stays with what it ends.
    ends, starts = {"none": (0, size), "prefix": (0, 0), "suffix": (size, size)}[config.separator_keep]
    cuts = [(m + ends, m + starts) for m in marks if start < m + starts < end or config.separator_keep == "none"]
    bounds = zip([start, *(b for _, b in cuts)], [*(a for a, _ in cuts), end])
    units = [p for a, b in bounds if a < b for p in recursive(text, config, (a, b), depth + 1)]
    return packed(units, text, config.target_tokens)


def markdown(text: str, config: ChunkConfig) -> list[Span]:
    """Cut at headings, then recursively (C4)."""
    parts = boundaries(text, rf"^#{{1,{config.heading_level}}} ")
    return [s for part in parts for s in recursive(text, config, part)]


def sentences(text: str, config: ChunkConfig) -> list[Span]:
    """Sentences packed to the budget."""
    cuts = [0, *(m.end() for m in re.finditer(r"(?<=[.!?])\s+", text)), len(text)]
    return packed([s for s in zip(cuts, cuts[1:]) if s[0] < s[1]], text, config.target_tokens)


def qa_blocks(text: str, config: ChunkConfig) -> list[Span]:
    """Question and answer blocks packed to the budget; sentences where there are none."""
    if not re.search(r"^(Q|A):", text, re.M):
        return sentences(text, config)
    return packed(boundaries(text, r"^Q:"), text, config.target_tokens)


def python_statements(text: str, config: ChunkConfig) -> list[Span]:
    """Top-level statements, each to the end of its last line, packed to the budget and widened by lines
    of context on both sides (C7). What Python can't parse, nested too deeply for its parser included, is cut recursively."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return recursive(text, config)
    starts = [0, *(m.end() for m in re.finditer("\r\n|\r|\n", text))]  # line ends as Python counts them
    ends = [*starts[1:], len(text)]
    wanted = [n for n in body if config.preserve_imports or not isinstance(n, (ast.Import, ast.ImportFrom))]
    cuts = sorted({0, len(text), *(ends[n.end_lineno - 1] for n in wanted)})
    if not wanted:
        return recursive(text, config)
    found = packed(list(zip(cuts, cuts[1:])), text, config.target_tokens)
    more, line_of = config.ast_overlap_lines, lambda at: bisect.bisect_right(starts, at) - 1
    return [(starts[max(0, line_of(a) - more)], ends[min(len(ends) - 1, line_of(b - 1) + more)]) for a, b in found] if more else found


#: In the code of a brace language: what is skipped (comments, strings, expressions after an operator), templates and braces.
CODE_TOKEN = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*+(?:"|\\?\Z)|'(?:\\.|[^'\\])*+(?:'|\\?\Z)|(?<=[=(,:!&|?;{}\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\[\n])++/|[`{}]""", re.S
)
#: In the text of a template: what is skipped, its end, and the start of an expression.
TEMPLATE_TOKEN = re.compile(r"\\.|`|\$\{", re.S)


def brace_blocks(text: str, config: ChunkConfig) -> list[Span]:
    """Blocks of brace languages, from the line on which nesting leaves the top to the end of the line on
    which it returns, packed to the budget with what stands between them (C8).

    A stack holds the open braces, templates and expressions of templates, in which braces count again.
    """
    stack, cuts, began, at = [], {0, len(text)}, 0, 0
    while m := (TEMPLATE_TOKEN if stack and stack[-1] == "`" else CODE_TOKEN).search(text, at):
        at, token = m.end(), m[0]
        if stack and stack[-1] == "`":
            if token == "`":
                stack.pop()
            elif token == "${":
                stack.append(token)
        elif token in "`{":
            if not stack and token == "{":
                began = text.rfind("\n", 0, m.start()) + 1
            stack.append(token)
        elif token == "}" and stack:
            stack.pop()
            if not stack:
                line_end = text.find("\n", m.end())
                cuts |= {began, line_end + 1 if line_end >= 0 else len(text)}
    if len(cuts) == 2:
        return recursive(text, config)
    ordered = sorted(cuts)
    return packed(list(zip(ordered, ordered[1:])), text, config.target_tokens)


def hard_split(text: str, spans: list[Span], config: ChunkConfig) -> list[Span]:
    """Spans of more tokens than a chunk may have cut again at tokens (C10); ordinals are given
    afterwards, so they stay unique."""
    most, out = config.max_tokens, []
    for start, end in spans:
        at = [a for a, _ in token_spans(text[start:end], config.tokenizer)] if end - start > most else []
        cuts = [start, *(start + at[i] for i in range(most, len(at), most)), end]
        out += list(zip(cuts, cuts[1:]))
    return out


STRATEGIES: dict[str, Callable[[str, ChunkConfig], list[Span]]] = {
    "fixed_tokens": token_windows,
    "recursive": recursive,
    "markdown": markdown,
    "sentence": sentences,
    "qa_blocks": qa_blocks,
    "ast": python_statements,
    "braces": brace_blocks,
}


def register(name: str, strategy: Callable[[str, ChunkConfig], list[Span]]) -> None:
    """Add a strategy of the caller's own."""
    STRATEGIES[name] = strategy


def split(files: DataFrame, strategy: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks (corpus_id, file_path, chunk_ordinal, char_start, char_end, start_line, end_line, content)."""
    cut = STRATEGIES[strategy]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for corpus, path, text in zip(pdf["corpus_id"], pdf["file_path"], pdf["content"]):
                spans = hard_split(text, cut(text, config), config)
                spans = [s for s in spans if s[1] - s[0] >= config.min_chars] if len(spans) > 1 else spans
                breaks = [m.start() for m in re.finditer("\n", text)]
                for i, (a, b) in enumerate(spans):
                    rows.append((corpus, path, i, a, b, 1 + bisect.bisect_left(breaks, a), 1 + bisect.bisect_left(breaks, b), text[a:b]))
            yield pd.DataFrame(rows, columns=["corpus_id", "file_path", "chunk_ordinal", "char_start", "char_end", "start_line", "end_line", "content"])

    schema = "corpus_id string, file_path string, chunk_ordinal int, char_start int, char_end int, start_line int, end_line int, content string"
    return files.where("content is not null").select("corpus_id", "file_path", "content").mapInPandas(run, schema)


def next_edges(chunks: DataFrame) -> DataFrame:
    """NEXT_CHUNK edges of neighbours in a file."""
    w = Window.partitionBy("corpus_id", "file_path").orderBy("chunk_ordinal")
    return chunks.select("corpus_id", F.col("chunk_id").alias("src"), F.lead("chunk_id").over(w).alias("dst")).where("dst is not null")


def message_chunks(turns: DataFrame, by_sentence: bool = True) -> DataFrame:
    """Chat memory chunks: one a turn or one a sentence, with a running line number."""
    text = F.trim("text")
    pieces = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001") if by_sentence else F.array(text)
    said = turns.where("role in ('user', 'assistant') and text is not null")
    parts = said.select("conv_id", "turn", "role", F.posexplode(F.filter(pieces, lambda p: F.trim(p) != "")).alias("part", "content"))
    line = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "part"))
    chunk_id = F.concat_ws(":", F.lit("recall"), F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("part").cast("string"))
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return parts.select(chunk_id.alias("chunk_id"), "conv_id", "role", "content", line.alias("line"), words.alias("token_count"))
