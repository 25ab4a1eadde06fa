"""Large files as blocks of bytes, and their chunks with offsets in the file.

``byte_blocks`` is a data source whose partitions are stretches of a file. A block begins at the first character that
starts in its bytes and ends with the last one, so no character is cut; bad bytes are dropped. Blocks are chunked by
themselves; the characters, lines and chunks before a block are sums over the blocks of its file, a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import ChunkConfig
from ..functions.text import line_ends
from ..operators.chunking import fixed_chars

#: Bytes of a block, and of the blocks that one partition reads.
BLOCK_BYTES, PARTITION_BYTES = 1 << 21, 1 << 27


@dataclass
class Stretch(InputPartition):
    path: str
    first_block: int
    start: int
    end: int


class ByteBlocks(DataSource):
    """Options: ``path``, a file or folder of any store that Arrow opens; ``block_bytes``; ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "byte_blocks"

    def schema(self) -> str:
        return "file_path string, block int, content string"

    def reader(self, schema: object) -> DataSourceReader:
        return BlockReader(self.options)


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.block = int(options.get("block_bytes", BLOCK_BYTES))
        self.run = max(1, int(options.get("partition_bytes", PARTITION_BYTES)) // self.block) * self.block

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.uri)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        inside = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in inside if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Stretch(path, low // self.block, low, min(size, low + self.run)) for path, size in files for low in range(0, size, self.run)]

    def read(self, part: Stretch) -> Iterator[tuple[str, int, str]]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.uri)
        with store.open_input_file(part.path) as f:
            for i, low in enumerate(range(part.start, part.end, self.block)):
                high = min(part.end, low + self.block)
                held = f.read_at(high - low + 3, low)
                yield part.path, part.first_block + i, _whole(held, high - low, low > 0).decode("utf-8", "ignore")


def _whole(held: bytes, size: int, cut_before: bool) -> bytes:
    """The bytes of the characters that start in the first ``size`` of ``held``, which go on in up to three more. A
    continuation byte that no start precedes belongs to the block before, or to nothing."""

    def after(i: int) -> int:
        most = min(len(held), i + 3)
        while i < most and held[i] & 0xC0 == 0x80:
            i += 1
        return i

    return held[after(0) if cut_before else 0 : after(size)]


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file_path, block, content) of every block of the files at ``path``."""
    spark.dataSource.register(ByteBlocks)
    return spark.read.format("byte_blocks").option("path", path).option("block_bytes", block_bytes).load()


def block_sums(blocks: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(file_path, block, char_base, line_base, ordinal_base) of the blocks before a file's first one with a NUL."""
    size, step, n = max(100, config.size), max(100, config.size) - config.overlap, F.length("content")
    windows = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))) + 1
    short = (windows > 1) & (n - (windows - 1) * step < config.min_chars)
    made = F.when(n > 0, windows - short.cast("int")).otherwise(0)
    counts = blocks.select("file_path", "block", n.alias("chars"), line_ends(F.col("content")).alias("lines"), made.alias("chunks"), F.contains("content", F.lit("\0")).alias("binary"))
    before = Window.partitionBy("file_path").orderBy("block")  # a short row a block
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    sums = counts.select("file_path", "block", base("chars").alias("char_base"), base("lines").alias("line_base"), base("chunks").alias("ordinal_base"), F.max("binary").over(before).alias("stopped"))
    return sums.where(~F.col("stopped")).drop("stopped")


def block_chunks(blocks: DataFrame, corpus: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The chunks of blocks (file_path, block, content), placed in their files: as one pass over a file's blocks gives
    them. A file ends before its first block with a NUL."""
    cut = fixed_chars(blocks.select(F.lit(corpus).alias("corpus_id"), "file_path", F.col("block").alias("doc_id"), "content"), config).withColumnRenamed("doc_id", "block")
    placed = cut.join(block_sums(blocks, config), ["file_path", "block"])
    start = F.col("char_start") + F.col("char_base")
    return placed.select(
        "corpus_id", "file_path", "block", (F.col("chunk_ordinal") + F.col("ordinal_base")).alias("chunk_ordinal"), start.alias("char_start"), (F.col("char_end") + F.col("char_base")).alias("char_end"),
        (F.col("start_line") + F.col("line_base")).alias("start_line"), (F.col("end_line") + F.col("line_base")).alias("end_line"), F.concat_ws(":", "file_path", start.cast("string")).alias("chunk_id"), "content", "token_count",
    )
