"""Shared helpers: table reading, staged tables in the shared folder, word hashing."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share. Where the session names none, a local session gets a
    temporary one; a cluster must name its own, as executors can't read the driver's folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="siltstone-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Rows of a batch that a Python worker gets, where rows hold whole documents.
BATCH_ROWS, BATCH_SETTING = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Send documents to the workers in smaller batches than the default; a smaller setting of the session's stays."""
    if int(spark.conf.get(BATCH_SETTING, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where several branches read one expensive result: the table outlives lost executors and
    cuts the lineage. Staged tables hold digests, counts, keys or candidate texts, or what a
    stage of a pipeline returns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/siltstone/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for table in tables:
        if path := getattr(table, "staged_at", None):
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def release(spark: SparkSession) -> None:
    """Delete every staged table of this session's shared folder once its results are written."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/siltstone")


def root_buckets(n_rows: int, least: int = 8) -> int:
    """Buckets for two-level prefix sums: about the square root of the rows, so that neither the
    rows of a bucket nor the buckets of a key outgrow one task."""
    return max(least, 1 << math.ceil(math.log2(max(1, n_rows)) / 2))


def bucket_of(n_buckets: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n_buckets)).cast("int")


def word_hashes(text: str, is_word: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of ``text``: maximal runs of characters that ``is_word`` marks.

    Polynomial over the code points modulo 2**64, finished by a multiply-shift mix.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = is_word[cp]
    if not inside.any():
        return np.empty(0, np.uint64)
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths, first = ends - starts, starts[0]
    cp, inside, starts = cp[first:], inside[first:], starts - first
    place = np.arange(len(cp)) - np.repeat(starts, np.diff(starts, append=len(cp)))
    longest = int(lengths.max())
    powers = np.full(longest, 0x100000001B3, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = (cp.astype(np.uint64) + np.uint64(0x9E37)) * powers[np.minimum(place, longest - 1)]
    terms[~inside] = 0
    return mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche for unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def letter_or_digit_table() -> np.ndarray:
    """Marks the code points that are letters or digits; made once in a worker process."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
