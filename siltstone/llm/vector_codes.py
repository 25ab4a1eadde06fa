"""Vector code compression: product codes trained by exponion search (operator 11).

A vector is cut into equal parts, each replaced by the number of the nearest entry of its part's codebook.
An entry at least as near to a part as entry ``a`` lies within twice the part's distance of ``a``. So the search
starts at the part's previous entry, whose neighbours are sorted by distance, and looks at those inside that
radius, in rings that double in size. Distances are integers; equally near entries go to the lower number.

Spark holds the vectors: every round reads a staged table, writes the assigned one and adds up the parts of each
entry; the driver sees codebooks and sums alone, which have ``entries`` rows of a vector's length whatever the
number of vectors.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped, and so are vectors
whose length differs from that of the smallest ``vec_id`` whose vector can be cut (a positive multiple of the
number of parts). Repeated rows are coded each; among equal ``vec_id`` the smaller vector comes first, and a null
``vec_id`` last. With fewer vectors than entries the codebooks are shorter. Equal labels, nulls together, share
``label_error``. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, stage
from .lattice import finite, floor_means, lattice, lists_of, rows_of, squares, with_total

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def nearest_entries(points: np.ndarray, book: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the entry nearest to each point, by exponion search from ``previous``."""
    k = len(book)
    between = squares(book[:, None], book[None])
    near = np.argsort(between, axis=1, kind="stable")
    start = squares(points, book[previous])
    best = start * k + previous  # ordered by distance, then by number
    for entry in np.unique(previous):
        rows = np.flatnonzero(previous == entry)
        ring = between[entry][near[entry]]
        reach = np.searchsorted(ring, 4 * start[rows], side="right")  # twice the distance, in squares
        low, high = 0, 2
        while low < k and len(rows):
            others = near[entry][low:high]
            found = squares(points[rows, None], book[others][None]) * k + others
            best[rows] = np.minimum(best[rows], found.min(1))
            low, high = high, 2 * high
            rows, reach = rows[reach > low], reach[reach > low]
    return best % k, best // k


def assign(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows (vec_id, label, v, code) with the code by ``books`` and ``error``, searched from the code they had."""
    n_parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = rows_of(batch.column("v")).reshape(-1, n_parts, width)
            code, error = rows_of(batch.column("code")), np.zeros(len(parts), np.int64)
            for p in range(n_parts):
                code[:, p], distance = nearest_entries(parts[:, p], books[p], code[:, p])
                error += distance
            kept = [batch.column(c) for c in ("vec_id", "label", "v")]
            yield pa.RecordBatch.from_arrays([*kept, lists_of(code, pa.int16()), pa.array(error)], names=["vec_id", "label", "v", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "v", "code").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, code array<smallint>, error bigint")


def improved(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts assigned to them."""
    n_parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((n_parts * k, width), np.int64), np.zeros(n_parts * k, np.int64)
        for batch in batches:
            if batch.num_rows:
                slot = (rows_of(batch.column("code")) + np.arange(n_parts) * k).reshape(-1)
                np.add.at(sums, slot, rows_of(batch.column("v")).reshape(-1, width))
                counts += np.bincount(slot, minlength=n_parts * k)
        used = np.flatnonzero(counts)
        for i in range(width):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), i)), pa.array(sums[used, i]), pa.array(counts[used])], names=["slot", "place", "s", "n"])

    partial = coded.select("v", "code").mapInArrow(run, "slot bigint, place bigint, s bigint, n bigint")
    sums, counts = np.zeros((n_parts * k, width), np.int64), np.zeros((n_parts * k, width), np.int64)
    for r in partial.groupBy("slot", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # a row for each component of an entry
        sums[r["slot"], r["place"]], counts[r["slot"], r["place"]] = r["s"], r["n"]
    return floor_means(sums.reshape(books.shape), counts.reshape(books.shape), books)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks by part, entry and place) of rows (vec_id, label, embedding)."""
    kept = vectors.where(finite(F.col("embedding"))).select("vec_id", "label", lattice(F.col("embedding"), scale).alias("v"))
    kept = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).head()
    length = first["n"] if first else parts
    kept = kept.where(F.size("v") == length)
    seeds = [r["v"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    books = np.array(seeds, np.int64).reshape(-1, parts, length // parts).transpose(1, 0, 2)
    coded = kept.withColumn("code", F.array_repeat(F.lit(0).cast("smallint"), parts))
    for _ in range(rounds):
        before, coded = coded, stage(assign(coded, books), "codes")
        discard(before)
        books = improved(coded, books)
    before, coded = coded, stage(assign(coded, books), "codes")
    discard(before)
    return coded.select("vec_id", "label", "code", "error"), books


def op11_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    out = with_total(coded, "label", "error", "label_error", "vec_id")
    return out.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by all distances, a round after the other."""
    text = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), spread AS MATERIALIZED (SELECT vec_id, i // (len(v) // {PARTS}) AS p, i, v[i + 1] AS x FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM kept)
), book0 AS MATERIALIZED (SELECT p, i, e, x AS c FROM spread JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))"""
    for r in range(ROUNDS + 1):
        text += f""", near{r} AS MATERIALIZED (
  SELECT vec_id, p, min(d * {ENTRIES} + e)::bigint AS k FROM (SELECT s.vec_id, s.p, b.e, sum((s.x - b.c) * (s.x - b.c)) AS d FROM spread s JOIN book{r} b USING (p, i) GROUP BY ALL) GROUP BY vec_id, p
), mean{r} AS (SELECT s.p, s.i, n.k % {ENTRIES} AS e, floor(sum(s.x) / count(*)::double)::bigint AS m FROM spread s JOIN near{r} n USING (vec_id, p) GROUP BY ALL
), book{r + 1} AS MATERIALIZED (SELECT b.p, b.i, b.e, coalesce(m.m, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.i = b.i AND m.e = b.e)"""
    return text + f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', k % {ENTRIES}), '' ORDER BY p) AS code, sum(k // {ENTRIES})::bigint AS error FROM near{ROUNDS} GROUP BY vec_id
), labelled AS (SELECT c.*, l.label FROM coded c JOIN kept l USING (vec_id)
), totals AS (SELECT label, sum(error)::bigint AS label_error FROM labelled GROUP BY label)
SELECT c.vec_id, c.code, c.error, t.label_error, (SELECT sha256(string_agg(c::varchar, ',' ORDER BY p, e, i)) FROM book{ROUNDS}) AS codebooks_sha256
FROM labelled c JOIN totals t ON t.label IS NOT DISTINCT FROM c.label"""


OP11_SQL = _sql()
