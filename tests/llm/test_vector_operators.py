"""Vector operators against all distances, and their defined results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import graph_index, sort_means, vector_codes
from siltstone.llm.common import discard
from siltstone.llm.lattice import squares, with_total

SCHEMA = "vec_id bigint, embedding array<float>, label int"
ODD = [None, [], [math.nan] * 64, [1.0] * 63 + [math.inf], [1.0] * 63 + [None], [0.0] * 64, [1.0] * 32]


def vectors_of(seed, n, width=64, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) / 8
    return np.round(x * grid) / grid if grid else x


def nearest(points, centres):
    far = squares(points[:, None], centres[None])
    return far.argmin(1), far.min(1)  # the first of equal ones


@pytest.mark.parametrize("search", [vector_codes.nearest_entries, sort_means.walk])
@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_bounded_searches_equal_all_distances(search, spread):
    """From any previous entry, with many ties and equal entries at the small spreads."""
    rng = np.random.default_rng(spread)
    for k in (1, 2, 7, 64):
        points, centres = rng.integers(-spread, spread + 1, (400, 4)), rng.integers(-spread, spread + 1, (k, 4))
        index, far = search(points, centres, rng.integers(0, k, 400))
        expected, distance = nearest(points, centres)
        assert (index == expected).all() and (far == distance).all()


def brute_means(points, centres, rounds):
    for _ in range(rounds):
        index, _ = nearest(points, centres)
        centres = np.array([points[index == i].sum(0) // max(1, (index == i).sum()) if (index == i).any() else c for i, c in enumerate(centres)])
    return nearest(points, centres), centres


def test_codes_equal_brute_force(spark):
    x = vectors_of(1, 700, 32, grid=16)
    x[100:350] = x[7]  # a third of all rows are one vector
    rows = [(i, v.tolist(), i % 3 or None) for i, v in enumerate(x)]
    rows += [(5000 + i, v, 1) for i, v in enumerate(ODD) if v is None or len(v) != 32]
    random.seed(1)
    random.shuffle(rows)
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    got = {r["vec_id"]: r for r in coded.collect()}
    points = np.floor(256 * x.astype(np.float32).astype(float)).astype(np.int64).reshape(-1, 16, 2)
    assert sorted(got) == list(range(700))
    error = np.zeros(700, np.int64)
    for p in range(16):
        (index, far), centres = brute_means(points[:, p], points[:64, p], 2)
        assert [got[i]["code"][p] for i in range(700)] == index.tolist()
        assert (books[p] == centres).all()
        error += far
    assert [got[i]["error"] for i in range(700)] == error.tolist()


def test_totals_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("label"), F.lit(2).alias("error"))
    few = with_total(rows, "label", "error", "t", "id").collect()
    monkeypatch.setattr("siltstone.llm.lattice.MOST_TOTALS", 3)
    assert sorted(map(str, with_total(rows, "label", "error", "t", "id").collect())) == sorted(map(str, few))


def test_sort_means_equals_brute_force(spark):
    import hashlib

    x = vectors_of(2, 600, grid=8)
    x[:200] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9000 + i, v, 0) for i, v in enumerate(ODD) if v is None or v != [0.0] * 64]
    assigned, centroids = sort_means.cluster(spark.createDataFrame(rows, SCHEMA))
    points = np.floor(1024 * x.astype(np.float32).astype(float)).astype(np.int64)
    first = sorted(range(600), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:8]
    (index, far), centres = brute_means(points, points[first], 10)
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in assigned.collect()}
    assert got == {i: (int(c), int(d)) for i, (c, d) in enumerate(zip(index, far))}
    assert (centroids == centres).all()


def brute_nearest(rows, k):
    """(query, rank) to (key, score), components added in order."""
    known = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)})
    out = {}
    for i, q in reversed(known):
        if i % 20 == 0:
            scores = sorted((-sum(float(a) * float(b) for a, b in zip(v, q)), j) for j, v in known if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


@pytest.mark.parametrize("lengths", ["equal", "some longer", "spread"])
def test_graph_search_recall_and_scores(spark, lengths):
    x = vectors_of(3, 3000).astype(np.float32)
    if lengths == "some longer":
        x[500:700] *= 3
    elif lengths == "spread":
        x *= np.random.default_rng(4).lognormal(0, 0.5, (3000, 1)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = graph_index.build_index(df, "vec_id", "embedding", least_shards=3)
    found = graph_index.search(index, df.where("vec_id % 20 = 0"), "vec_id", "embedding", block_rows=60).collect()
    assert {r["rank"] for r in found} == set(range(1, 21))
    truth = brute_nearest(rows, 20)
    hits = {q: {j for j, _ in t} for q, t in truth.items()}
    assert np.mean([r["vec_id"] in hits[r["query_id"]] for r in found]) >= 0.9 and len(found) == 20 * len(truth)
    for r in found:
        assert r["score"] == pytest.approx(float(x[r["query_id"]].astype(float) @ x[r["vec_id"]].astype(float)), abs=1e-12)
    discard(index)


def test_graph_search_of_copies_and_odd_rows(spark):
    """Small inputs are searched whole: equal vectors, repeated rows and keys, lengths, signs of zero."""
    x = vectors_of(4, 120).astype(np.float32)
    x[20:70] = x[3]  # more copies than are asked for
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] * 2
    rows += [(200 + i, v, 0) for i, v in enumerate(ODD)] + [(None, x[1].tolist(), 0), (40, x[5].tolist(), 0), (240, [1.0, -0.0], 0), (260, [0.5, 0.0], 0), (261, [0.5, -0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = graph_index.build_index(df, "vec_id", "embedding", least_shards=2)
    found = {}
    for r in graph_index.search(index, df.where("vec_id % 20 = 0"), "vec_id", "embedding").orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = {q: t for q, t in brute_nearest(rows, 20).items() if t}
    assert found.keys() == expected.keys()
    for q, t in expected.items():
        assert [j for j, _ in found[q]] == [j for j, _ in t]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in t], abs=1e-12)


def test_pruning_keeps_edges_in_different_directions():
    space = graph_index.directions(np.array([[1.0, 0.0], [0.99, 0.01], [0.98, 0.02], [0.0, 1.0]]))
    kept = graph_index.robust_prune(space, np.array([0]), np.array([[1, 2, 3, -1]]), 2, 1.2)
    assert kept.tolist() == [[1, 3]]


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA + ", v int, code int, cluster int, shard int, vector int, key int")
    x = vectors_of(5, 40)
    few = spark.createDataFrame([(i, v.tolist(), 0, 1, 1, 1, 1, 1, 1) for i, v in enumerate(x)], empty.schema)
    for name, rows, table in (("none", 0, empty), ("few", 40, few)):
        table.write.parquet(str(tmp_path / name / "embeddings.parquet"))
        assert vector_codes.op11_exponion_codes(spark, str(tmp_path / name)).count() == rows
        assert sort_means.op12_sort_means(spark, str(tmp_path / name)).count() == rows
        assert graph_index.op13_graph_search(spark, str(tmp_path / name)).count() == rows and (rows == 0 or rows == 2 * 20)
