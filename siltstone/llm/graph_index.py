"""Approximate nearest neighbours by a robust-pruned directed graph (operator 13).

Vectors are dealt to shards by a hash of their key, so that equal or crowded vectors spread. A shard's task links
its vectors: each is put in by a greedy search from fixed starts, which proposes neighbours; relaxed distance pruning
keeps those that no kept neighbour lies much nearer to, so that edges point in different directions; the edges back are
added and pruned alike. The graphs are a table, staged before it is searched. A search walks the graph of every
shard from its starts with a beam of the best vectors found, scores what the beam holds exactly, and the best of all
shards are kept. Index rows and queries meet by (shard, block of queries): no task holds more than a shard and a block.

The measure is the largest inner product. The graph links vectors by their directions; the beam goes by inner products,
from fixed starts that include the longest vectors. (Lifting vectors to one length by one more component, so that
the graph has the measure itself, was tried: where lengths differ it found a third of what this finds.) Scores are
added in the order of components in double precision, so equal vectors have equal scores in every shard.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite components take no part. Vectors of
different lengths are not compared. Rows with equal key and vector count once; a candidate is any row of another
key, so a key with several vectors may be found several times. Of a query key's several vectors the smallest asks. A null
key is no query and no candidate. Equal vectors are one node of a shard that stands for all of its keys. A query with
fewer than ``k`` candidates gets them all. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read_table, stage
from .lattice import finite

K, EVERY = 20, 20
#: Edges of a node, width of the beam when a node is put in and when a query is asked, relaxation of the pruning.
DEGREE, BUILD_BEAM, BEAM, RELAXED = 32, 64, 128, 1.2
#: Vectors of a shard, and queries of a block, at most (about); shards at least. In larger shards a beam of this
#: width finds less: 0.96 of the nearest among 10,000 vectors, 0.78 among 48,000.
SHARD_ROWS, BLOCK_ROWS, LEAST_SHARDS = 1 << 13, 1 << 16, 12
#: Nodes from which every walk starts; at most a beam's width.
STARTS = 16
#: Beam entries whose neighbours one step of a search looks at.
STRIDE = 4
#: Partitions for each shard, so that few shards share a task.
SPREAD = 3
#: Marks of seen vectors that are held at once, in bytes.
SEEN_BYTES = 1 << 26


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the longest at length one."""
    largest = np.abs(vectors).max()
    return (vectors / largest / np.sqrt(((vectors / largest) ** 2).sum(1)).max()).astype(np.float32)


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors brought to length one each."""
    even = vectors / np.abs(vectors).max(1, keepdims=True)
    return (even / np.sqrt((even**2).sum(1, keepdims=True))).astype(np.float32)


def starts_of(vectors: np.ndarray) -> np.ndarray:
    """Where every walk starts: the vectors in the middle of the directions, and the longest."""
    space, length = directions(vectors), (scaled(vectors) ** 2).sum(1)
    middle = np.argsort(-(space @ space.mean(0)), kind="stable")[: STARTS // 2]
    longest = np.argsort(-length, kind="stable")[: STARTS - STARTS // 2]
    return np.unique(np.concatenate([middle, longest]))


def beam_search(space: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> np.ndarray:
    """(queries, beam) nodes of the largest inner products first that a walk over ``edges`` from ``starts`` finds, -1 where
    there are fewer.

    All queries of a block go in step: each looks at the neighbours of its best nodes not looked at yet.
    """
    out = []
    block = max(1, min(1024, SEEN_BYTES // max(1, len(space))))
    for low in range(0, len(queries), block):
        q = queries[low : low + block]
        n = len(q)
        nodes, far = np.full((n, beam), -1), np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)
        seen = np.zeros((n, len(space)), bool)
        away = -(q @ space[starts].T)
        by = np.argsort(away, axis=1, kind="stable")
        nodes[:, : len(starts)], far[:, : len(starts)] = starts[by], np.take_along_axis(away, by, 1)
        done[:, : len(starts)], seen[:, starts] = False, True
        walking = np.arange(n)
        while len(walking):
            open_ = np.argsort(done[walking], axis=1, kind="stable")[:, :STRIDE]  # the beam is in order, open ones come first
            at = walking[:, None]
            from_ = np.where(done[at, open_], -1, nodes[at, open_])
            done[at, open_] = True
            near = np.where((from_ >= 0)[:, :, None], edges[from_], -1).reshape(len(walking), -1)
            near = np.sort(near, axis=1)
            new = (near >= 0) & ~seen[at, near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            row, col = np.nonzero(new)
            found = near[row, col]
            seen[walking[row], found] = True
            away = np.full(near.shape, np.inf, np.float32)
            away[row, col] = -np.einsum("nd,nd->n", space[found], q[walking[row]])
            every = np.hstack([far[walking], away])
            best = np.argsort(every, axis=1, kind="stable")[:, :beam]
            pick = np.arange(len(walking))[:, None]
            far[walking] = every[pick, best]
            nodes[walking] = np.where(np.isinf(far[walking]), -1, np.hstack([nodes[walking], near])[pick, best])
            done[walking] = np.hstack([done[walking], ~new])[pick, best] | (nodes[walking] < 0)
            walking = walking[~done[walking].all(1)]
        out.append(nodes)
    return np.vstack(out) if out else np.empty((0, beam), int)


def robust_prune(space: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """(points, degree) neighbours, -1 where there are fewer: the nearest candidate is kept and drops those that it is
    ``relaxed`` times nearer to than the point is, then the nearest of the rest, and so on."""
    out = np.full((len(points), degree), -1)
    for low in range(0, len(points), 512):
        p, c = points[low : low + 512], np.sort(candidates[low : low + 512], axis=1)
        at = space[c]
        own = 2 - 2 * np.einsum("ncd,nd->nc", at, space[p])
        mutual = 2 - 2 * np.matmul(at, at.transpose(0, 2, 1))
        gone = (c < 0) | (c == p[:, None])
        gone[:, 1:] |= c[:, 1:] == c[:, :-1]
        row = np.arange(len(p))
        for i in range(degree):
            left = np.where(gone, np.inf, own)
            best = left.argmin(1)
            found = ~gone[row, best]
            if not found.any():
                break
            out[low + row[found], i] = c[row[found], best[found]]
            gone |= found[:, None] & (relaxed * relaxed * mutual[row, best] <= own)
            gone[row, best] = True
    return out


def linked(space: np.ndarray, starts: np.ndarray, degree: int, beam: int, relaxed: float, seed: int = 7) -> np.ndarray:
    """The graph: nodes are put in by batches that double in size, in an order drawn once."""
    n = len(space)
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([starts, order[~np.isin(order, starts)]])
    batches, low = [starts], len(starts)
    while low < n:
        high = min(n, low + max(1, min(low, n // 16 + 1)))
        batches.append(order[low:high])
        low = high
    for batch in filter(len, batches):
        found = beam_search(space, edges, starts, space[batch], beam)
        out = robust_prune(space, batch, np.hstack([found, edges[batch]]), degree, relaxed)
        edges[batch] = out
        source, target = np.repeat(batch, degree), out.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        new = ~(edges[target] == source[:, None]).any(1)
        _add_back(space, edges, source[new], target[new], relaxed)
    return edges


def _add_back(space: np.ndarray, edges: np.ndarray, source: np.ndarray, target: np.ndarray, relaxed: float) -> None:
    """Put the edges target to source in: appended where there is room, else pruned with those that are there."""
    degree = edges.shape[1]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    held = (edges[nodes] >= 0).sum(1)
    while len(nodes):  # a round takes up to a row's width of new edges for each node
        taken = np.minimum(count, degree)
        fresh = np.full((len(nodes), degree), -1)
        row = np.repeat(np.arange(len(nodes)), taken)
        col = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
        fresh[row, col] = source[first[row] + col]
        room = held + taken <= degree
        both = np.hstack([edges[nodes], fresh])
        if room.any():
            packed = np.argsort(both[room] < 0, axis=1, kind="stable")[:, :degree]
            edges[nodes[room]] = np.take_along_axis(both[room], packed, 1)
        if (~room).any():
            edges[nodes[~room]] = robust_prune(space, nodes[~room], both[~room], degree, relaxed)
        first, count = first + taken, count - taken
        nodes, first, count = nodes[count > 0], first[count > 0], count[count > 0]
        held = (edges[nodes] >= 0).sum(1)


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    kept = rows.where(F.col(key).isNotNull() & finite(F.col(vector)) & F.exists(vector, lambda x: x != 0))
    return kept.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.size(vector).alias("dim"))


def build_index(rows: DataFrame, key: str, vector: str, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """The staged index (dim, shard, node, start, keys, vector, edges) of rows with an integer ``key`` and a ``vector``."""
    usable = _usable(rows, key, vector)
    shards = max(least_shards, math.ceil(usable.count() / shard_rows))
    dealt = usable.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).repartition(SPREAD * shards, "dim", "shard")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(pdf["vector"].to_numpy())
        vectors, node = np.unique(raw + 0.0, axis=0, return_inverse=True)  # -0.0 is 0.0
        by = np.lexsort((pdf["key"].to_numpy(), node.reshape(-1)))
        keys = np.split(pdf["key"].to_numpy()[by], np.flatnonzero(np.diff(node.reshape(-1)[by])) + 1)
        starts = starts_of(vectors)
        edges = linked(directions(vectors), starts, degree, beam, relaxed)
        return pd.DataFrame({
            "dim": pdf["dim"].iat[0], "shard": pdf["shard"].iat[0], "node": np.arange(len(vectors)), "start": np.isin(np.arange(len(vectors)), starts),
            "keys": [np.unique(k).tolist() for k in keys], "vector": list(vectors), "edges": [e[e >= 0].tolist() for e in edges],
        })

    schema = "dim int, shard int, node int, start boolean, keys array<bigint>, vector array<double>, edges array<int>"
    return stage(dealt.groupBy("dim", "shard").applyInPandas(build, schema), "graph-index")


def search(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int = K, beam: int = BEAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``queries``, of other keys than its own."""
    asked = _usable(queries, key, vector).groupBy("key").agg(F.min(F.struct("vector", "dim")).alias("q")).select("key", "q.vector", "q.dim")
    blocks = max(1, math.ceil(asked.count() / block_rows))
    shards = index.select("dim", "shard").distinct().toDF("dim", "shard")
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(blocks)).cast("int")).join(F.broadcast(shards), "dim")  # a row a shard
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def walk(graph: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph) and len(questions):
            graph = graph.sort_values("node")
            vectors, keys = np.stack(graph["vector"].to_numpy()), graph["keys"].to_numpy()
            edges = np.full((len(graph), max(1, graph["edges"].str.len().max())), -1)
            for i, e in enumerate(graph["edges"]):
                edges[i, : len(e)] = e
            q = np.stack(questions["vector"].to_numpy())
            found = beam_search(scaled(vectors), edges, np.flatnonzero(graph["start"]), directions(q), max(beam, k + 1))
            score = np.zeros(found.shape)
            for d in range(q.shape[1]):  # in the order of components
                score += vectors[found, d] * q[:, d, None]
            score[found < 0] = -np.inf
            for own, nodes, scores in zip(questions["key"].to_numpy(), found, score):
                best = np.argsort(-scores, kind="stable")[: (nodes >= 0).sum()]
                rows = sorted((-scores[b], x) for b in best[: k + 1] for x in keys[nodes[b]][: k + 1] if x != own)
                # nodes as near as the last one stay, so that ties go to the smaller key
                if len(best) > k + 1 and (tied := best[k + 1 :][scores[best[k + 1 :]] == scores[best[k]]]).size:
                    rows = sorted(rows + [(-scores[b], x) for b in tied for x in keys[nodes[b]][: k + 1] if x != own])
                out += [(own, x, -s) for s, x in rows[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    by = ["dim", "shard", "block"]
    tasks = max(1, SPREAD * index.select("dim", "shard").distinct().count() * blocks)
    held, asked = held.repartition(tasks, *by), asked.repartition(tasks, *by)
    near = held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(walk, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a shard
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    index = build_index(vectors, "vec_id", "embedding")
    found = stage(search(index, vectors.where(F.col("vec_id") % EVERY == 0), "vec_id", "embedding"), "graph-found")
    discard(index)
    return found
