"""Nearest neighbours by inner product through learned partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import hash_share, settle

#: Documented bound of the sample that the partitions are learned from, in vectors, about.
MAX_SAMPLE = 8192
#: Neighbours of a vector in the graph.
GRAPH = 16
PARTS = (4, 128)
#: Share of true neighbours that the calibrated number of probes must reach on the sample.
GOAL = 0.97
#: Rows and queries of one partition that one task compares.
ROW_BLOCK = 8192
QUERY_BLOCK = 4096


@dataclass
class Router:
    """Softmax classifier over partitions; probes is how many of them a query visits."""

    weights: np.ndarray
    bias: np.ndarray
    scale: float
    probes: int

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Partitions of each vector, most probable first."""
        return np.argsort(-((vectors * self.scale) @ self.weights + self.bias), axis=1, kind="stable")


def _graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest by inner product of each vector, without itself."""
    out = np.empty((len(vectors), k), np.int64)
    for at in range(0, len(vectors), 512):
        near = vectors[at : at + 512] @ vectors.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _balanced(vectors: np.ndarray, graph: np.ndarray, parts: int, draws: np.random.Generator) -> np.ndarray:
    """Balanced partition of the graph: grown from seeds, then moved by the votes of neighbours.

    No part takes more than 1.2 times its even share; a vertex goes to the part that most of its
    neighbours, in both directions, are in and that has room.
    """
    n = len(vectors)
    room = int(np.ceil(1.2 * n / parts))
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    centres = unit[draws.choice(n, parts, replace=False)]
    for _ in range(10):
        near = (unit @ centres.T).argmax(axis=1)
        for p in range(parts):
            if (near == p).any():
                centres[p] = unit[near == p].mean(axis=0)
    part = np.full(n, -1, np.int64)
    wish = unit @ centres.T
    load = np.zeros(parts, np.int64)
    for i in np.argsort(-wish.max(axis=1), kind="stable"):
        for p in np.argsort(-wish[i], kind="stable"):
            if load[p] < room:
                part[i], load[p] = p, load[p] + 1
                break
    source = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(6):
        votes = np.zeros((n, parts))
        np.add.at(votes, (source, part[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), part[source]), 1)
        moved = 0
        for i in draws.permutation(n):
            p = int(votes[i].argmax())
            if p != part[i] and votes[i, p] > votes[i, part[i]] and load[p] < room:
                load[part[i]] -= 1
                load[p] += 1
                part[i] = p
                moved += 1
        if moved < n // 200:
            break
    return part


def learn(vectors: np.ndarray, parts: int, k: int, seed: int = 11) -> Router:
    """Partition the neighbour graph of a sample and train the classifier that routes to it.

    The classifier learns for a vector where it and its neighbours lie. The number of probes is
    the least with which GOAL of the true neighbours of sampled queries are found in
    the partitions that the classifier itself gives their rows.
    """
    draws = np.random.default_rng(seed)
    n, dim = vectors.shape
    parts = max(1, min(parts, n // 4))
    scale = 1 / max(float(np.sqrt((vectors**2).sum(axis=1).mean())), 1e-12)
    if parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), scale, 1)
    graph = _graph(vectors, min(GRAPH, n - 1))
    part = _balanced(vectors, graph, parts, draws)
    target = np.zeros((n, parts))
    target[np.arange(n), part] += graph.shape[1] / 2
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph.ravel()]), 1)
    target /= target.sum(axis=1, keepdims=True)
    x = (vectors * scale).astype(np.float32)
    goal = target.astype(np.float32)
    weights, bias = np.zeros((dim, parts), np.float32), np.zeros(parts, np.float32)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, 151):
        z = x @ weights + bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        z -= goal
        for j, (value, slope) in enumerate(((weights, x.T @ z / n), (bias, z.mean(axis=0)))):
            state[2 * j] = 0.9 * state[2 * j] + 0.1 * slope
            state[2 * j + 1] = 0.999 * state[2 * j + 1] + 0.001 * slope**2
            value -= 0.1 * (state[2 * j] / (1 - 0.9**step)) / (np.sqrt(state[2 * j + 1] / (1 - 0.999**step)) + 1e-8)
    router = Router(weights.astype(float), bias.astype(float), scale, parts)
    probe = np.arange(n)[:: max(1, n // 512)]
    near = vectors[probe] @ vectors.T
    near[np.arange(len(probe)), probe] = -np.inf
    true = np.argpartition(-near, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)]
    order = router.order(vectors)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(n, axis=0), axis=1)
    needed = np.take_along_axis(rank[probe], order[true, 0], axis=1)
    router.probes = int(np.quantile(needed, GOAL, method="higher")) + 1
    return router


def _top(query: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, row_keys: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query as (row number of the query, vec_id, score).

    Products are added component by component in double precision, so that equal
    vectors score equal wherever they lie.
    """
    out = []
    step = max(1, (1 << 19) // max(1, len(rows)))
    columns = np.ascontiguousarray(rows.T)
    for at in range(0, len(query), step):
        part = query[at : at + step]
        total = np.zeros((len(part), len(rows)))
        for d in range(query.shape[1]):
            total += part[:, d, None] * columns[d]
        total[query_rows[at : at + step, None] == row_keys[None, :]] = -np.inf
        least = np.partition(total, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(part), -np.inf)
        for i in range(len(part)):
            good = np.flatnonzero((total[i] >= least[i]) & (total[i] > -np.inf))
            good = good[np.lexsort((row_ids[good], -total[i][good]))[:k]]
            out.append((np.full(len(good), query_rows[at + i]), row_ids[good], total[i][good]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v): each vector of an id once, in double precision, under a number of its own.

    Left out: NULL ids, and vectors that are NULL, zero, of another length than most, or hold
    a NULL or non-finite component. Different vectors of one id all stay.
    """
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    rows = settle(rows.distinct().select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def search(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every vector whose id ``every`` divides.

    Learning sees a bounded sample; then the classifier puts every vector into its most
    probable partition, and a query visits its most probable ones - as many as calibrated,
    and more while they hold fewer than k rows - where all rows are compared exactly. A large
    partition is cut into blocks of rows and blocks of queries, which meet in one task each; a task
    keeps k per query, so no group grows with the square of a partition. Ties go to
    the smaller vec_id. Where an id has several vectors, each is a row of its own: a candidate for the
    others, and a query with its own ranks. See valid_vectors for the rows that take no part; an empty table
    gives an empty table, and other columns are ignored.
    """
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid_vectors(embeddings)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    picked = rows.withColumn("pick", F.xxhash64("vec_id", "v"))
    sample = picked.where(hash_share("pick", MAX_SAMPLE / total)).toArrow().sort_by([("vec_id", "ascending"), ("pick", "ascending")])
    if sample.num_rows < 64:
        sample = picked.orderBy("vec_id", "pick").limit(64).toArrow()
    vectors = np.stack(sample.column("v").to_numpy(zero_copy_only=False)) if sample.num_rows else np.zeros((0, 1))
    router = learn(vectors, int(np.clip(np.sqrt(total) / 4, *PARTS)), k)
    sent = spark.sparkContext.broadcast((router.weights, router.bias, router.scale, router.probes))  # at most PARTS[1] columns

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                v = np.stack(frame.column("v").to_numpy(zero_copy_only=False))
                order = Router(*sent.value).order(v)
                yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["row", "vec_id", "v", "visits"])

    placed = rows.mapInArrow(place, "row long, vec_id long, v array<double>, visits array<int>")
    index = settle(placed.select("row", "vec_id", "v", F.col("visits")[0].alias("part")), "index")
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one number per partition
    most = router.weights.shape[1]
    counts = F.array(*[F.lit(held.get(p, 0)) for p in range(most)])
    # the first partitions that together hold k rows besides the query itself
    filled = F.aggregate(
        "visits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("taken")),
        lambda s, p: F.when(s["n"] > k, s).otherwise(F.struct((s["n"] + F.get(counts, p)).alias("n"), (s["taken"] + 1).alias("taken"))),
    )["taken"]
    queries = placed.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v", F.slice("visits", F.lit(1), F.greatest(filled, F.lit(router.probes))).alias("visits"))
    queries = settle(queries.select("row", "vec_id", "v", F.explode("visits").alias("part")), "visits")
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    row_blocks = F.array(*[F.lit(-(-held.get(p, 0) // ROW_BLOCK) or 1) for p in range(most)])
    query_blocks = F.array(*[F.lit(-(-asked.get(p, 0) // QUERY_BLOCK) or 1) for p in range(most)])

    def dealt(frame: DataFrame, own: str, other: str, mine, theirs) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.get(mine, F.col("part"))).cast("int")
        return frame.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.get(theirs, F.col("part")) - 1)))

    keys = ["part", "rows_block", "query_block"]
    left = dealt(index, "rows_block", "query_block", row_blocks, query_blocks)
    right = dealt(queries, "query_block", "rows_block", query_blocks, row_blocks)

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        rows, asked = rows.combine_chunks(), asked.sort_by("row").combine_chunks()
        numbers = asked.column("row").to_numpy()
        row, vec_id, score = _top(
            np.stack(asked.column("v").to_numpy()),
            numbers,
            np.stack(rows.column("v").to_numpy()),
            rows.column("row").to_numpy(),
            rows.column("vec_id").to_numpy(),
            k,
        )
        query_id = asked.column("vec_id").to_numpy()[np.searchsorted(numbers, row)]
        return pa.table({"row": row, "query_id": query_id, "vec_id": vec_id, "score": score})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "row long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
