"""Exact top-k search by tiled matrix products.

Query blocks meet row shards in tiles. A tile is one matrix product; each query keeps its best rows of the tile, and
the top lists are merged up a tree of shards until one list per query is left.

Blocks and shards are dealt to groups by their numbers, and every pair of a block group and a shard group is one key
of the join. So a key holds some PAIRED blocks and PAIRED shards, however many there are, and no block gathers all
shards in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provlake.llm._shared import saved

#: Queries of a block, rows of a shard, and lists that one step of the merge tree takes together.
BLOCK, SHARD, FAN_IN = 4096, 8192, 16
#: Blocks and shards of a group, about; most partitions of the join; least groups of shards, where there are as many.
PAIRED, MOST_TASKS, LEAST_GROUPS = 16, 20_000, 64
_PACKED = "dim int, part long, ids binary, vectors binary"


def _pack(size: int, floor: bool) -> Callable:
    """Batches of (id, vector) as packed blocks; vectors that are null or hold null or non-finite values are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            """The first rows of those held, size of them at most."""
            nonlocal part
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
            if len(ids) > size:
                held[dim] = [(ids[size:], vectors[size:])]
            ids, vectors = ids[:size], vectors[:size]
            part += 1
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["dim", "part", "ids", "vectors"])

        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            good = np.array(ids.is_valid()) & np.array(vectors.is_valid())
            ids, vectors = ids.filter(pa.array(good)), vectors.filter(pa.array(good))
            if not len(ids):
                continue
            size_of = np.array(vectors.value_lengths().fill_null(0), np.int64)
            flat = vectors.flatten().cast(pa.float64())
            values = np.array(flat.fill_null(np.nan), np.float64)
            start = np.cumsum(size_of) - size_of
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            fine = bad[start + size_of] == bad[start]
            numbers = np.array(ids, np.int64)
            for dim in np.unique(size_of[fine]).tolist():
                rows = np.flatnonzero(fine & (size_of == dim))
                block = values[(start[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)
                held.setdefault(dim, []).append((numbers[rows], np.floor(256 * block) if floor else block))
                while sum(len(i) for i, _ in held.get(dim, [])) >= size:
                    yield flush(dim)
        for dim in list(held):
            while dim in held:
                yield flush(dim)

    return run


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats only where those are exact. Products beyond 64 bits are refused."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    if bound < 2**63:
        return queries.astype(np.int64) @ rows.T.astype(np.int64)
    whole = np.array([[int(x) for x in v] for v in queries.tolist()], object) @ np.array([[int(x) for x in v] for v in rows.tolist()], object).T
    if max(map(abs, whole.ravel().tolist()), default=0) >= 2**63 - 1:
        raise ValueError("an inner product needs more than 64 bits")
    return whole.astype(np.int64)


_NONE = np.iinfo(np.int64).min


def _cut(qid: np.ndarray, rid: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query's (id, score), an id once with its highest score: higher scores, then smaller ids."""
    order = np.lexsort((-score, rid, qid))
    qid, rid, score = qid[order], rid[order], score[order]
    new = np.ones(len(qid), bool)
    new[1:] = (qid[1:] != qid[:-1]) | (rid[1:] != rid[:-1])
    qid, rid, score = qid[new], rid[new], score[new]
    order = np.lexsort((rid, -score, qid))
    qid, rid, score = qid[order], rid[order], score[order]
    keep = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return qid[keep], rid[keep], score[keep]


def _partial(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best rows of each query of a tile; rid ascends. A query's own id is no answer."""
    first = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
    ids = rid[first]
    found = []
    for a in range(0, len(qid), 256):
        mine = qid[a : a + 256]
        score = scores(q[a : a + 256], r)
        if len(first) < len(rid):
            score = np.maximum.reduceat(score, first, axis=1)
        score[mine[:, None] == ids[None, :]] = _NONE
        n = len(ids)
        # all that reach the k-th score, so that ties are decided by the id
        least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(mine), _NONE)
        row, col = np.nonzero((score >= least[:, None]) & (score != _NONE))
        found.append(_cut(mine[row], ids[col], score[row, col], k))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tile(k: int) -> Callable:
    """Top lists of the blocks; tiles of one block that follow each other are merged here already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, lists = None, 0, []

        def flush() -> pa.RecordBatch:
            qid, rid, score = _cut(*(np.concatenate(x) for x in zip(*lists)), k)
            return pa.RecordBatch.from_arrays([pa.array(qid), pa.array(rid), pa.array(score), pa.array(np.full(len(qid), group, np.int64))], names=["query_id", "vec_id", "score", "part"])

        for batch in batches:
            for n in range(batch.num_rows):
                tile = batch.slice(n, 1).to_pylist()[0]
                if at != (tile["block"], tile["part_group"]):
                    if lists:
                        yield flush()
                    at, group, lists = (tile["block"], tile["part_group"]), tile["part_group"], []
                dim = tile["dim"]
                qid, rid = np.frombuffer(tile["q_ids"], np.int64), np.frombuffer(tile["r_ids"], np.int64)
                q = np.frombuffer(tile["q_vectors"], np.float64).reshape(len(qid), dim)
                r = np.frombuffer(tile["r_vectors"], np.float64).reshape(len(rid), dim)
                order = np.argsort(rid, kind="stable")
                lists.append(_partial(qid, q, rid[order], r[order], k))
        if lists:
            yield flush()

    return run


def _groups(blocks: int, shards: int) -> tuple[int, int]:
    """Number of groups of blocks and of shards."""
    return max(1, -(-blocks // PAIRED)), max(1, -(-shards // PAIRED), min(shards, LEAST_GROUPS))


def tiles(q: DataFrame, r: DataFrame) -> tuple[DataFrame, int]:
    """Every block with every shard of its dimension, and the number of groups of shards."""
    block_groups, part_groups = _groups(q.count(), r.count())
    group = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumnsRenamed({"part": "block", "ids": "q_ids", "vectors": "q_vectors"}).withColumn("block_group", group("block", block_groups)).withColumn("part_group", every(part_groups))
    r = r.withColumnsRenamed({"ids": "r_ids", "vectors": "r_vectors"}).withColumn("part_group", group("part", part_groups)).withColumn("block_group", every(block_groups))
    key, n = ["dim", "block_group", "part_group"], min(block_groups * part_groups, MOST_TASKS)
    met = q.repartition(n, *key).join(r.repartition(n, *key).hint("merge"), key)
    return met.select("dim", "block", "part_group", "q_ids", "q_vectors", "r_ids", "r_vectors"), part_groups


def topk(rows: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", quantised: bool = True) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the highest inner product for each query.

    Rows and queries with a null id, or a vector that is null or holds null or non-finite values, take no part;
    vectors of different lengths are not compared. A row with the query's own id is no answer. Ties go to the smaller
    id. An id counts once: where several rows or queries have one id, equal or not, its score is the highest of theirs.
    Fewer rows than k are all returned; an empty table gives an empty one. quantised: components are floor(256 * x) of
    doubles. Scores are 64-bit integers; an inner product beyond them is an error.
    """
    column = [F.col(id).cast("long").alias("id"), F.col(vector).alias("vector")]
    q = saved(queries.select(*column).mapInArrow(_pack(BLOCK, quantised), _PACKED), "topk-queries")
    r = saved(rows.select(*column).mapInArrow(_pack(SHARD, quantised), _PACKED), "topk-rows")
    met, left = tiles(q, r)
    best = met.mapInArrow(_tile(k), "query_id long, vec_id long, score long, part long")
    ranked = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    while True:
        left = -(-left // FAN_IN)
        best = best.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("query_id", "part", "vec_id").agg(F.max("score").alias("score"))
        best = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        if left <= 1:
            break
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
