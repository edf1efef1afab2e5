"""A varied subset by distributed farthest-first selection (k-center).

Blocks of rows select farthest-first on their own; the picks are pooled, placed in cells around a bounded set of pivots and run
farthest-first again cell by cell, which gives each pick its gap: the squared distance to the picks before it. Cells do not know each
other's picks, so each pick then visits the cells around it and its gap becomes the distance to the nearest pick with a larger gap
there. The k picks with the largest gaps are taken. A large group of similar rows keeps one pick with a large gap, however many blocks
and cells it is spread over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vectors as V
from quern.session import durable, local_broadcast

#: Rows of a block or, on average, of a cell; pivots at most; cells that a pick is compared in; picks of a cell in order, the rows
#: beyond them keep their distance to these.
BLOCK, PIVOTS, REACH, CELL_PICKS = 4_096, 4_096, 8, 16_384


def farthest_first(u: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of selection, and each one's squared distance to the rows selected before (4 for the first)."""
    picks, gaps, _ = _select_far(u, most)
    return picks, gaps


def _select_far(u: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """farthest_first and every row's squared distance to the nearest selected one."""
    n = len(u)
    most = min(n, most)
    picks, gaps = np.empty(most, np.int64), np.empty(most)
    near = np.full(n, 4.0, np.float32)
    left = np.ones(n, bool)
    at = int(np.argmin(u @ u.mean(0))) if n else 0
    for i in range(most):
        picks[i], gaps[i] = at, near[at]
        near = np.minimum(near, 2 - 2 * (u @ u[at]))
        left[at] = False
        at = int(np.argmax(np.where(left, near, -1)))
    return picks, np.maximum(gaps, 0), np.maximum(near, 0)


def _blocks(dim: int, share: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k: list[np.ndarray] = []
        held_v: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, v = np.concatenate(held_k), np.concatenate(held_v)
            held_k.clear(), held_v.clear()
            for s in range(0, len(keys), BLOCK):
                u = V.unit(v[s : s + BLOCK]).astype(np.float32)
                picks, _ = farthest_first(u, math.ceil(share * len(u)))
                yield pa.record_batch([pa.array(keys[s + picks], pa.int64()), pa.array(list(v[s + picks].astype(np.float32)), pa.list_(pa.float32()))], names=["key", "vector"])

        size = 0
        for b in it:
            _, keys, v = V.valid_block(b, dim)
            held_k.append(keys), held_v.append(v)
            size += len(keys)
            if size >= 2 * BLOCK:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return run


def _cells(sent, dim: int, reach: int):
    """(cell, home, key, vector): a row in its `reach` nearest cells, the nearest one being its home."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        take = min(reach, len(pivots))
        for b in it:
            rows, keys, v = V.valid_block(b, dim)
            if len(keys):
                near = -(V.unit(v) @ pivots.T)
                cell = np.argsort(near, axis=1, kind="stable")[:, :take] if take > 1 else np.argmin(near, axis=1)[:, None]
                at = np.repeat(np.arange(len(keys)), take)
                more = [b.column(i).take(pa.array(rows[at])) for i in range(2, b.num_columns)]
                yield pa.record_batch([pa.array(cell.ravel(), pa.int32()), pa.array(keys[at], pa.int64()), b.column(1).take(pa.array(rows[at])), *more], names=["cell", "key", "vector", *b.schema.names[2:]])

    return run


def _select(dim: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in V.runs(it, "cell"):
            for b in t.combine_chunks().select(["key", "vector", "cell"]).to_batches():
                rows, keys, v = V.valid_block(b, dim)
                cell = b.column(2).to_numpy(zero_copy_only=False)[rows]
                u = V.unit(v).astype(np.float32)
                for lo, hi in V.spans(cell) if len(cell) else []:
                    picks, gaps, near = _select_far(u[lo:hi], CELL_PICKS)
                    gap = near.astype(np.float64)
                    gap[picks] = gaps
                    yield pa.record_batch([pa.array(keys[lo:hi], pa.int64()), b.column(1).take(pa.array(rows[lo:hi])), pa.array(np.round(gap, 6))], names=["key", "vector", "gap"])

    return run


def _compared(dim: int):
    """(key, gap) of the rows of each cell: the least of the gap and the squared distances to the rows there with a larger gap (of
    equal ones, a smaller key)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in V.runs(it, "cell"):
            for b in t.combine_chunks().select(["key", "vector", "cell", "gap"]).to_batches():
                rows, keys, v = V.valid_block(b, dim)
                cell, gap = (b.column(i).to_numpy(zero_copy_only=False)[rows] for i in (2, 3))
                u = V.unit(v).astype(np.float32)
                for lo, hi in V.spans(cell) if len(cell) else []:
                    order = np.lexsort((keys[lo:hi], -gap[lo:hi])) + lo
                    x, near = u[order], gap[order].copy()
                    for s in range(0, len(order), 1024):
                        e = min(len(order), s + 1024)
                        far = 2 - 2 * (x[s:e] @ x[:e].T)
                        far[:, s:e][np.triu_indices(e - s)] = 4
                        near[s:e] = np.minimum(near[s:e], np.maximum(0, far.min(1)))
                    yield pa.record_batch([pa.array(keys[order], pa.int64()), pa.array(np.round(near, 6))], names=["key", "gap"])

    return run


def varied_subset(vectors: DataFrame, share: float = 0.01, dim: int = 128, oversample: float = 4.0, seed: int = 5) -> DataFrame:
    """(key, gap) of round(share x valid rows) rows of (key, vector), at least one if any is valid; gap is the squared distance at
    which the row was selected.

    Null keys and invalid vectors are not selected; of copies at most one has a gap above 0, so copies are selected last; of equal gaps
    at the boundary the smaller key is taken. Repeated keys are one row each. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(*vectors.columns[:2])
    valid = vectors.mapInArrow(_counted(dim), "n bigint").agg(F.sum("n")).first()[0] or 0
    k = max(1, round(share * valid)) if valid else 0
    pool = durable(vectors.mapInArrow(_blocks(dim, min(1.0, share * oversample)), "key bigint, vector array<float>"))
    n = pool.count()
    most = 4 * PIVOTS  # the bound of the sample
    sample = pool.sample(min(1.0, 1.3 * most / max(1, n)), seed).limit(most).toArrow()
    blocks = [V.valid_block(b, dim)[2] for b in sample.to_batches()]
    u = V.unit(np.concatenate(blocks)) if sum(map(len, blocks)) else np.zeros((1, dim))
    pivots = u[farthest_first(u.astype(np.float32), min(PIVOTS, math.ceil(max(1, n) / BLOCK)))[0]]
    sent = local_broadcast(spark, pivots, 4 * PIVOTS * dim * 8, pivots.nbytes)
    placed = pool.mapInArrow(_cells(sent, dim, 1), "cell int, key bigint, vector array<float>")
    alone = placed.repartition(len(pivots), "cell").sortWithinPartitions("cell", "key").mapInArrow(_select(dim), "key bigint, vector array<float>, gap double")
    if len(pivots) > 1:
        around = durable(alone).mapInArrow(_cells(sent, dim, REACH), "cell int, key bigint, vector array<float>, gap double")
        alone = around.repartition(len(pivots), "cell").sortWithinPartitions("cell", "key").mapInArrow(_compared(dim), "key bigint, gap double").groupBy("key").agg(F.min("gap").alias("gap"))
    picked = durable(alone.select("key", "gap"))
    # the k largest gaps: a histogram of 4,096 bins finds the bin of the k-th, only that bin is ordered
    at = F.floor(F.col("gap") * 1024).cast("int")
    left, edge = k, None
    for row in sorted(picked.groupBy(at.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        edge = row["bin"]
        if row["count"] >= left:
            break
        left -= row["count"]
    if edge is None:
        return picked.limit(0)
    return picked.where(at > edge).unionByName(picked.where(at == edge).orderBy(F.desc("gap"), "key").limit(left))


def _counted(dim: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([pa.array([len(V.valid_block(b, dim)[1])], pa.int64())], names=["n"])

    return run
