"""Exact similarity search of a stated query set against all rows, hard-negative mining and rankings.

Queries go to the workers in blocks of bounded size; each partition of the documents is scored by matrix products and, where only the
best k matter, keeps k rows a query before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import local_broadcast

BLOCK = 2_048


def matrix(batch: pa.RecordBatch, at: int = 1) -> tuple[pa.Array, np.ndarray]:
    """Keys and float64 vectors of the rows of a (key, vector) batch whose vector is not null."""
    b = batch.filter(batch.column(at).is_valid())
    if not b.num_rows:
        return b.column(0), np.empty((0, 0))
    flat = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return b.column(0), flat.reshape(b.num_rows, -1)


def _normal(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def query_blocks(queries: DataFrame, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stated query set (key, vector) in blocks of at most about `block` rows."""
    q = queries.select(*queries.columns[:2]).toDF("qk", "qv").where("qk is not null and qv is not null")
    n = max(1, math.ceil(q.count() / block))
    for i in range(n):
        t = (q if n == 1 else q.where(F.pmod(F.xxhash64("qk"), F.lit(n)) == i)).toArrow().combine_chunks()
        if t.num_rows:
            keys, v = matrix(t.to_batches()[0])
            yield keys.to_numpy(zero_copy_only=False), v


def scores(queries: DataFrame, docs: DataFrame, k: int | None = None, normalise: bool = True, exclude_self: bool = False, at_most: float | None = None, upper: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score) of every query with every document, or with its k best; score is rounded to 6 decimals.

    queries and docs are (bigint key, vector); null keys and vectors have no score. exclude_self leaves out equal keys, upper all but
    larger doc_ids (a query's products start at the first of them), at_most higher scores. Ties go to the smaller doc_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(docs.columns[0]).cast("bigint").alias("doc_id"), F.col(docs.columns[1]).alias("v")).where("doc_id is not null and v is not null")
    out = None
    for qk, qv in query_blocks(queries, block):
        sent = local_broadcast(spark, (qk.astype(np.int64), _normal(qv) if normalise else qv), 256 << 20, qv.nbytes)

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, u = sent.value
            for b in it:
                ids, v = matrix(b)
                if not len(ids):
                    continue
                ids = ids.to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], (_normal(v) if normalise else v)[order]
                s = np.round(u @ v.T, 6) if not upper else _upper(keys, u, ids, v)
                if exclude_self:
                    s[keys[:, None] == ids[None, :]] = -np.inf
                if at_most is not None:
                    s[s > at_most] = -np.inf
                if k is None:
                    r, c = np.nonzero(s > -np.inf)
                else:
                    c = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    r = np.repeat(np.arange(len(s)), c.shape[1])
                    c = c.ravel()
                    ok = s[r, c] > -np.inf
                    r, c = r[ok], c[ok]
                yield pa.record_batch([pa.array(keys[r], pa.int64()), pa.array(ids[c], pa.int64()), pa.array(s[r, c] + 0.0)], names=["query_id", "doc_id", "score"])

        part = rows.mapInArrow(run, "query_id bigint, doc_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, doc_id bigint, score double")
    return out if k is None else ranked(out).where(F.col("rank") <= k)


def _upper(keys: np.ndarray, u: np.ndarray, ids: np.ndarray, v: np.ndarray, step: int = 256) -> np.ndarray:
    """Scores of each key with larger ids only; ids are sorted, queries with like keys share a product over the ids above the least."""
    s = np.full((len(keys), len(ids)), -np.inf)
    order = np.argsort(keys, kind="stable")
    for at in (order[i : i + step] for i in range(0, len(order), step)):
        first = int(np.searchsorted(ids, keys[at[0]], side="right"))
        s[at, first:] = np.round(u[at] @ v[first:].T, 6)
    s[ids[None, :] <= keys[:, None]] = -np.inf
    return s


def ranked(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint"))


def top_k(queries: DataFrame, docs: DataFrame, k: int, **how) -> DataFrame:
    return scores(queries, docs, k, **how)


def best_answer(queries: DataFrame, chunks: DataFrame, **how) -> DataFrame:
    return scores(queries, chunks, 1, **how).drop("rank")


def mine_negatives(anchors: DataFrame, positives: DataFrame, k: int, max_cosine: float = 0.95) -> DataFrame:
    """(query_id, doc_id, score, rank): the k most similar positives of other pairs, probable false negatives (cosine above max_cosine)
    left out; both are (pair_id, vector)."""
    return scores(anchors, positives, k, exclude_self=True, at_most=max_cosine)


def pair_similarity(a: DataFrame, b: DataFrame, key: str, vector: str, how: Column | None = None) -> DataFrame:
    """(key, score): cosine of the vectors with equal keys, a co-partitioned equi-join."""
    from quern.functions import vector as V

    joined = a.select(key, F.col(vector).alias("va")).join(b.select(key, F.col(vector).alias("vb")), key)
    return joined.select(key, V.cosine(F.col("va"), F.col("vb")).alias("score"))
