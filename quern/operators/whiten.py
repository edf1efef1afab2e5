"""Column means, covariance and ZCA whitening: sums are taken per partition by matrix products, only d x d numbers reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.search import matrix


def moments(df: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, X'X) of the non-null vectors; each partition sends d x (d + 1) sums, added up before they are collected."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, xx = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in it:
            _, v = matrix(b)
            if len(v):
                n, s, xx = n + len(v), s + v.sum(0), xx + v.T @ v
        flat = np.concatenate([[n], s, xx.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "x"])

    rows = df.select(F.lit(0).alias("k"), vector).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(1 + dim + dim * dim)
    flat[rows["i"].to_numpy()] = rows["x"].to_numpy()
    return int(flat[0]), flat[1 : 1 + dim], flat[1 + dim :].reshape(dim, dim)


def mean_and_covariance(df: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Population covariance. Products are taken around a row of the data, so that vectors far from the origin keep their digits."""
    first = df.where(F.col(vector).isNotNull()).select(vector).first()
    if first is None:
        return 0, np.zeros(dim), np.zeros((dim, dim))
    origin = np.array(first[0], float)
    shifted = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.lit(origin.tolist()).alias("o")), lambda p: p["x"].cast("double") - p["o"])
    n, s, xx = moments(df.where(F.col(vector).isNotNull()).select(shifted.alias(vector)), vector, dim)
    mean = s / n
    return n, mean + origin, xx / n - np.outer(mean, mean)


def fit(df: DataFrame, vector: str, dim: int, floor: float = 1e-3) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, W) with W = V diag((max(eigenvalue, 0) + floor)^-1/2) V'; None below two rows."""
    n, mean, cov = mean_and_covariance(df, vector, dim)
    if n < 2:
        return None
    value, vec = np.linalg.eigh(cov)
    return mean, vec @ np.diag(1 / np.sqrt(np.maximum(value, 0) + floor)) @ vec.T


def apply(df: DataFrame, key: str, vector: str, mean: np.ndarray, w: np.ndarray) -> DataFrame:
    """(key, vector): normalise(W (v - mean)) by matrix products over Arrow batches; null vectors are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, v = matrix(b)
            if len(v):
                z = (v - mean) @ w.T
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                yield pa.record_batch([keys, pa.array(list(z), pa.list_(pa.float64()))], names=[key, vector])

    return df.select(key, vector).mapInArrow(run, f"{key} {kind}, {vector} array<double>")
