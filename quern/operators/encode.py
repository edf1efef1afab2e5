"""Encoders (text to unit vectors) behind one contract, encoding of distinct texts only, and chunk-and-encode compositions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vector as V
from quern.operators import chunk as C


class Encoder(Protocol):
    dim: int

    def encode(self, text: Column) -> Column:
        """A column of unit vectors (array<double>) for a text column; null texts count as empty."""


class HashEncoder:
    """Signed feature hashing of lower-case words: deterministic, model-free, expressible in plain SQL."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.lower(T.or_empty(text)), F.lit("[a-z0-9]+"), F.lit(0))

    def encode(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<double>")
        def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            seen: dict[str, int] = {}

            def place(w: str) -> int:
                p = seen.get(w)
                if p is None:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    h = hashlib.md5(w.encode()).hexdigest()
                    p = seen[w] = int(h[:8], 16) % dim + (dim if int(h[8], 16) % 2 else 0)
                return p

            for words in batches:
                out = []
                for ws in words:
                    n = np.bincount([place(w) for w in ws], minlength=2 * dim) if len(ws) else np.zeros(2 * dim, int)
                    v = (n[:dim] - n[dim:]).astype(float)
                    out.append(v / max(np.sqrt((v * v).sum()), 1e-12))
                yield pd.Series(out)

        return hashed(self.words(text))

    def encode_expr(self, text: Column) -> Column:
        """The same without Python: interpreted folds, for short texts."""
        place = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % self.dim
        signed = F.transform(self.words(text), lambda w: F.when(F.conv(F.substring(F.md5(w), 9, 1), 16, 10).cast("int") % 2 == 1, -place(w) - 1).otherwise(place(w) + 1))
        count = lambda s: F.transform(F.sequence(F.lit(1), F.lit(self.dim)), lambda b: (F.size(F.filter(s, lambda x: x == b)) - F.size(F.filter(s, lambda x: x == -b))).cast("double"))
        return V.l2_normalise(V.let(signed, count))


class FakeEncoder:
    """(length, first code point, 32 bits of a hash, 1): for tests of call order and shape; not a unit vector."""

    dim = 4

    def encode(self, text: Column) -> Column:
        t = T.or_empty(text)
        return F.array(F.length(t).cast("double"), F.ascii(t).cast("double"), F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("double"), F.lit(1.0))


class ModelEncoder:
    """Any callable list[str] -> (n, dim) array, made once a Python worker by `load`; batches keep their order."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, batch: int = 64):
        self.load, self.dim, self.batch = load, dim, batch

    def encode(self, text: Column) -> Column:
        load, size = self.load, self.batch

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                rows: list = [None] * len(texts)
                order = sorted(range(len(texts)), key=lambda i: len(texts.iloc[i]))  # like lengths together: less padding
                for s in range(0, len(order), size):
                    part = order[s : s + size]
                    v = np.asarray(model([texts.iloc[i] for i in part]), float)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    for i, x in zip(part, v):
                        rows[i] = x
                yield pd.Series(rows)

        return run(T.or_empty(text))


_REGISTRY: dict[str, Callable[..., Encoder]] = {"hash": HashEncoder, "fake": FakeEncoder}


def register(name: str, make: Callable[..., Encoder]) -> None:
    _REGISTRY[name] = make


def encoder(name: str, **options) -> Encoder:
    if name not in _REGISTRY:
        raise KeyError(f"no encoder {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name](**options)


def encode(df: DataFrame, text: str, by: Encoder, out: str = "vector", prompt: str = "") -> DataFrame:
    return df.withColumn(out, by.encode(T.with_prompt(F.col(text), prompt) if prompt else F.col(text)))


def encode_distinct(df: DataFrame, text: str, by: Encoder, out: str = "vector", store: DataFrame | None = None) -> DataFrame:
    """Encodes each distinct text once and joins the vectors back by the text's md5; `store` (text_key, vector) holds earlier results,
    only its misses are encoded."""
    keyed = df.withColumn("text_key", F.md5(T.or_empty(F.col(text))))
    need = keyed.select("text_key", T.or_empty(F.col(text)).alias("__text")).dropDuplicates(["text_key"])
    if store is not None:
        need = need.join(store.select("text_key"), "text_key", "left_anti")
    fresh = need.select("text_key", by.encode(F.col("__text")).alias(out))
    known = fresh if store is None else fresh.unionByName(store.select("text_key", F.col("vector").alias(out)))
    return keyed.join(known, "text_key").drop("text_key")


def chunk_and_encode(df: DataFrame, key: str, text: str, by: Encoder, length: int = 128, overlap: int = 25, aligned: bool = False, tagged: bool = False, max_chunks: int | None = None) -> DataFrame:
    """Chunks, tags where asked for, and encodes what is left after the marks are taken out; one narrow stage."""
    if aligned:
        chunks = C.chunk_aligned(df, key, text, length, overlap, max_chunks).withColumnRenamed("value", "chunk")
    else:
        chunks = C.chunk_tokens(df, key, T.covering_tokens(T.or_empty(F.col(text))), length, overlap, "", max_chunks)
    return encode(C.with_tags(chunks, "chunk") if tagged else chunks, "chunk", by)
