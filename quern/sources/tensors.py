"""Safetensors archives and adapter tables."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_WIDTH = {"F32": 4, "F16": 2, "BF16": 2}


def bf16_to_f32(raw: np.ndarray) -> np.ndarray:
    return (raw.astype(np.uint32) << 16).view(np.float32)


def f32_to_bf16(x: np.ndarray) -> np.ndarray:
    """Round to nearest, ties to even."""
    u = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return ((u + 0x7FFF + ((u >> 16) & 1)) >> 16).astype(np.uint16)


class SafeTensors:
    """name -> array of an archive given as bytes or path; F32, F16 and BF16 widen to float32. A cut file raises ValueError."""

    def __init__(self, source: bytes | str):
        self.data = np.memmap(source, np.uint8, "r") if isinstance(source, str) else np.frombuffer(source, np.uint8)
        if len(self.data) < 8:
            raise ValueError("no header")
        n = struct.unpack("<Q", self.data[:8].tobytes())[0]
        if 8 + n > len(self.data):
            raise ValueError("the header is cut")
        self.entries = {k: v for k, v in json.loads(self.data[8 : 8 + n].tobytes()).items() if k != "__metadata__"}
        self.base = 8 + n
        if any(self.base + v["data_offsets"][1] > len(self.data) for v in self.entries.values()):
            raise ValueError("the data are cut")

    def names(self) -> list[str]:
        return sorted(self.entries)

    def raw16(self, name: str) -> np.ndarray:
        e = self.entries[name]
        a, b = e["data_offsets"]
        return self.data[self.base + a : self.base + b].view(np.uint16).reshape(e["shape"])

    def read(self, name: str) -> np.ndarray:
        e = self.entries[name]
        a, b = e["data_offsets"]
        raw = self.data[self.base + a : self.base + b]
        if e["dtype"] not in _WIDTH:
            raise ValueError(f"{name}: {e['dtype']} is not read")
        x = {"F32": lambda: raw.view("<f4"), "F16": lambda: raw.view("<f2").astype(np.float32), "BF16": lambda: bf16_to_f32(raw.view("<u2"))}[e["dtype"]]()
        return np.array(x, np.float32).reshape(e["shape"])


def write_safetensors(tensors: dict[str, tuple[str, np.ndarray]]) -> bytes:
    """tensors: name -> (F32 | F16 | BF16, array)."""
    header, blobs, at = {}, [], 0
    for name, (kind, x) in tensors.items():
        blob = {"F32": lambda x: x.astype("<f4"), "F16": lambda x: x.astype("<f2"), "BF16": f32_to_bf16}[kind](x).tobytes()
        header[name] = {"dtype": kind, "shape": list(x.shape), "data_offsets": [at, at + len(blob)]}
        at += len(blob)
        blobs.append(blob)
    head = json.dumps(header).encode()
    return struct.pack("<Q", len(head)) + head + b"".join(blobs)


ADAPTER = "layer int, target string, rank int, alpha double, a array<float>, a_cols int, b array<float>, b_rows int"


def save_adapter(spark: SparkSession, adapter, path: str) -> None:
    """One row a targeted matrix; the output bias and whitening, where present, are rows of layer -1."""
    rows = []
    for (layer, target), (a, b) in sorted(adapter.weights.items()):
        rows.append((layer, target, adapter.rank, float(adapter.alpha), a.ravel().tolist(), a.shape[1], b.ravel().tolist(), b.shape[0]))
    for name in ("bias", "mean", "whitening"):
        x = getattr(adapter, name)
        if x is not None:
            rows.append((-1, name, adapter.rank, float(adapter.alpha), x.ravel().tolist(), x.shape[-1], [], 0))
    spark.createDataFrame(rows, ADAPTER).coalesce(1).write.mode("overwrite").parquet(path)


def load_adapter(spark: SparkSession, path: str):
    from quern.models.lora import Adapter

    rows = spark.read.schema(ADAPTER).parquet(path).toArrow().to_pylist()
    if not rows:
        raise ValueError(f"no adapter in {path}")
    out = Adapter(rows[0]["rank"], rows[0]["alpha"])
    for r in rows:
        a = np.array(r["a"], np.float32).reshape(-1, r["a_cols"])
        if r["layer"] >= 0:
            out.weights[(r["layer"], r["target"])] = (a, np.array(r["b"], np.float32).reshape(r["b_rows"], -1))
        else:
            setattr(out, r["target"], a if r["target"] == "whitening" else a.ravel())
    return out


def parameter_count(adapters: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return adapters.agg(F.sum(F.size("a") + F.size("b")).alias("parameters"))
