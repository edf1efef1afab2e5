"""Weight archives of the graph exchange format: a reader of the fields that hold weights, and names for anonymous weights by the graph."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: element types by number.
TYPES = {1: "<f4", 2: "u1", 3: "i1", 6: "<i4", 7: "<i8", 10: "<f2", 11: "<f8"}
FLOAT = 1


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("the archive is cut")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields: numbers as they are, everything else as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, at = _varint(data, at)
            if size is None or at + size > len(data):
                raise ValueError("the archive is cut or not of this format")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _numbers(value: int | memoryview) -> list[int]:
    """A repeated number, packed or one by one."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        x, at = _varint(value, at)
        out.append(x)
    return out


def _tensor(data: memoryview) -> tuple[str, np.ndarray]:
    dims, kind, name, raw, single = [], FLOAT, "", None, []
    for number, value in fields(data):
        if number == 1:
            dims += _numbers(value)
        elif number == 2:
            kind = value
        elif number == 4:
            single.append(bytes(value))
        elif number == 8:
            name = bytes(value).decode()
        elif number == 9:
            raw = value
    if kind not in TYPES:
        raise ValueError(f"{name}: element type {kind} is not read")
    x = np.frombuffer(raw if raw is not None else b"".join(single), TYPES[kind] if raw is not None else "<f4")
    return name, x.reshape(dims)


def read_archive(source: bytes | str) -> tuple[dict[str, np.ndarray], list[dict]]:
    """(name -> array, nodes as {node, op, inputs, outputs}) of an archive given as bytes or path. A cut archive raises ValueError."""
    data = memoryview(np.memmap(source, np.uint8, "r") if isinstance(source, str) else source)
    tensors, nodes = {}, []
    for number, graph in fields(data):
        if number != 7:
            continue
        for part, value in fields(graph):
            if part == 5:
                name, x = _tensor(value)
                tensors[name] = x
            elif part == 1:
                node: dict = {"node": "", "op": "", "inputs": [], "outputs": []}
                for n, v in fields(value):
                    if n in (1, 2):
                        node["inputs" if n == 1 else "outputs"].append(bytes(v).decode())
                    elif n in (3, 4):
                        node["node" if n == 3 else "op"] = bytes(v).decode()
                nodes.append(node)
    return tensors, nodes


def write_archive(tensors: dict[str, np.ndarray], nodes: list[dict]) -> bytes:
    """The same fields written; float32 tensors."""

    def number(x: int) -> bytes:
        out = b""
        while x > 0x7F:
            out, x = out + bytes([x & 0x7F | 0x80]), x >> 7
        return out + bytes([x])

    block = lambda n, x: number(n << 3 | 2) + number(len(x)) + x
    graph = b""
    for n in nodes:
        graph += block(1, b"".join([*(block(1, x.encode()) for x in n["inputs"]), *(block(2, x.encode()) for x in n["outputs"]), block(3, n["node"].encode()), block(4, n["op"].encode())]))
    for name, x in tensors.items():
        graph += block(5, block(1, b"".join(map(number, x.shape))) + number(2 << 3) + number(FLOAT) + block(8, name.encode()) + block(9, x.astype("<f4").tobytes()))
    return block(7, graph)


def trace_weights(spark: SparkSession, nodes: list[dict], names: list[str]) -> DataFrame:
    """(tensor, weight): what anonymous factors are weights of, from the graph: a product's output goes into a sum whose other input
    is a named bias. A self-join of the node table on the value between the two."""
    rows = spark.createDataFrame([(n["node"], n["op"], n["inputs"], n["outputs"]) for n in nodes], "node string, op string, inputs array<string>, outputs array<string>")
    held = spark.createDataFrame([(n,) for n in names], "tensor string")
    uses = rows.select("op", F.explode("inputs").alias("value"), F.col("outputs")[0].alias("out"))
    factor = uses.where("op = 'MatMul'").join(held, F.col("value") == F.col("tensor")).select("tensor", "out")
    bias = uses.where("op = 'Add'").join(held, F.col("value") == F.col("tensor")).where(F.col("tensor").endswith(".bias")).select(F.col("tensor").alias("bias"), F.col("out").alias("sum"))
    summed = uses.where("op = 'Add'").select(F.col("value").alias("out"), F.col("out").alias("sum"))
    return factor.join(summed, "out").join(bias, "sum").select("tensor", F.regexp_replace("bias", "bias$", "weight").alias("weight"))


def named_weights(spark: SparkSession, source: bytes | str) -> dict[str, np.ndarray]:
    """All weights of an archive by name; traced factors are turned to (out, in)."""
    tensors, nodes = read_archive(source)
    traced = {r["tensor"]: r["weight"] for r in trace_weights(spark, nodes, sorted(tensors)).collect()}  # one row a matrix of the model
    return {traced.get(n, n): x.T if n in traced else x for n, x in tensors.items()}
