"""Fills containers of a fixed number of tokens with whole texts, neighbours along a Hilbert curve first.

Token ids are hashed to vectors, projected to three numbers and placed on a Hilbert curve; documents are range-sorted by their place
(ties by key, so copies cannot crowd one partition) and packed partition by partition: blocks along the curve, the largest first,
each into the fullest open container that takes it. Containers left with much room are opened again with the next block.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import durable

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DIMS, BITS = 3, 10
#: Documents that are ordered by size at a time; the reach of the packing along the curve.
BLOCK = 4_096

_ENCODERS: dict = {}


def encoder(path: str):
    """The byte-level tokenizer of a .tiktoken file, once a worker."""
    if path not in _ENCODERS:
        import base64

        import tiktoken

        try:
            from public_tokenizers import PATTERN
        except ImportError:  # the published split pattern of this vocabulary
            PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d) with `bits` bits a coordinate (Skilling's transform, over all rows at once)."""
    x = points.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= np.where(high, 0, swap) if i else 0
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def _measure(path: str):
    table = np.random.default_rng(11).standard_normal((1 << 12, DIMS)).astype(np.float32)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in it:
            n, spot = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, DIMS))
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.asarray(enc.encode_ordinary(t or ""), np.int64)
                n[i] = len(ids)
                if len(ids):
                    spot[i] = table[(ids * 0x9E3779B1 >> 7) & 0xFFF].sum(0) / math.sqrt(len(ids))
            grid = np.clip((spot + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.record_batch([b.column(0), pa.array(n), pa.array(hilbert(grid))], names=["doc_id", "n_tokens", "place"])

    return run


class Shelf:
    """Open containers by room; finds the fullest one that takes an item in a step."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def put(self, item: tuple, size: int) -> None:
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            box = self.rooms[room].pop()
            if not self.rooms[room]:
                self.mask &= ~(1 << room)
        else:
            room, box = self.capacity, []
        box.append(item)
        self.rooms[room - size].append(box)
        self.mask |= 1 << (room - size)

    def take(self, least_room: int) -> list[list]:
        """Takes out the containers with at least this room."""
        out = []
        for room in range(least_room, self.capacity + 1):
            out += self.rooms[room]
            self.rooms[room] = []
            self.mask &= ~(1 << room)
        return out


def _pack(capacity: int, block: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        pending: list[tuple] = []  # (doc, piece, start, size)

        def emit(boxes: list[list]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for box in boxes:
                rows += [(number, *item) for item in box]
                number += 1
            c = list(zip(*rows)) or [[]] * 5
            return pa.record_batch([pa.array(x, pa.int64()) for x in c], names=["container_id", "doc_id", "piece", "token_start", "n_tokens"])

        def pack(last: bool) -> pa.RecordBatch:
            shelf = Shelf(capacity)
            for item in sorted(pending, key=lambda x: -x[3]):
                shelf.put(item, item[3])
            pending.clear()
            if not last:  # what is not full is packed again with the next block
                for box in shelf.take(1 + capacity // 64):
                    pending.extend(box)
            return emit(shelf.take(0))

        for b in it:
            full = []
            for doc, n in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist()):
                whole = n // capacity if n > capacity else 0
                full += [[(doc, i, i * capacity, capacity)] for i in range(whole)]
                if n - whole * capacity:
                    pending.append((doc, whole, whole * capacity, n - whole * capacity))
                if len(pending) >= block + block // 2:
                    yield pack(False)
            if full:
                yield emit(full)
        yield pack(True)

    return run


def pack_texts(documents: DataFrame, capacity: int = 512, tokenizer: str = TOKENIZER, docs_per_task: int = 50_000, block: int = BLOCK) -> DataFrame:
    """(container_id, doc_id, piece, token_start, n_tokens) of the texts of (id, text) in containers of `capacity` tokens.

    A text of at most capacity tokens is one piece; a longer one is cut into full containers and one remainder, which is packed like a
    text. Null, empty and token-less texts are in no container; null ids are kept; repeated rows are packed each. The number of tasks
    follows the row count, so the room lost in each task's last containers stays a fixed small share.
    """
    rows = documents.select(F.col(documents.columns[0]).alias("doc_id"), F.col(documents.columns[1]).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sized = durable(rows.where("text is not null").mapInArrow(_measure(tokenizer), f"doc_id {kind}, n_tokens bigint, place bigint").where("n_tokens > 0"))
    parts = max(1, math.ceil(sized.count() / docs_per_task))
    ordered = sized.repartitionByRange(parts, "place", "doc_id", F.xxhash64("doc_id", "n_tokens")).sortWithinPartitions("place", "doc_id")
    return ordered.select("doc_id", "n_tokens").mapInArrow(_pack(capacity, block), "container_id bigint, doc_id bigint, piece bigint, token_start bigint, n_tokens bigint")


if not os.path.exists(TOKENIZER):
    TOKENIZER = os.environ.get("QUERN_TOKENIZER", TOKENIZER)
