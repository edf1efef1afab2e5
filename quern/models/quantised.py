"""Weight matrices in three precisions behind one product, and attention without the whole score matrix."""

from __future__ import annotations

import numpy as np


class Float32:
    def __init__(self, w: np.ndarray):
        self.w = w.astype(np.float32)

    def product(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w.T


class Int8:
    """Per-row symmetric weights; activations are quantised per row on the fly and multiplied as integers."""

    def __init__(self, w: np.ndarray):
        self.scale, self.q = quantise_rows(w)

    def product(self, x: np.ndarray) -> np.ndarray:
        s, q = quantise_rows(x)
        return (q.astype(np.int32) @ self.q.astype(np.int32).T) * s[:, None] * self.scale[None, :]


class Int4:
    """Groups of 32 columns with a scale each; two values packed in a byte."""

    def __init__(self, w: np.ndarray, group: int = 32):
        rows, cols = w.shape
        g = w.reshape(rows, cols // group, group)
        top = np.abs(g).max(2)
        self.scale = np.where(top > 0, top / 7, 1.0)
        q = np.clip(np.rint(g / self.scale[:, :, None]), -7, 7).astype(np.int8).reshape(rows, cols) + 8
        self.packed = (q[:, 0::2] | (q[:, 1::2] << 4)).astype(np.uint8)
        self.group = group

    def product(self, x: np.ndarray) -> np.ndarray:
        q = np.empty((len(self.packed), self.packed.shape[1] * 2), np.float32)
        q[:, 0::2], q[:, 1::2] = (self.packed & 15).astype(np.float32) - 8, (self.packed >> 4).astype(np.float32) - 8
        return x @ (q * np.repeat(self.scale, self.group, 1)).T


MATRICES = {"fp32": Float32, "int8": Int8, "int4": Int4}


def quantise_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.abs(x).max(1)
    scale = np.where(top > 0, top / 127, 1.0)
    return scale, np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, scale: float, causal: bool = True, block: int = 256) -> np.ndarray:
    """Online softmax over blocks of keys: memory stays linear in the sequence."""
    n = len(q)
    top, total, out = np.full(n, -np.inf), np.zeros(n), np.zeros((n, v.shape[1]))
    for s in range(0, len(k), block):
        z = q @ k[s : s + block].T * scale
        if causal:
            z = np.where(np.arange(n)[:, None] >= np.arange(s, s + z.shape[1])[None, :], z, -np.inf)
        high = np.maximum(top, z.max(1))
        ok = high > -np.inf
        keep = np.where(ok, np.exp(np.where(ok, top - high, 0)), 1)
        p = np.where(ok[:, None], np.exp(z - np.where(ok, high, 0)[:, None]), 0)
        total, out, top = total * keep + p.sum(1), out * keep[:, None] + p @ v[s : s + block], high
    return out / np.maximum(total, 1e-30)[:, None]
