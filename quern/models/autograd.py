"""Reverse-mode differentiation over 2-D float64 arrays: a tape of closures replayed backwards. Frozen inputs get no gradient."""

from __future__ import annotations

import numpy as np


class Tensor:
    __slots__ = ("data", "grad", "trainable")

    def __init__(self, data, trainable: bool = False):
        self.data = np.asarray(data, np.float64)
        self.trainable = trainable
        self.grad = np.zeros_like(self.data) if trainable else None


class Graph:
    """Operations record how to pass gradients back; backward() replays them."""

    def __init__(self):
        self.tape = []

    def _node(self, data, inputs, back) -> Tensor:
        out = Tensor(data, any(x.trainable for x in inputs))
        if out.trainable:
            self.tape.append(lambda: back(out.grad))
        return out

    def backward(self, out: Tensor, seed) -> None:
        out.grad += seed
        for step in reversed(self.tape):
            step()
        self.tape.clear()

    @staticmethod
    def _give(x: Tensor, g) -> None:
        if x.trainable:
            x.grad += g

    def linear(self, x: Tensor, w: Tensor, b: Tensor | None = None, lora: tuple[Tensor, Tensor, float] | None = None) -> Tensor:
        """x W' + b + s (x A') B'."""
        y = x.data @ w.data.T
        if b is not None:
            y = y + b.data
        inputs = [x, w, *([b] if b is not None else []), *(lora[:2] if lora else [])]
        h = None
        if lora:
            h = x.data @ lora[0].data.T
            y = y + lora[2] * (h @ lora[1].data.T)

        def back(g):
            self._give(x, g @ w.data)
            self._give(w, g.T @ x.data if w.trainable else 0)
            if b is not None:
                self._give(b, g.sum(0) if b.trainable else 0)
            if lora:
                a, bb, s = lora
                gh = s * (g @ bb.data)
                self._give(bb, s * (g.T @ h))
                self._give(a, gh.T @ x.data)
                self._give(x, gh @ a.data)

        return self._node(y, inputs, back)

    def matmul(self, a: Tensor, b: Tensor, transpose: bool = False) -> Tensor:
        if transpose:
            return self._node(a.data @ b.data.T, [a, b], lambda g: (self._give(a, g @ b.data), self._give(b, g.T @ a.data)))
        return self._node(a.data @ b.data, [a, b], lambda g: (self._give(a, g @ b.data.T), self._give(b, a.data.T @ g)))

    def add(self, a: Tensor, b: Tensor) -> Tensor:
        return self._node(a.data + b.data, [a, b], lambda g: (self._give(a, g), self._give(b, g)))

    def add_row(self, a: Tensor, row: Tensor) -> Tensor:
        return self._node(a.data + row.data, [a, row], lambda g: (self._give(a, g), self._give(row, g.sum(0))))

    def scale(self, a: Tensor, k: float) -> Tensor:
        return self._node(a.data * k, [a], lambda g: self._give(a, g * k))

    def mul(self, a: Tensor, b: Tensor) -> Tensor:
        return self._node(a.data * b.data, [a, b], lambda g: (self._give(a, g * b.data), self._give(b, g * a.data)))

    def gelu(self, x: Tensor) -> Tensor:
        cdf = 0.5 * (1 + erf(x.data / np.sqrt(2)))
        pdf = np.exp(-0.5 * x.data**2) / np.sqrt(2 * np.pi)
        return self._node(x.data * cdf, [x], lambda g: self._give(x, g * (cdf + x.data * pdf)))

    def gelu_tanh(self, x: Tensor) -> Tensor:
        k = np.sqrt(2 / np.pi)
        t = np.tanh(k * (x.data + 0.044715 * x.data**3))
        slope = 0.5 * (1 + t) + 0.5 * x.data * (1 - t * t) * k * (1 + 3 * 0.044715 * x.data**2)
        return self._node(0.5 * x.data * (1 + t), [x], lambda g: self._give(x, g * slope))

    def layer_norm(self, x: Tensor, gain: Tensor, bias: Tensor, epsilon: float = 1e-12) -> Tensor:
        c = x.data - x.data.mean(1, keepdims=True)
        s = 1 / np.sqrt((c * c).mean(1, keepdims=True) + epsilon)
        h = c * s

        def back(g):
            self._give(gain, (g * h).sum(0))
            self._give(bias, g.sum(0))
            gh = g * gain.data
            self._give(x, s * (gh - gh.mean(1, keepdims=True) - h * (gh * h).mean(1, keepdims=True)))

        return self._node(h * gain.data + bias.data, [x, gain, bias], back)

    def rms_norm(self, x: Tensor, gain: Tensor, epsilon: float = 1e-6) -> Tensor:
        """Scales by 1 + gain."""
        s = 1 / np.sqrt((x.data * x.data).mean(1, keepdims=True) + epsilon)
        h = x.data * s

        def back(g):
            self._give(gain, (g * h).sum(0))
            gh = g * (1 + gain.data)
            self._give(x, s * (gh - h * (gh * h).mean(1, keepdims=True)))

        return self._node(h * (1 + gain.data), [x, gain], back)

    def softmax(self, x: Tensor, causal: bool = False) -> Tensor:
        z = np.where(np.tril(np.ones(x.data.shape, bool)), x.data, -np.inf) if causal else x.data
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return self._node(p, [x], lambda g: self._give(x, p * (g - (g * p).sum(1, keepdims=True))))

    def rope(self, x: Tensor, cos: np.ndarray, sin: np.ndarray) -> Tensor:
        """Rotates the two halves of each row by its position's angles."""
        h = x.data.shape[1] // 2
        a, b = x.data[:, :h], x.data[:, h:]

        def back(g):
            ga, gb = g[:, :h], g[:, h:]
            self._give(x, np.hstack([ga * cos + gb * sin, gb * cos - ga * sin]))

        return self._node(np.hstack([a * cos - b * sin, b * cos + a * sin]), [x], back)

    def slice_cols(self, x: Tensor, lo: int, hi: int) -> Tensor:
        def back(g):
            if x.trainable:
                x.grad[:, lo:hi] += g

        return self._node(x.data[:, lo:hi], [x], back)

    def concat_cols(self, parts: list[Tensor]) -> Tensor:
        at = np.cumsum([0, *(p.data.shape[1] for p in parts)])
        return self._node(np.hstack([p.data for p in parts]), parts, lambda g: [self._give(p, g[:, a:b]) for p, a, b in zip(parts, at, at[1:])])

    def row(self, x: Tensor, i: int) -> Tensor:
        def back(g):
            if x.trainable:
                x.grad[i] += g[0]

        return self._node(x.data[i : i + 1] if i >= 0 else x.data[i:][:1], [x], back)

    def mean_rows(self, x: Tensor) -> Tensor:
        n = len(x.data)
        return self._node(x.data.mean(0, keepdims=True), [x], lambda g: self._give(x, np.repeat(g, n, 0) / n))

    def l2_normalise(self, x: Tensor, floor: float = 1e-12) -> Tensor:
        n = np.maximum(np.linalg.norm(x.data, axis=1, keepdims=True), floor)
        u = x.data / n
        return self._node(u, [x], lambda g: self._give(x, (g - u * (g * u).sum(1, keepdims=True)) / n))


def erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26; absolute error below 1.5e-7. Its five coefficients are fixed values."""
    a = np.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-a * a))


def rope_table(positions: int, dim: int, theta: float = 1e6) -> tuple[np.ndarray, np.ndarray]:
    angle = np.arange(positions)[:, None] / theta ** (np.arange(dim // 2) * 2 / dim)[None, :]
    return np.cos(angle), np.sin(angle)
