"""Two transformer encoders over frozen weights, with optional adapters: a post-norm bidirectional one (mean or first-token pooling) and a
causal one with grouped heads, rotary positions and gated feed-forward (last-token pooling)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quern.models.autograd import Graph, Tensor, erf, rope_table
from quern.models.lora import Adapter, Runtime
from quern.models.quantised import MATRICES, attention


@dataclass(frozen=True)
class BertConfig:
    vocab: int = 30_522
    hidden: int = 384
    layers: int = 6
    heads: int = 12
    inner: int = 1_536
    positions: int = 512
    pooling: str = "mean"


@dataclass(frozen=True)
class GemmaConfig:
    vocab: int = 262_144
    hidden: int = 640
    layers: int = 18
    heads: int = 4
    kv_heads: int = 1
    head: int = 256
    inner: int = 2_048
    positions: int = 32_768
    theta: float = 1e6


class _Model:
    attention: tuple[str, ...]

    def __init__(self, config, weights: dict[str, np.ndarray]):
        self.config, self.weights, self.dim = config, weights, config.hidden
        self.linears = {(int(n.split(".")[0]), n.split(".", 1)[1]): w for n, w in weights.items() if n.split(".")[0].isdigit() and w.ndim == 2}
        self.frozen = {n: Tensor(w) for n, w in weights.items()}

    def _linear(self, g: Graph, x: Tensor, layer: int, name: str, run: Runtime | None) -> Tensor:
        key = f"{layer}.{name}"
        return g.linear(x, self.frozen[key], self.frozen.get(key + ".bias"), run.of(layer, name) if run else None)

    def forward(self, g: Graph, ids: list[int], run: Runtime | None = None) -> Tensor:
        raise NotImplementedError

    def embed(self, ids: list[int], adapter: Adapter | None = None) -> np.ndarray:
        """Unit vector of one text's ids; zero without ids."""
        if not len(ids):
            return np.zeros(self.dim)
        z = self.forward(Graph(), list(ids)[: self.config.positions], Runtime(adapter, False) if adapter else None).data[0]
        if adapter is not None and adapter.whitening is not None:
            z = adapter.whitening @ (z - adapter.mean)
        return z / max(np.linalg.norm(z), 1e-12)


def _random(shape: dict[str, tuple], seed: int, spread: float = 0.05) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {n: np.ones(s) if n.endswith("gain") else np.zeros(s) if n.endswith("shift") else rng.uniform(-spread, spread, s) for n, s in shape.items()}


class Bert(_Model):
    attention = ("q", "k", "v", "o")

    @classmethod
    def random(cls, c: BertConfig, seed: int = 1, spread: float = 0.05) -> Bert:
        shape: dict[str, tuple] = {"words": (c.vocab, c.hidden), "places": (c.positions, c.hidden), "types": (2, c.hidden), "start.gain": (c.hidden,), "start.shift": (c.hidden,)}
        for i in range(c.layers):
            for n in "qkvo":
                shape |= {f"{i}.{n}": (c.hidden, c.hidden), f"{i}.{n}.bias": (c.hidden,)}
            shape |= {f"{i}.up": (c.inner, c.hidden), f"{i}.up.bias": (c.inner,), f"{i}.down": (c.hidden, c.inner), f"{i}.down.bias": (c.hidden,)}
            shape |= {f"{i}.{n}": (c.hidden,) for n in ("n1.gain", "n1.shift", "n2.gain", "n2.shift")}
        return cls(c, _random(shape, seed, spread))

    def forward(self, g: Graph, ids: list[int], run: Runtime | None = None) -> Tensor:
        c, f = self.config, self.frozen
        x = Tensor(f["words"].data[ids] + f["places"].data[: len(ids)] + f["types"].data[0])
        x = g.layer_norm(x, f["start.gain"], f["start.shift"])
        size = c.hidden // c.heads
        for i in range(c.layers):
            q, k, v = (self._linear(g, x, i, n, run) for n in "qkv")
            heads = []
            for h in range(c.heads):
                qh, kh, vh = (g.slice_cols(t, h * size, (h + 1) * size) for t in (q, k, v))
                heads.append(g.matmul(g.softmax(g.scale(g.matmul(qh, kh, True), size**-0.5)), vh))
            x = g.layer_norm(g.add(x, self._linear(g, g.concat_cols(heads), i, "o", run)), f[f"{i}.n1.gain"], f[f"{i}.n1.shift"])
            y = self._linear(g, g.gelu(self._linear(g, x, i, "up", run)), i, "down", run)
            x = g.layer_norm(g.add(x, y), f[f"{i}.n2.gain"], f[f"{i}.n2.shift"])
        z = g.mean_rows(x) if c.pooling == "mean" else g.row(x, 0)
        return g.add_row(z, run.bias) if run and run.bias is not None else z

    def inference(self, ids: list[int], precision: str = "fp32") -> np.ndarray:
        """embed() without a tape or adapter: single precision, all heads at once, weights in the given precision; zero without ids."""
        if not len(ids):
            return np.zeros(self.dim)
        c, ids = self.config, list(ids)[: self.config.positions]
        if not hasattr(self, "_single"):
            self._single, self._cast = {n: np.asarray(w, np.float32) for n, w in self.weights.items()}, {}
        f, make = self._single, MATRICES[precision]

        def lin(i: int, n: str, x: np.ndarray) -> np.ndarray:
            at = precision, i, n
            if at not in self._cast:
                self._cast[at] = make(f[f"{i}.{n}"])
            return (self._cast[at].product(x) + f[f"{i}.{n}.bias"]).astype(np.float32)

        def norm(x: np.ndarray, name: str) -> np.ndarray:
            x = x - x.mean(1, keepdims=True)
            return x / np.sqrt((x * x).mean(1, keepdims=True) + np.float32(1e-12)) * f[f"{name}.gain"] + f[f"{name}.shift"]

        x = norm(f["words"][ids] + f["places"][: len(ids)] + f["types"][0], "start")
        size = c.hidden // c.heads
        for i in range(c.layers):
            q, k, v = (lin(i, n, x).reshape(len(ids), c.heads, size).transpose(1, 0, 2) for n in "qkv")
            s = q @ k.transpose(0, 2, 1) * np.float32(size**-0.5)
            s = np.exp(s - s.max(2, keepdims=True))
            y = (s / s.sum(2, keepdims=True) @ v).transpose(1, 0, 2).reshape(len(ids), c.hidden)
            x = norm(x + lin(i, "o", y), f"{i}.n1")
            h = lin(i, "up", x)
            h = h * np.float32(0.5) * (1 + erf(h * np.float32(0.5**0.5)))
            x = norm(x + lin(i, "down", h), f"{i}.n2")
        z = (x.mean(0) if c.pooling == "mean" else x[0]).astype(np.float64)
        return z / max(np.linalg.norm(z), 1e-12)


class Gemma(_Model):
    attention = ("q", "k", "v", "o")

    @classmethod
    def random(cls, c: GemmaConfig, seed: int = 1, spread: float = 0.05) -> Gemma:
        shape: dict[str, tuple] = {"words": (c.vocab, c.hidden), "end.scale": (c.hidden,)}
        for i in range(c.layers):
            shape |= {f"{i}.q": (c.heads * c.head, c.hidden), f"{i}.k": (c.kv_heads * c.head, c.hidden), f"{i}.v": (c.kv_heads * c.head, c.hidden), f"{i}.o": (c.hidden, c.heads * c.head)}
            shape |= {f"{i}.gate": (c.inner, c.hidden), f"{i}.up": (c.inner, c.hidden), f"{i}.down": (c.hidden, c.inner)}
            shape |= {f"{i}.{n}": (c.hidden,) for n in ("before_attention", "after_attention", "before_mlp", "after_mlp")} | {f"{i}.q_norm": (c.head,), f"{i}.k_norm": (c.head,)}
        return cls(c, _random(shape, seed, spread))

    def forward(self, g: Graph, ids: list[int], run: Runtime | None = None) -> Tensor:
        c, f = self.config, self.frozen
        x = Tensor(f["words"].data[ids] * np.sqrt(c.hidden))
        cos, sin = rope_table(len(ids), c.head, c.theta)
        share = c.heads // c.kv_heads
        for i in range(c.layers):
            h = g.rms_norm(x, f[f"{i}.before_attention"])
            q, k, v = (self._linear(g, h, i, n, run) for n in "qkv")
            heads = []
            keys = [g.rope(g.rms_norm(g.slice_cols(k, j * c.head, (j + 1) * c.head), f[f"{i}.k_norm"]), cos, sin) for j in range(c.kv_heads)]
            values = [g.slice_cols(v, j * c.head, (j + 1) * c.head) for j in range(c.kv_heads)]
            for j in range(c.heads):
                qj = g.rope(g.rms_norm(g.slice_cols(q, j * c.head, (j + 1) * c.head), f[f"{i}.q_norm"]), cos, sin)
                heads.append(g.matmul(g.softmax(g.scale(g.matmul(qj, keys[j // share], True), c.head**-0.5), causal=True), values[j // share]))
            x = g.add(x, g.rms_norm(self._linear(g, g.concat_cols(heads), i, "o", run), f[f"{i}.after_attention"]))
            h = g.rms_norm(x, f[f"{i}.before_mlp"])
            h = g.mul(g.gelu_tanh(self._linear(g, h, i, "gate", run)), self._linear(g, h, i, "up", run))
            x = g.add(x, g.rms_norm(self._linear(g, h, i, "down", run), f[f"{i}.after_mlp"]))
        z = g.rms_norm(g.row(x, len(ids) - 1), f["end.scale"])
        return g.add_row(z, run.bias) if run and run.bias is not None else z

    def inference(self, ids: list[int], precision: str = "fp32") -> np.ndarray:
        """The same without a tape, with weights in the given precision and blockwise attention."""
        c, w = self.config, self.weights
        make = MATRICES[precision]
        if not hasattr(self, "_cast"):
            self._cast = {}
        lin = lambda i, n, x: self._cast.setdefault((precision, i, n), make(w[f"{i}.{n}"])).product(x)
        norm = lambda x, g: x / np.sqrt((x * x).mean(1, keepdims=True) + 1e-6) * (1 + g)
        cos, sin = rope_table(len(ids), c.head, c.theta)
        half = c.head // 2
        rope = lambda x: np.hstack([x[:, :half] * cos - x[:, half:] * sin, x[:, half:] * cos + x[:, :half] * sin])
        x = w["words"][ids] * np.sqrt(c.hidden)
        for i in range(c.layers):
            h = norm(x, w[f"{i}.before_attention"])
            q, k, v = (lin(i, n, h) for n in "qkv")
            part = lambda t, j: t[:, j * c.head : (j + 1) * c.head]
            heads = [attention(rope(norm(part(q, j), w[f"{i}.q_norm"])), rope(norm(part(k, j * c.kv_heads // c.heads), w[f"{i}.k_norm"])), part(v, j * c.kv_heads // c.heads), c.head**-0.5) for j in range(c.heads)]
            x = x + norm(lin(i, "o", np.hstack(heads)), w[f"{i}.after_attention"])
            h = norm(x, w[f"{i}.before_mlp"])
            gate = lin(i, "gate", h)
            h = 0.5 * gate * (1 + np.tanh(np.sqrt(2 / np.pi) * (gate + 0.044715 * gate**3))) * lin(i, "up", h)
            x = x + norm(lin(i, "down", h), w[f"{i}.after_mlp"])
        z = norm(x[-1:], w["end.scale"])[0]
        return z / max(np.linalg.norm(z), 1e-12)
