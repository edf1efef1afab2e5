"""Low-rank adapters: A (rank x in) starts random, B (out x rank) at zero, so a new adapter changes nothing."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from quern.models.autograd import Tensor


@dataclass
class Adapter:
    rank: int
    alpha: float
    weights: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    bias: np.ndarray | None = None
    mean: np.ndarray | None = None
    whitening: np.ndarray | None = None

    @property
    def scale(self) -> float:
        return self.alpha / self.rank

    def copy(self) -> Adapter:
        c = lambda x: None if x is None else x.copy()
        return Adapter(self.rank, self.alpha, {k: (a.copy(), b.copy()) for k, (a, b) in self.weights.items()}, c(self.bias), c(self.mean), c(self.whitening))

    def parameters(self) -> int:
        return sum(a.size + b.size for a, b in self.weights.values()) + sum(x.size for x in (self.bias, self.mean, self.whitening) if x is not None)


def new_adapter(model, rank: int = 8, alpha: float | None = None, targets: str = "attention", output_bias: bool = False, seed: int = 42) -> Adapter:
    rng = np.random.default_rng(seed)
    out = Adapter(rank, float(alpha if alpha is not None else rank))
    for (layer, name), w in sorted(model.linears.items()):
        if targets == "all" or name in model.attention:
            out.weights[(layer, name)] = (rng.normal(0, 1 / np.sqrt(w.shape[1]), (rank, w.shape[1])), np.zeros((w.shape[0], rank)))
    if output_bias:
        out.bias = np.zeros(model.dim)
    return out


class Runtime:
    """An adapter as trainable tensors."""

    def __init__(self, adapter: Adapter, trainable: bool = True):
        self.adapter = adapter
        self.pairs = {k: (Tensor(a, trainable), Tensor(b, trainable)) for k, (a, b) in adapter.weights.items()}
        self.bias = Tensor(adapter.bias[None, :], trainable) if adapter.bias is not None else None

    def of(self, layer: int, name: str):
        p = self.pairs.get((layer, name))
        return None if p is None else (p[0], p[1], self.adapter.scale)

    def tensors(self) -> list[Tensor]:
        return [t for _, p in sorted(self.pairs.items()) for t in p] + ([self.bias] if self.bias is not None else [])

    def snapshot(self) -> Adapter:
        out = self.adapter.copy()
        out.weights = {k: (a.data.copy(), b.data.copy()) for k, (a, b) in self.pairs.items()}
        out.bias = None if self.bias is None else self.bias.data[0].copy()
        return out
