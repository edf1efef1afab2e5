"""Adapter training on sentence pairs: losses with gradients, AdamW, schedule, hard negatives, early stop, best of several seeds."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from quern.models.autograd import Graph
from quern.models.lora import Adapter, Runtime, new_adapter


@dataclass(frozen=True)
class Options:
    rank: int = 8
    alpha: float | None = None
    targets: str = "attention"
    output_bias: bool = False
    loss: str = "contrastive"  # contrastive, cosent, regression
    epochs: int = 10
    batch: int = 16
    rate: float = 5e-4
    decay: float = 1e-4
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    warm_up: float = 0.1
    temperature: float = 0.05
    learn_temperature: bool = False
    max_tokens: int = 128
    validation: float = 0.1
    threshold: float = 0.6
    metric_threshold: float = 0.6
    negatives: int = 0
    max_negative_cosine: float = 0.95
    dims: tuple[int, ...] = ()
    patience: int = 0
    seeds: tuple[int, ...] = (42,)
    whiten: bool = False
    query_prefix: str = ""
    document_prefix: str = ""
    on_epoch: Callable | None = None
    log: Callable[[str], None] | None = None


GEMMA_DEFAULTS = Options(epochs=5, batch=8, max_tokens=64)


@dataclass
class Pair:
    anchor: str
    positive: str
    score: float | None = None
    negative: str | None = None


@dataclass
class Report:
    adapter: Adapter
    baseline: float
    best: float
    epochs: list[dict] = field(default_factory=list)


def infonce(a: np.ndarray, p: np.ndarray, temperature: float, allow: np.ndarray, extra: list[list[int]] | None = None, e: np.ndarray | None = None):
    """Symmetric loss over unit rows: (loss, d a, d p, d e, d temperature). allow[i, j]: p[j] is a candidate of a[i]; the own pair always
    is. extra[i]: rows of e that are further candidates of a[i]. A row with one candidate adds nothing."""
    n = len(a)
    s = a @ p.T / temperature
    allow = allow | np.eye(n, dtype=bool)
    loss, ds = 0.0, np.zeros_like(s)
    de = None if e is None else np.zeros_like(e)
    da, dt = np.zeros_like(a), 0.0
    for i in range(n):
        cand = np.flatnonzero(allow[i])
        more = (extra[i] if extra else []) or []
        logits = np.concatenate([s[i, cand], (e[more] @ a[i] / temperature) if len(more) else []])
        if len(logits) > 1:
            q = np.exp(logits - logits.max())
            q /= q.sum()
            own = int(np.flatnonzero(cand == i)[0])
            loss -= 0.5 / n * math.log(max(q[own], 1e-20))
            q[own] -= 1
            q *= 0.5 / n
            ds[i, cand] += q[: len(cand)]
            if len(more):
                da[i] += (q[len(cand) :, None] * e[more]).sum(0) / temperature
                np.add.at(de, more, q[len(cand) :, None] * a[i] / temperature)
                dt -= float((q[len(cand) :] * logits[len(cand) :]).sum()) / temperature
        col = np.flatnonzero(allow[:, i])
        if len(col) > 1:
            q = np.exp(s[col, i] - s[col, i].max())
            q /= q.sum()
            own = int(np.flatnonzero(col == i)[0])
            loss -= 0.5 / n * math.log(max(q[own], 1e-20))
            q[own] -= 1
            ds[col, i] += q * 0.5 / n
    da += ds @ p / temperature
    return loss, da, ds.T @ a / temperature, de, dt - float((ds * s).sum()) / temperature


def cosent(a: np.ndarray, p: np.ndarray, score: np.ndarray, temperature: float):
    """(loss, d a, d p) of log(1 + sum over score_k > score_l of exp((cos_l - cos_k) / t))."""
    c = (a * p).sum(1)
    k, l = np.nonzero(score[:, None] > score[None, :])
    if not len(k):
        return 0.0, np.zeros_like(a), np.zeros_like(p)
    z = (c[l] - c[k]) / temperature
    top = max(0.0, z.max())
    w = np.exp(z - top)
    total = math.exp(-top) + w.sum()
    w /= total * temperature
    dc = np.zeros(len(c))
    np.add.at(dc, l, w)
    np.add.at(dc, k, -w)
    return top + math.log(total), dc[:, None] * p, dc[:, None] * a


def regression(a: np.ndarray, p: np.ndarray, score: np.ndarray):
    c = (a * p).sum(1)
    dc = 2 * (c - score) / len(c)
    return float(((c - score) ** 2).mean()), dc[:, None] * p, dc[:, None] * a


class AdamW:
    """Decoupled decay before a bias-corrected step."""

    def __init__(self, tensors, o: Options):
        self.tensors, self.o, self.t = tensors, o, 0
        self.m, self.v = [np.zeros_like(x.data) for x in tensors], [np.zeros_like(x.data) for x in tensors]

    def step(self, rate: float) -> None:
        o = self.o
        self.t += 1
        for x, m, v in zip(self.tensors, self.m, self.v):
            x.data *= 1 - rate * o.decay
            m += (1 - o.beta1) * (x.grad - m)
            v += (1 - o.beta2) * (x.grad**2 - v)
            x.data -= rate * (m / (1 - o.beta1**self.t)) / (np.sqrt(v / (1 - o.beta2**self.t)) + o.epsilon)
            x.grad[:] = 0


def learning_rate(step: int, total: int, rate: float, warm_up: float) -> float:
    warm = int(warm_up * total)
    if step < warm:
        return rate * (step + 1) / warm
    return rate * 0.5 * (1 + math.cos(math.pi * min(1.0, max(0.0, (step - warm) / max(1, total - warm)))))


def average_ranks(x: np.ndarray) -> np.ndarray:
    value, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[inverse]


def spearman(a, b) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    if len(a) < 2:
        return float("nan")
    x, y = average_ranks(a) - (len(a) + 1) / 2, average_ranks(b) - (len(b) + 1) / 2
    d = math.sqrt(float((x * x).sum() * (y * y).sum()))
    return float((x * y).sum() / d) if d > 1e-10 else 0.0


class Trainer:
    def __init__(self, model, tokenise: Callable[[str], list[int]], options: Options = Options()):
        self.model, self.tokenise, self.o = model, tokenise, options
        self._ids: dict[str, list[int]] = {}

    def ids(self, text: str) -> list[int]:
        if text not in self._ids:
            self._ids[text] = self.tokenise(text)[: self.o.max_tokens]
        return self._ids[text]

    def embed(self, texts: list[str], adapter: Adapter | None) -> np.ndarray:
        seen = {t: self.model.embed(self.ids(t), adapter) for t in dict.fromkeys(texts)}
        return np.stack([seen[t] for t in texts]) if texts else np.zeros((0, self.model.dim))

    def metrics(self, pairs: list[Pair], adapter: Adapter | None) -> dict:
        """Spearman over scored pairs; retrieval accuracy and reciprocal rank over pairs that are unscored or reach the threshold."""
        a, p = self.embed([x.anchor for x in pairs], adapter), self.embed([x.positive for x in pairs], adapter)
        has = [i for i, x in enumerate(pairs) if x.score is not None]
        rho = spearman((a * p).sum(1)[has], [pairs[i].score for i in has])
        keep = [i for i, x in enumerate(pairs) if x.score is None or x.score >= self.o.metric_threshold]
        if len(keep) < 2:
            return {"spearman": rho, "accuracy": float("nan"), "mrr": float("nan")}
        s = a[keep] @ p[keep].T
        rank = 1 + (s > np.diag(s)[:, None]).sum(1)
        return {"spearman": rho, "accuracy": float((rank == 1).mean()), "mrr": float((1 / rank).mean())}

    def _primary(self, m: dict, pairs: list[Pair]) -> float:
        """What early stopping goes by: Spearman where all validation pairs are scored, else retrieval accuracy."""
        order = ("spearman", "accuracy") if all(x.score is not None for x in pairs) else ("accuracy", "spearman")
        return next((m[k] for k in order if not math.isnan(m[k])), float("-inf"))

    def examples(self, pairs: list[Pair]) -> list[Pair]:
        o = self.o
        if o.loss == "contrastive":
            kept = [x for x in pairs if x.score is None or x.score >= o.threshold]
        else:
            kept = [x for x in pairs if x.score is not None]
        return [Pair(o.query_prefix + x.anchor, o.document_prefix + x.positive, 1.0 if x.score is None else x.score, None if x.negative is None else o.document_prefix + x.negative) for x in kept]

    def mine(self, examples: list[Pair], adapter: Adapter) -> list[list[str]]:
        """Per example: its own negative and the most similar other positives below the cosine bound, ties in first-seen order."""
        own = [[x.negative] if x.negative else [] for x in examples]
        if not self.o.negatives:
            return own
        pool = list(dict.fromkeys(x.positive for x in examples))
        s = self.embed([x.anchor for x in examples], adapter) @ self.embed(pool, adapter).T
        for i, x in enumerate(examples):
            order = [j for j in np.argsort(-s[i], kind="stable") if pool[j] != x.positive and s[i, j] <= self.o.max_negative_cosine]
            own[i] += [pool[j] for j in order[: self.o.negatives]]
        return own

    def step(self, run: Runtime, batch: list[Pair], negatives: list[list[str]], temperature: float) -> tuple[float, float]:
        """Loss and temperature gradient of one batch; gradients are left in the adapter's tensors. Each distinct text runs once."""
        g = Graph()
        at: dict[str, int] = {}
        for t in [t for x, ns in zip(batch, negatives) for t in (x.anchor, x.positive, *ns)]:
            at.setdefault(t, len(at))
        outs = [self.model.forward(g, self.ids(t) or [0], run) for t in at]
        z = np.stack([o.data[0] for o in outs])
        ia, ip = [at[x.anchor] for x in batch], [at[x.positive] for x in batch]
        more = [[at[t] for t in ns] for ns in negatives]
        allow = np.array([[q.positive != x.positive and q.positive != x.anchor and q.anchor != x.anchor and q.anchor != x.positive for q in batch] for x in batch])
        dims = sorted({d for d in self.o.dims if 0 < d <= z.shape[1]} | {z.shape[1]})
        loss, dz, dt = 0.0, np.zeros_like(z), 0.0
        for d in dims:
            n = np.maximum(np.linalg.norm(z[:, :d], axis=1, keepdims=True), 1e-12)
            u = z[:, :d] / n
            du = np.zeros_like(u)
            if self.o.loss == "contrastive":
                l, da, dp, de, t = infonce(u[ia], u[ip], temperature, allow, more, u)
                du += de
                dt += t / len(dims)
            else:
                gold = np.array([x.score for x in batch])
                l, da, dp = cosent(u[ia], u[ip], gold, temperature) if self.o.loss == "cosent" else regression(u[ia], u[ip], gold)
            np.add.at(du, ia, da)
            np.add.at(du, ip, dp)
            loss += l / len(dims)
            dz[:, :d] += (du - u * (du * u).sum(1, keepdims=True)) / n / len(dims)
        for o, d in zip(outs, dz):
            if o.trainable:
                o.grad += d[None, :]
        for back in reversed(g.tape):
            back()
        g.tape.clear()
        return loss, dt

    def train(self, pairs: list[Pair]) -> Report:
        o = self.o
        order = np.random.default_rng(o.seeds[0]).permutation(len(pairs))
        nv = min(max(round(len(pairs) * o.validation), 0), max(0, len(pairs) - 1))
        held, rest = [pairs[i] for i in order[:nv]], [pairs[i] for i in order[nv:]]
        held = held or rest
        base = self._primary(self.metrics(held, None), held)
        examples = self.examples(rest)
        best, history = (float("-inf"), None), []
        for seed in o.seeds:
            run = Runtime(new_adapter(self.model, o.rank, o.alpha, o.targets, o.output_bias, seed))
            opt, rng, temperature, moment = AdamW(run.tensors(), o), np.random.default_rng(seed), o.temperature, [0.0, 0.0]
            total, done, since, top = max(1, o.epochs * math.ceil(len(examples) / o.batch)), 0, 0, float("-inf")
            for epoch in range(o.epochs):
                negatives = self.mine(examples, run.snapshot())
                shuffled, losses = rng.permutation(len(examples)), []
                for s in range(0, len(shuffled), o.batch):
                    part = shuffled[s : s + o.batch]
                    rate = learning_rate(done, total, o.rate, o.warm_up)
                    loss, dt = self.step(run, [examples[i] for i in part], [negatives[i] for i in part], temperature)
                    opt.step(rate)
                    if o.learn_temperature:
                        moment = [0.9 * moment[0] + 0.1 * dt, 0.999 * moment[1] + 0.001 * dt * dt]
                        temperature = min(1.0, max(1e-3, temperature - rate * moment[0] / (math.sqrt(moment[1]) + 1e-8)))
                    losses.append(loss)
                    done += 1
                snap = run.snapshot()
                m = self.metrics(held, snap)
                value = self._primary(m, held)
                history.append({"seed": seed, "epoch": epoch, "loss": float(np.mean(losses)) if losses else 0.0, **m})
                if o.on_epoch:
                    o.on_epoch(history[-1])
                if value > best[0] or best[1] is None:
                    best = (value, snap)
                since, top = (0, value) if value > top else (since + 1, top)
                if o.patience and since >= o.patience:
                    if o.log:
                        o.log(f"seed {seed}: early stop after epoch {epoch}")
                    break
        adapter = best[1] or new_adapter(self.model, o.rank, o.alpha, o.targets, o.output_bias, o.seeds[0])
        if o.whiten:
            adapter = self.whiten(adapter, list(dict.fromkeys(t for x in rest for t in (x.anchor, x.positive))))
        return Report(adapter, base, self._primary(self.metrics(held, adapter), held), history)

    def whiten(self, adapter: Adapter, texts: list[str], floor: float = 1e-3) -> Adapter:
        if len(texts) < 2:
            return adapter
        run = Runtime(replace(adapter, mean=None, whitening=None), False)
        z = np.stack([self.model.forward(Graph(), self.ids(t) or [0], run).data[0] for t in texts])
        mean = z.mean(0)
        value, vec = np.linalg.eigh((z - mean).T @ (z - mean) / len(z))
        return replace(adapter, mean=mean, whitening=vec @ np.diag((np.maximum(value, 0) + floor) ** -0.5) @ vec.T)
