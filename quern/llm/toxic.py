"""Abusive, hateful or sexual content: a linear-chain conditional random field tags tokens, its marginals score documents.

Labels are given for documents only, so tokens get theirs in two steps: a sentence model learns which sentences the toxic documents do
not share with the others (sentences of clean documents are clean; in toxic ones those the model is sure of are toxic), and the tokens
of a sentence take its label. The field then has emission weights for the word, its neighbours up to two places away and the words of
its sentence, all through spelling features that see through case, accents, look-alike letters, digits and stars for letters, spaced
and stretched spellings, and transition weights between clean and toxic. Training needs only array operations: a token's score is a sum
over places of a per-spelling number, so gradients are counts over spellings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import local_broadcast, spread

#: Letters of other scripts that look like Latin ones, and signs that stand for letters inside words.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвնոցԛԝαορνικτυ", "aeopcyxijsdhkmtbnngqwaopviktu")
LEET = str.maketrans("01345@$7", "oieasast")
SPACES = 1 << 16
PLACES = (0, -1, 1, -2, 2)
#: Labelled documents that are fitted on at most, and the unlabelled ones that join them, at every size, as clean ones of little weight.
TRAIN_DOCS, EXTRA_DOCS = 2_500, 2_000
UNLABELLED = 0.07

_MARK = "\\u0300-\\u036f\\u00ad\\u200b-\\u200f\\u2060"
_CJK = "\\u3040-\\u30ff\\u3400-\\u9fff"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}](?:[^\W_{_CJK}]|[*@${_MARK}])*")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|[。！？]+|\n+")
_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?: [^\W\d_]){3,}(?![^\W\d_])")
_STRETCH = re.compile(r"(.)\1+")
_INVISIBLE = re.compile(f"[{_MARK}]")


def spelling(raw: str) -> str:
    """What a token says: without accents, invisible characters and stretching, look-alikes and digits in words made letters."""
    t = raw
    if not t.isascii():
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKD", t)).casefold().translate(LOOKALIKE)
    t = t.lower()
    if any(c.isalpha() for c in t) and not t.isalpha():
        t = t.translate(LEET)
    return _STRETCH.sub(r"\1", t)


def features(raw: str) -> list[int]:
    """Hashed spelling features of a token; 0 is the bias."""
    t = spelling(raw)
    if not any(c.isalpha() for c in t):
        return [0, crc32(b"#number") % SPACES]
    out = [0, crc32(b"w" + t.encode()) % SPACES]
    if "*" in t:
        out.append(crc32(b"#star") % SPACES)
    if len(t) > 3:
        out.append(crc32(b"p" + t[:4].encode()) % SPACES)
        edge = f"^{t}$"
        out += [crc32(b"g" + edge[i : i + 4].encode()) % SPACES for i in range(len(edge) - 3)]
    return out


def sentences(text: str) -> list[list[str]]:
    """Tokens by sentence; letters spaced one by one are one token."""
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    return [t for s in _SENTENCE.split(text) if s and (t := _TOKEN.findall(s))]


class Lexicon:
    """Numbers tokens as they come and keeps their features in one flat array."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.flat: list[int] = []
        self.sizes: list[int] = []

    def number(self, tokens: list[str]) -> list[int]:
        ids = self.ids
        try:
            return [ids[t] for t in tokens]
        except KeyError:
            for t in tokens:
                if t not in ids:
                    ids[t] = len(ids)
                    f = features(t)
                    self.flat += f
                    self.sizes.append(len(f))
            return [ids[t] for t in tokens]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.flat, np.int64), np.repeat(np.arange(len(self.sizes)), self.sizes)


class Batch:
    """Sentences as flat token numbers with sentence numbers and places in the sentence."""

    def __init__(self, sents: list[list[int]]):
        self.sizes = np.array([len(s) for s in sents], np.int64)
        self.tokens = np.array([t for s in sents for t in s], np.int64)
        self.sent = np.repeat(np.arange(len(sents)), self.sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if len(sents) else np.zeros(0, np.int64)
        self.place = np.arange(len(self.tokens)) - self.starts[self.sent]

    def neighbours(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, positions of their neighbour at this distance), within sentences."""
        ok = np.flatnonzero((self.place + shift >= 0) & (self.place + shift < self.sizes[self.sent]))
        return ok, ok + shift


def emissions(b: Batch, near: np.ndarray, bag: np.ndarray) -> np.ndarray:
    """Score of toxic against clean of each token. near: (places, spellings), bag: (spellings)."""
    e = np.zeros(len(b.tokens))
    for row, shift in zip(near, PLACES):
        at, other = b.neighbours(shift)
        e[at] += row[b.tokens[other]]
    mean = np.bincount(b.sent, bag[b.tokens], len(b.sizes)) / np.sqrt(np.maximum(b.sizes, 1))
    return e + mean[b.sent]


def marginals(b: Batch, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of toxic per token, expected transitions (2, 2), log partition per sentence) by forward-backward over all
    sentences at once, longest first."""
    order = np.argsort(-b.sizes, kind="stable")
    sizes, starts = b.sizes[order], b.starts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sentences longer than t
    fwd = np.zeros((len(e), 2))
    bwd = np.zeros((len(e), 2))
    z = np.zeros(len(b.sizes))
    for t in range(longest):
        at = starts[: live[t]] + t
        if t:
            prev = fwd[at - 1]
            fwd[at, 0] = np.logaddexp(prev[:, 0] + trans[0, 0], prev[:, 1] + trans[1, 0])
            fwd[at, 1] = np.logaddexp(prev[:, 0] + trans[0, 1], prev[:, 1] + trans[1, 1]) + e[at]
        else:
            fwd[at, 1] = e[at]
    for t in range(longest - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        to0, to1 = bwd[at + 1, 0], bwd[at + 1, 1] + e[at + 1]
        bwd[at, 0] = np.logaddexp(trans[0, 0] + to0, trans[0, 1] + to1)
        bwd[at, 1] = np.logaddexp(trans[1, 0] + to0, trans[1, 1] + to1)
    if len(sizes):
        end = starts + sizes - 1
        z[order] = np.logaddexp(fwd[end, 0], fwd[end, 1])
    p = np.exp(np.minimum(0, fwd[:, 1] + bwd[:, 1] - z[b.sent])) if len(e) else np.zeros(0)
    at, nxt = b.neighbours(1)
    moves = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            moves[i, j] = np.exp(np.minimum(0, fwd[at, i] + trans[i, j] + (e[nxt] if j else 0) + bwd[nxt, j] - z[b.sent[at]])).sum()
    return p, moves, z


def token_marginals(b: Batch, e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The probabilities of marginals() alone: forward and backward messages as log odds of toxic against clean."""
    order = np.argsort(-b.sizes, kind="stable")
    sizes, starts = b.sizes[order], b.starts[order]
    live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
    (a00, a01), (a10, a11) = np.exp(trans)
    odds = lambda x: np.exp(np.clip(x, -60, 60))
    fwd, bwd = e.copy(), np.zeros(len(e))
    for t in range(1, len(live)):
        at = starts[: live[t]] + t
        r = odds(fwd[at - 1])
        fwd[at] += np.log((a01 + a11 * r) / (a00 + a10 * r))
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        r = odds(e[at + 1] + bwd[at + 1])
        bwd[at] = np.log((a10 + a11 * r) / (a00 + a01 * r))
    return 1 / (1 + odds(-(fwd + bwd)))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.02 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.98**self.t)) + 1e-8)


def sentence_labels(b: Batch, flat: np.ndarray, owner: np.ndarray, doc: np.ndarray, toxic: np.ndarray, trust: np.ndarray, rounds: int = 4, steps: int = 25) -> np.ndarray:
    """Sentence labels (1, 0, or -1 for unsure) from document labels, by a sentence model that is refitted on its own sure decisions."""
    types = len(np.bincount(owner)) if len(owner) else 0
    n = len(b.sizes)
    y = toxic[doc].astype(float)
    weight = np.where(y > 0, 0.3, 1.0)
    root = np.sqrt(np.maximum(b.sizes, 1))
    p = y
    for _ in range(rounds):
        w = np.zeros(SPACES)
        opt = Adam(SPACES, 0.1)
        for _ in range(steps):
            bag = np.bincount(owner, w[flat], types)
            s = np.bincount(b.sent, bag[b.tokens], n) / root
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            g = weight * trust[doc] * (p - y) / root
            gt = np.bincount(b.tokens, g[b.sent], types)
            opt.step(w, np.bincount(flat, gt[owner], SPACES) / max(1, n) + 1e-5 * w)
        # in a toxic document the likeliest sentence is toxic, and every other that the model is sure of
        top = np.zeros(len(toxic))
        np.maximum.at(top, doc, p)
        sure = (p > 0.5) | ((p >= top[doc]) & (p > 0.25))
        y = (toxic[doc] & sure).astype(float)
        weight = np.where(toxic[doc] & ~sure & (p > 0.2), 0.0, 1.0)
        weight[~toxic[doc] & (p > 0.9)] = 0.1  # probably a mistaken label
        weight[(trust[doc] < 1) & (p > 0.8)] = 0.0  # unlabelled, and perhaps toxic
    return np.where(weight == 0, -1, y).astype(int)


def fit(texts: list[str], toxic: list[bool], trust: list[float] | None = None, steps: int = 40) -> dict:
    """Weights of the field; an empty dict if either class is missing. trust weighs each document's label."""
    if not any(toxic) or all(toxic):
        return {}
    lex = Lexicon()
    sents, doc = [], []
    for d, t in enumerate(texts):
        for s in sentences(t):
            sents.append(lex.number(s))
            doc.append(d)
    if not sents:
        return {}
    b = Batch(sents)
    flat, owner = lex.arrays()
    types = len(lex.sizes)
    faith = np.array(trust if trust is not None else [1.0] * len(texts))
    label = sentence_labels(b, flat, owner, np.array(doc), np.array(toxic, bool), faith)
    keep = [s for s, y in zip(sents, label) if y >= 0]
    faith = faith[np.array(doc)[label >= 0]]
    label = label[label >= 0]
    b = Batch(keep)
    y = label[b.sent]
    at, nxt = b.neighbours(1)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at], y[nxt]), 1)
    near, bag, trans = np.zeros((len(PLACES), SPACES)), np.zeros(SPACES), np.zeros((2, 2))
    opt = Adam(near.size + bag.size + 4, 0.08)
    pos = max(1, label.sum())
    balance = (np.where(label > 0, min(5.0, (len(label) - pos) / pos), 1.0) * faith)[b.sent]  # toxic sentences are few
    pairs = [b.neighbours(s) for s in PLACES]
    root = np.sqrt(np.maximum(b.sizes, 1))
    w = np.zeros(near.size + bag.size + 4)
    for _ in range(steps):
        near, bag, trans = w[: near.size].reshape(near.shape), w[near.size : -4], w[-4:].reshape(2, 2)
        tn = np.stack([np.bincount(owner, row[flat], types) for row in near])
        e = emissions(b, tn, np.bincount(owner, bag[flat], types))
        p, moves, _ = marginals(b, e, trans)
        g = (p - y) * balance
        grad = np.empty_like(w)
        for i, (here, other) in enumerate(pairs):
            gt = np.bincount(b.tokens[other], g[here], types)
            grad[i * SPACES : (i + 1) * SPACES] = np.bincount(flat, gt[owner], SPACES)
        gs = np.bincount(b.sent, g, len(b.sizes)) / root
        gt = np.bincount(b.tokens, gs[b.sent], types)
        grad[near.size : -4] = np.bincount(flat, gt[owner], SPACES)
        grad[-4:] = (moves - seen).ravel()
        opt.step(w, grad / len(e) + 3e-6 * w)
    return {"near": near.astype(np.float32).copy(), "bag": bag.astype(np.float32).copy(), "trans": trans.copy()}


class Tagger:
    """Scores texts with fitted weights; numbers that depend on a spelling only are computed once a worker."""

    def __init__(self, model: dict):
        self.model, self.lex = model, Lexicon()
        self.near = np.zeros((len(PLACES), 0))
        self.bag = np.zeros(0)

    def _grow(self) -> None:
        have, want = len(self.bag), len(self.lex.sizes)
        if want > have:
            skip = sum(self.lex.sizes[have:])
            flat = np.array(self.lex.flat[-skip:], np.int64)
            owner = np.repeat(np.arange(want - have), self.lex.sizes[have:])
            self.near = np.hstack([self.near, np.stack([np.bincount(owner, row[flat], want - have) for row in self.model["near"]])])
            self.bag = np.concatenate([self.bag, np.bincount(owner, self.model["bag"][flat], want - have)])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list]:
        """(score per text, (text number, sentence number, marginals) of the toxic sentences). A text scores as its worst sentence,
        a sentence as the mean marginal of its tokens."""
        sents, doc, no = [], [], []
        for d, t in enumerate(texts):
            for i, s in enumerate(sentences(t) if t else []):
                sents.append(self.lex.number(s))
                doc.append(d), no.append(i)
        out = np.zeros(len(texts))
        if not sents:
            return out, []
        self._grow()
        b = Batch(sents)
        p = token_marginals(b, emissions(b, self.near, self.bag), self.model["trans"])
        s = np.bincount(b.sent, p, len(b.sizes)) / b.sizes
        np.maximum.at(out, np.array(doc), s)
        return out, [(doc[i], no[i], p[b.starts[i] : b.starts[i] + b.sizes[i]]) for i in np.flatnonzero(s >= 0.5)]


def spans(text: str, hits: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    """Code point ranges of the tagged tokens of the given sentences; a run of them is one range."""
    out, number, pos = [], -1, 0
    edges = [*((m.start(), m.end()) for m in _SENTENCE.finditer(text)), (len(text), len(text))]
    for stop, after in edges:
        part = text[pos:stop]
        places, skip = [], {m.start(): m.end() for m in _SPACED.finditer(part)}
        at = 0
        while m := _TOKEN.search(part, at):
            end = skip.get(m.start(), m.end())
            places.append((pos + m.start(), pos + end))
            at = end
        if places:
            number += 1
            if number in hits and len(hits[number]) == len(places):
                bad = [x for x, p in zip(places, hits[number]) if p >= 0.5]
                if bad:
                    out.append((bad[0][0], bad[-1][1]))
        pos = after
    return out


def fit_on(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, extra: int = EXTRA_DOCS) -> dict:
    """Fits on the labelled documents: (doc_id, text) and (doc_id, toxic). A document's label is its labels' majority; ties and nulls do
    not count. About `most` of the labelled documents are used and about `extra` of the unlabelled ones, which count as clean at the
    weight UNLABELLED, so that common words are known as such; both are chosen by the hash of their id."""
    votes = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).where("toxic <> 0.5")
    texts = documents.where("text is not null and text <> ''")
    share = lambda of, n: min(1_000_000_000, int(1e9 * of / max(1, n)))
    chosen = lambda df, part: df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < part)
    rows = texts.join(chosen(votes, share(most, votes.count())), "doc_id").select("text", (F.col("toxic") > 0.5).alias("toxic"), "doc_id", F.lit(1.0).alias("trust"))
    some = chosen(texts, share(extra, documents.count())).join(votes, "doc_id", "left_anti")
    t = rows.unionByName(some.select("text", F.lit(False).alias("toxic"), "doc_id", F.lit(UNLABELLED).alias("trust"))).toArrow()
    order = np.argsort(t["doc_id"].to_numpy(), kind="stable")
    texts_, toxic, trust = t["text"].to_pylist(), t["toxic"].to_pylist(), t["trust"].to_pylist()
    return fit([texts_[i] for i in order], [toxic[i] for i in order], [trust[i] for i in order])


def score_documents(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, score, offences) of every document of (doc_id, text): score in [0, 1], offences the offending code point ranges.

    Null, empty and token-less texts score 0 without offences, as does everything if the labels do not hold both classes. Texts of any
    length are scored whole; copies score alike; null ids are kept. Extra columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    model = fit_on(docs, labels, most)
    sent = local_broadcast(spark, model, 64 << 20, sum(x.nbytes for x in model.values()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        tagger = Tagger(weights) if weights else None
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                texts = b.column(1).to_pylist()
                score, hits = tagger.score(texts) if tagger else (np.zeros(len(texts)), [])
                by: dict[int, dict] = {}
                for d, s, p in hits:
                    by.setdefault(d, {})[s] = p
                marks = [[{"start": x, "stop": y} for x, y in spans(texts[d], by[d])] if d in by else [] for d in range(len(texts))]
                yield pa.record_batch([b.column(0), pa.array(np.round(score, 6)), pa.array(marks, struct)], names=["doc_id", "score", "offences"])

    return spread(docs).mapInArrow(run, f"doc_id {kind}, score double, offences array<struct<start:int,stop:int>>")


def rates(scored: DataFrame, sources: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, documents, toxic, rate) per source as written but for case and outer blanks; a null source is its own group."""
    named = sources.select("doc_id", F.lower(F.trim("source")).alias("source"))
    joined = scored.join(named, "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("toxic")).withColumn("rate", F.round(F.col("toxic") / F.col("documents"), 6))
