"""Records of evaluation splits that occur, exactly or almost, in a training split: a weighted cosine join.

A record's vector holds the words and the adjacent word pairs of both its sentences, weighted by rarity. Two edits in each sentence
bound from below the cosine that a true partner must have; that bound is the record's own threshold. Terms are ordered by weight, alike
in all records, and only a record's heaviest terms need a place in the inverted lists: what they leave out has a norm below the
threshold. The heaviest term that two partners share is among these in both, so lists hold prefixes on both sides. Where records meet,
lengths and word signatures are compared first; a candidate whose partial product plus the larger residual norm stays below the
threshold is pruned; the rest gets its exact product and a word-by-word comparison. Sentences of equal letters that are spaced otherwise meet by their letters.

Document frequencies are counted over all records in a table of 2^20 hashed cells, which is also the bound of what is broadcast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import words
from quern.session import durable, local_broadcast

CELLS = 1 << 20
EDITS = 2
#: Records whose vectors a worker keeps at hand.
MEMORY = 1 << 15
#: Term under which records meet all of whose words may be replaced: both sentences have at most EDITS words.
SHORT = -1


def respaced(a: list[str], b: list[str], i: int, j: int) -> tuple[int, int] | None:
    """The shortest runs of words from a[i] and b[j] that have the same letters, as their ends."""
    x, y, i, j = a[i], b[j], i + 1, j + 1
    while x != y:
        if len(x) < len(y) and y.startswith(x) and i < len(a):
            x, i = x + a[i], i + 1
        elif len(y) < len(x) and x.startswith(y) and j < len(b):
            y, j = y + b[j], j + 1
        else:
            return None
    return i, j


def distance(a: list[str], b: list[str], most: int = EDITS) -> int:
    """Words replaced, missing or added between a and b, counted up to most + 1; runs of the same letters spaced otherwise are equal."""

    def walk(i: int, j: int, left: int) -> int:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        if i == len(a) or j == len(b):
            rest = len(a) - i + len(b) - j
            return rest if rest <= left else left + 1
        best = left + 1
        if at := respaced(a, b, i, j):
            best = walk(*at, left)
        for x, y in ((i + 1, j + 1), (i + 1, j), (i, j + 1)):
            if best == 0 or left == 0:
                break
            best = min(best, 1 + walk(x, y, min(left, best - 1) - 1))
        return best

    return walk(0, 0, most)


def sentence_terms(s: list[str]) -> tuple[list[int], list[int]]:
    return [crc32(w.encode()) for w in s], [crc32(f"{x} {y}".encode()) | 1 << 32 for x, y in zip(s, s[1:])]


def cell(term: int) -> int:
    return term & CELLS - 1


def record_terms(a: list[str], b: list[str]) -> set[int]:
    return {t for s in (a, b) for part in sentence_terms(s) for t in part}


def bound(a: list[str], b: list[str], mass: float, square: dict[int, float], heaviest: float) -> float:
    """The least cosine to a record whose sentences each differ in at most EDITS words; square: a term's weight, squared."""
    lost = 0.0
    for s in (a, b):
        one, two = sentence_terms(s)
        pairs = [0.0, *(square[t] for t in two), 0.0]
        lost += sum(sorted(square[t] + x + y for t, x, y in zip(one, pairs, pairs[1:]))[-EDITS:])
    kept = max(0.0, mass - lost)
    return kept / math.sqrt(mass * (kept + 2 * EDITS * 3 * heaviest**2)) if mass > 0 else 0.0


def _normalise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = []
        for side, key, s1, s2 in zip(*(b.column(i).to_pylist() for i in range(4))):
            x, y = words(s1, False), words(s2, False)
            if x and y:
                x, y = sorted([" ".join(x), " ".join(y)])
                rows.append((side, key, hashlib.blake2b(f"{x}\n{y}".encode(), digest_size=16).digest(), x, y))
        c = list(zip(*rows)) or [[]] * 5
        yield pa.record_batch([pa.array(c[0], pa.bool_()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string())], names=["eval", "pair_id", "class", "x", "y"])


def _cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for b in it:
        at = [cell(t) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in record_terms(x.split(), y.split())]
        total += np.bincount(np.array(at, np.int64), minlength=CELLS)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "n"])


def signature(s: list[str]) -> int:
    """One of 64 bits for each word. Sentences EDITS edits apart have at most EDITS bits each that the other lacks."""
    bits = 0
    for w in s:
        bits |= 1 << (crc32(w.encode()) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def _profiles(sent):
    """A record's terms for the inverted lists, the heaviest first, with its norm, its threshold and the norm left out."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, heaviest = sent.value
        for b in it:
            out: list[list] = [[] for _ in range(9)]
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a, z = x.split(), y.split()
                square = {t: idf.item(cell(t)) ** 2 for t in record_terms(a, z)}
                mass = math.fsum(square.values())
                least = bound(a, z, mass, square, heaviest)
                ids, left, enough = [], mass, least * least * mass * (1 - 1e-9)
                for t in sorted(square, key=lambda t: (-square[t], t)):  # what stays out has a norm below the threshold
                    ids.append(t)
                    left -= square[t]
                    if least > 0 and left < enough:
                        break
                ws = [math.sqrt(square[t]) for t in ids]
                if len(a) <= EDITS and len(z) <= EDITS:
                    ids.append(SHORT), ws.append(0.0)
                for column, value in zip(out, (ids, ws, mass, least, math.sqrt(max(0.0, left)), len(a), len(z), signature(a), signature(z))):
                    column.append(value)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["class", "terms", "ws", "mass", "least", "residual", "nx", "ny", "bx", "by"])

    return run


def _compare(sent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, _ = sent.value

        @lru_cache(MEMORY)  # a record meets many candidates
        def vector(x: str, y: str) -> tuple[dict[int, float], float, list[str], list[str]]:
            a, z = x.split(), y.split()
            square = {t: idf.item(cell(t)) ** 2 for t in record_terms(a, z)}
            return square, math.fsum(square.values()), a, z

        for b in it:
            ok = []
            for ax, ay, bx, by, least in zip(*(b.column(i).to_pylist() for i in range(2, 7))):
                (ta, ma, ax, ay), (tb, mb, bx, by) = vector(ax, ay), vector(bx, by)
                same = least <= 0 or sum([ta[t] for t in ta.keys() & tb.keys()]) >= (least - 1e-9) * math.sqrt(ma * mb)
                if same:
                    same = distance(ax, bx) <= EDITS and distance(ay, by) <= EDITS or distance(ax, by) <= EDITS and distance(ay, bx) <= EDITS
                ok.append(bool(same))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], names=["ca", "cb"])

    return run


def _respaced_pairs(classes: DataFrame) -> DataFrame:
    """(ca, cb): classes of which one sentence each has the same letters, spaced otherwise."""
    one = classes.select("eval", "class", F.explode(F.array("x", "y")).alias("spaced")).withColumn("letters", F.md5(F.replace("spaced", F.lit(" "), F.lit(""))))
    some = one.groupBy("letters").agg(F.min("spaced").alias("lo"), F.max("spaced").alias("hi")).where("lo <> hi").select("letters")
    one = one.join(some, "letters")
    a = one.where("eval").select("letters", F.col("class").alias("ca"), F.col("spaced").alias("sa"))
    b = one.where("not eval").select("letters", F.col("class").alias("cb"), F.col("spaced").alias("sb"))
    return a.join(b, "letters").where("sa <> sb").select("ca", "cb")


def cross_split_pairs(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(train_id, eval_id): records (pair_id, sentence1, sentence2) whose sentences match pairwise, in either order.

    Sentences match if at most two words are replaced, missing or added; case, accents, punctuation, spacing, markup and entities do
    not count. Words joined or split count as word edits when candidates are sought, unless all letters of the sentence are equal; in
    the comparison they are equal. Records with a null, empty or word-less sentence or a null id match nothing. Copies are compared once and expanded at
    the end; a repeated row gives no repeated pair. Extra columns are ignored.
    """
    spark = train.sparkSession
    pick = lambda df, ev: df.select(F.lit(ev).alias("eval"), *[F.col(c) for c in df.columns[:3]]).toDF("eval", "pair_id", "s1", "s2").where("pair_id is not null and s1 is not null and s2 is not null")
    rows = pick(train, False).unionByName(pick(evaluation, True))
    clean = durable(rows.mapInArrow(_normalise, "eval boolean, pair_id bigint, class binary, x string, y string"))
    classes = durable(clean.groupBy("eval", "class").agg(F.first("x").alias("x"), F.first("y").alias("y")))
    counts = classes.select("x", "y").mapInArrow(_cells, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = max(1, classes.count())
    df = np.ones(CELLS)
    df[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    idf = np.maximum(0.05, np.log((total + 1) / df))
    sent = local_broadcast(spark, (idf, float(idf.max())), 16 << 20, idf.nbytes)

    schema = "class binary, terms array<bigint>, ws array<double>, mass double, least double, residual double, nx int, ny int, bx bigint, by bigint"
    profile = lambda side: classes.where(side).select("class", "x", "y").mapInArrow(_profiles(sent), schema)
    lists = lambda df: df.select(F.explode(F.arrays_zip("terms", "ws")).alias("p"), *[c for c in df.columns if c not in ("terms", "ws")]).select("p.terms", "p.ws", "*").drop("p").withColumnsRenamed({"terms": "term", "ws": "w"})
    q, t = lists(profile("eval")), lists(profile("not eval"))
    t = t.select("term", *[F.col(c).alias(f"t_{c}") for c in t.columns if c not in ("term", "w")])
    lacks = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))) <= EDITS
    near = lambda a, b: (F.abs(F.col(f"n{a}") - F.col(f"t_n{b}")) <= EDITS) & lacks(f"b{a}", f"t_b{b}") & lacks(f"t_b{b}", f"b{a}")
    fits = (near("x", "x") & near("y", "y")) | (near("x", "y") & near("y", "x"))
    hits = q.join(t, "term").where(fits).groupBy(F.col("class").alias("ca"), F.col("t_class").alias("cb")).agg(
        F.sum(F.col("w") * F.col("w")).alias("part"), F.first("mass").alias("ma"), F.first("t_mass").alias("mb"), F.greatest(F.first("least"), F.first("t_least")).alias("least"), F.first("residual").alias("ra"), F.first("t_residual").alias("rb")
    )
    # shared terms outside the lists are all in the rest of the record whose list ends first
    rest = F.greatest(F.col("ra") * F.sqrt("mb"), F.col("rb") * F.sqrt("ma"))
    alive = hits.where(F.col("part") + rest >= F.col("least") * F.sqrt(F.col("ma") * F.col("mb")) * (1 - 1e-9)).select("ca", "cb", "least")
    alive = alive.unionByName(_respaced_pairs(classes).withColumn("least", F.lit(0.0)))
    ea = classes.where("eval").select(F.col("class").alias("ca"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    tb = classes.where("not eval").select(F.col("class").alias("cb"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = alive.join(ea, "ca").join(tb, "cb").select("ca", "cb", "ax", "ay", "bx", "by", "least")
    matched = durable(pairs.mapInArrow(_compare(sent), "ca binary, cb binary"))
    me = clean.where("eval").select(F.col("class").alias("ca"), F.col("pair_id").alias("eval_id"))
    mt = clean.where("not eval").select(F.col("class").alias("cb"), F.col("pair_id").alias("train_id"))
    return matched.join(me, "ca").join(mt, "cb").select("train_id", "eval_id").distinct()


def overlap_report(pairs: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(split, source, records, overlapping, links): per split and source of evaluation (pair_id, split, source) its distinct records,
    those with a partner in training, and the links."""
    links = pairs.groupBy("eval_id").agg(F.count("*").alias("links"))
    rows = evaluation.select(F.col("pair_id").alias("eval_id"), "split", "source").distinct()
    return rows.join(links, "eval_id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("links").alias("overlapping"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
