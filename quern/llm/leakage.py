"""Evaluation passages inside documents: one Aho-Corasick automaton over the normalised passages, each text scanned once.

The automaton holds every run of SEED consecutive words of every passage. A stretch of WINDOW words with at most EDITS edits keeps an
unbroken run of at least (WINDOW - EDITS) / (EDITS + 1) words, so with SEED = 5 for 16 words and 2 edits no stretch escapes. A seed of
every unbroken run is then extended to both sides with the edits left, on whole words, and mapped back to the original text.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import WORD, clean, fold, mapped, words
from quern.session import local_broadcast, spread

WINDOW, EDITS, SEED = 16, 2, 5
#: Characters of the passages of one automaton; more of them are scanned for in blocks.
BLOCK = 32 << 20


_BUILT: dict = {}


def reach(p: list[str], d: list[str], i: int, j: int, step: int, edits: int) -> list[tuple[int, int]]:
    """For 0..edits edits: the most words of p that can be followed from p[i] against d[j] in direction step, ending on a match, and
    the words of d that this takes."""
    best = [(0, 0)] * (edits + 1)

    def walk(a: int, b: int, used: int) -> None:
        x, y = a, b
        while 0 <= x < len(p) and 0 <= y < len(d) and p[x] == d[y]:
            x, y = x + step, y + step
        if x != a or used == 0:
            got = (abs(x - i), abs(y - j))
            for e in range(used, edits + 1):
                best[e] = max(best[e], got)
        if used < edits and 0 <= x < len(p) and 0 <= y < len(d):
            walk(x + step, y + step, used + 1)
            walk(x + step, y, used + 1)
            walk(x, y + step, used + 1)

    walk(i, j, 0)
    return best


def widest(p: list[str], d: list[str], i: int, j: int) -> tuple[int, int, int]:
    """(words of p, first and last word of d) of the widest stretch through the seed p[i:i+SEED] = d[j:j+SEED]."""
    left, right = reach(p, d, i - 1, j - 1, -1, EDITS), reach(p, d, i + SEED, j + SEED, 1, EDITS)
    e = max(range(EDITS + 1), key=lambda e: left[e][0] + right[EDITS - e][0])
    return left[e][0] + SEED + right[EDITS - e][0], j - left[e][1], j + SEED + right[EDITS - e][1] - 1


def _scan(sent):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        name, items = sent.value
        if name not in _BUILT:  # once a worker and block of passages
            _BUILT.clear()
            seeds: dict[str, list[tuple[int, int]]] = {}
            for n, (_, p) in enumerate(items):
                for i in range(len(p) - SEED + 1):
                    seeds.setdefault(" " + " ".join(p[i : i + SEED]) + " ", []).append((n, i))
            auto = ahocorasick.Automaton()
            for s, at in seeds.items():
                auto.add_word(s, (len(s), at))
            if seeds:
                auto.make_automaton()
            _BUILT[name] = auto, bool(seeds)
        auto, seeds = _BUILT[name]
        for b in it:
            ids, texts = b.column(0), b.column(1)
            out = []
            for r in range(b.num_rows if seeds else 0):
                t = texts[r].as_py()
                if not t:
                    continue
                d = words(t)
                if len(d) < WINDOW - EDITS:
                    continue
                line = " " + " ".join(d) + " "
                found: dict[int, tuple[int, int, int]] = {}
                starts, tried = None, {}
                for end, (length, at) in auto.iter(line):
                    if starts is None:
                        starts, pos = [], 0
                        for w in d:
                            starts.append(pos)
                            pos += len(w) + 1
                    j = bisect_left(starts, end - length + 1)
                    for n, i in at:
                        p = items[n][1]
                        if j + SEED <= tried.get((n, j - i), 0):  # the same unbroken run gives the same stretch
                            continue
                        got = widest(p, d, i, j)
                        if got[0] > found.get(n, (0,))[0]:
                            found[n] = got
                        x, y = i + SEED, j + SEED
                        while x < len(p) and y < len(d) and p[x] == d[y]:
                            x, y = x + 1, y + 1
                        tried[n, j - i] = y
                hits = {n: x for n, x in found.items() if x[0] >= WINDOW}
                if hits:
                    folded, where = mapped(t)
                    place = [m.span() for m in WORD.finditer(folded.replace("_", " "))]
                    for n, (count, first, last) in hits.items():
                        same = len(place) == len(d)
                        out.append((ids[r].as_py(), items[n][0], count, where[place[first][0]] if same else None, where[place[last][1] - 1] + 1 if same else None))
            if out:
                c = list(zip(*out))
                yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.int32()) for x in c[2:])], names=["doc_id", "item_id", "matched_words", "start_pos", "end_pos"])

    return run


def leaked_items(documents: DataFrame, passages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, matched_words, start_pos, end_pos): documents (id, text) that hold a stretch of at least 16 consecutive words
    of a passage (id, text), at most two of any 16 being replaced, missing or accompanied by an added word.

    matched_words is the widest such stretch, the positions are code points of the original text. Case, accents, punctuation, spacing,
    line-end hyphens, list marks, markup and page marks do not count. Null ids and null, empty or shorter texts match nothing; copies
    each have their row; repeated rows of one document repeat only the row's positions and are made distinct.
    Passages go to the workers in blocks of about `block` characters, each one scan of the documents; a longer passage is its own block.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(documents.columns[0]).cast("bigint").alias("doc_id"), F.col(documents.columns[1]).alias("text")).where("doc_id is not null and text is not null")
    pas = passages.select(F.col(passages.columns[0]).cast("bigint").alias("item_id"), F.col(passages.columns[1]).alias("text")).where("item_id is not null and text is not null")
    pas = pas.distinct()
    size = pas.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    blocks = max(1, math.ceil((size[0] or 0) / block))
    out = None
    for i in range(blocks):
        rows = pas.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).toArrow().to_pylist()
        items = [(r["item_id"], words(r["text"])) for r in rows]
        sent = local_broadcast(spark, (uuid4().hex, items), 4 * (2 * block + 4 * (size[1] or 0)), 4 * sum(len(x["text"]) for x in rows))
        part = spread(docs).mapInArrow(_scan(sent), "doc_id bigint, item_id bigint, matched_words int, start_pos int, end_pos int")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
