import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import leakage as L
from quern.llm import overlap as O
from quern.llm import packing as P
from quern.llm import splitting as S
from quern.llm import toxic as X
from quern.llm import words as W

WORDS = [f"{a}{b}{c}" for a in ("bar", "lem", "tor", "vik") for b in ("an", "el", "um", "is") for c in ("do", "ta", "ri", "ko", "ne")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_words_and_their_places():
    assert W.words("⁎1⁑Élan&nbsp;vital — <b>Bra-\nvendre</b>\n- list\n1. one") == ["elan", "vital", "bravendre", "list", "one"]
    assert W.words(None) == [] and W.words("") == [] and W.words("re\xadsu​me") == ["resume"]
    for t in ("Plain", "É&amp;<i>x</i> ⁎2⁑y-\nz\n* item", "ａｂ", "&#233;t&eacute;", "a < b > c"):
        folded, at = W.mapped(t)
        assert folded == W.fold(W.clean(t)) and len(at) == len(folded) and at == sorted(at)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=7), st.lists(st.sampled_from("abcd"), max_size=7))
def test_distance(a, b):
    d = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        e = [i + 1]
        for j, y in enumerate(b):
            e.append(min(d[j + 1] + 1, e[j] + 1, d[j] + (x != y)))
        d = np.array(e)
    want = min(int(d[-1]), 3)
    assert O.distance(a, b) == (0 if "".join(a) == "".join(b) else want) or abs(len(a) - len(b)) <= 2 and O.distance(a, b) < want


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = rng.randrange(max(1, len(s))), rng.randrange(3)
        s = s or ["only"]
        s[i : i + 1] = {0: ["zzz"], 1: [], 2: [s[i], "added"]}[kind]
    return s


def test_cross_split_pairs_against_brute_force(spark):
    rng = random.Random(4)
    lengths = [1, 2, 3, 5, 9, 20]
    train = [(i, [rng.choice(WORDS) for _ in range(rng.choice(lengths))], [rng.choice(WORDS) for _ in range(rng.choice(lengths))]) for i in range(160)]
    ev = []
    for i in range(120):
        _, a, b = rng.choice(train)
        a, b = edit(rng, a, rng.randrange(4)), edit(rng, b, rng.randrange(4))
        ev.append((1000 + i, *((b, a) if rng.random() < 0.5 else (a, b))))
    train += [(500 + i, t[1], t[2]) for i, t in enumerate(train[:9])]
    ok = lambda a, b: a and b and O.distance(a, b) <= 2
    want = {(t, e) for t, a, b in train for e, x, y in ev if ok(a, x) and ok(b, y) or ok(a, y) and ok(b, x)}
    dress = lambda s: " ".join(w.title() if i % 2 else f"<b>{w}</b>," for i, w in enumerate(s)) + " &nbsp;"
    schema = "pair_id bigint, sentence1 string, sentence2 string, class string"
    t = spark.createDataFrame([(i, dress(a), dress(b), "c") for i, a, b in train] + [(900, None, "x", "c"), (901, "", "", "c"), (None, "a", "b", "c"), (902, "?!", "a b", "c")], schema)
    e = spark.createDataFrame([(i, " ".join(a), " ".join(b), "c") for i, a, b in ev] + [(1900, None, "x", "c"), (1901, "", "", "c")] + [(ev[0][0], " ".join(ev[0][1]), " ".join(ev[0][2]), "c")], schema)
    got = {tuple(r) for r in O.cross_split_pairs(t, e).collect()}
    assert got == want and len(want) > 60
    pairs = O.cross_split_pairs(t, e)
    rep = O.overlap_report(pairs, e.select("pair_id", F.lit("dev").alias("split"), F.lit(None).cast("string").alias("source"))).first()
    assert rep["records"] == 122 and rep["links"] == len(want) and rep["overlapping"] == len({x for _, x in want})
    assert O.cross_split_pairs(t.limit(0), e).count() == 0 and O.cross_split_pairs(t, e.limit(0)).count() == 0


def check_pieces(rows, texts, limit, overlap):
    for k, t in texts.items():
        mine = sorted((r["start_pos"], r["text"]) for r in rows if r["doc"] == k)
        if len(t) <= limit:
            assert not mine
            continue
        pos = 0
        for i, (s, x) in enumerate(mine):
            assert t[s : s + len(x)] == x and 0 < len(x) <= limit and s <= pos
            if i:
                assert 0.6 * overlap <= pos - s <= 1.5 * overlap
            pos = s + len(x)
        assert pos == len(t)


@pytest.mark.parametrize("size", [512, 1500, 5000, 65536])
def test_pieces_and_hard_stretches_do_not_depend_on_ranges(spark, size):
    rng = random.Random(size)
    texts = {1: text(rng, 900).replace("ta ", "ta. "), 2: "x" * 5000, 3: "a b " * 100 + "=" * 1201 + " " + text(rng, 300) + "_" * 3100, 4: "", 5: "short", 6: "字" * 1300 + "。" + "字" * 1200, 7: "\n" * 4000, 8: ("y" * 1200 + " ") * 5, 9: "é🚀 " * 2500}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(1, texts[1], 2), (1, None, 3), (None, "z" * 2000, 4), (10, None, 5)], "doc_id bigint, original_text string, r int")
    check_pieces(S.split_texts(df, "doc_id", "original_text", size=size).collect(), texts, 1200, 120)
    want = set()
    for k, t in texts.items():
        if len(t) > 1200:
            want |= {(k, m.start()) for m in re.finditer(r"[^\s.!?。！？]{1201,}", t)} or {(k, -1)}
    assert {tuple(r) for r in S.found_hard(df, "doc_id", "original_text", size=size).collect()} == want
    assert S.found_hard(df.limit(0), "doc_id", "original_text").count() == 0


def test_natural_ends(spark):
    t = ("A sentence of some words here. " * 200).strip()
    ends = [t[s:e].rstrip()[-1] for s, e in S.cut(t, 0, len(t), 0, 1200, 120)]
    assert set(ends) == {"."}


def test_files_are_read_by_ranges(spark, tmp_path):
    rng = random.Random(3)
    t = text(rng, 4000).replace("ko ", "kö。\n") + "_" * 4000
    p = tmp_path / "big.txt"
    p.write_text(t, encoding="utf-8", newline="")
    (tmp_path / "empty.txt").write_text("")
    ranges = S.file_ranges(spark, [str(p), str(tmp_path / "empty.txt")], size=4_801, halo=6_000)
    check_pieces(S.split_ranges(ranges).collect(), {str(p): t}, 1200, 120)


def test_leaks(spark):
    rng = random.Random(1)
    passage = {i: text(rng, 40).split() for i in range(5)}
    filler = [text(rng, 30) for _ in range(6)]
    a = passage[0]
    edited = a[3:10] + ["zzz"] + a[11:17] + ["extra"] + a[17:24]
    dense = [w if i % 4 else "qqq" for i, w in enumerate(passage[1])]
    docs = [
        (1, filler[0] + " " + " ".join(a) + " " + filler[1]), (2, filler[1] + " " + " ".join(edited).upper()), (3, " ".join(a[5:14])), (4, " ".join(dense)), (5, None), (6, ""),
        (7, "⁎1⁑<p>" + ",&nbsp;".join(passage[2][:18]) + "</p>"), (8, " ".join(passage[3][:15])), (9, " ".join(passage[3][4:21]).replace("o ", "ó\n")), (None, " ".join(a)), (1, filler[0] + " " + " ".join(a) + " " + filler[1]),
    ]
    df = spark.createDataFrame([(k, t, 3) for k, t in docs], "doc_id bigint, text string, item_id int")
    ps = spark.createDataFrame([(i, " ".join(p)) for i, p in passage.items()] + [(9, None), (None, "x"), (10, "too short")], "item_id bigint, passage string")
    for block in (300, 20_000):
        rows = L.leaked_items(df, ps, block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 0), (2, 0), (7, 2), (9, 3)}
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["matched_words"] == 40 and docs[0][1][by[1]["start_pos"] : by[1]["end_pos"]] == " ".join(a)
    assert by[7]["matched_words"] == 18 and docs[6][1][by[7]["start_pos"] : by[7]["end_pos"]].startswith(passage[2][0])
    assert L.leaked_items(df.limit(0), ps).count() == 0 and L.leaked_items(df, ps.limit(0)).count() == 0


def test_a_long_tag_does_not_hide_a_leak(spark):
    p = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(p[:10]) + ' <img alt="' + "z " * 400 + '"> ' + " ".join(p[10:]))], "doc_id bigint, text string")
    assert L.leaked_items(docs, spark.createDataFrame([(5, " ".join(p))], "item_id bigint, text string")).first()["matched_words"] == 20


def test_words_joined_or_split(spark):
    rows = [(1, "the ice cream van shop near us", "one two three four five six"), (2, "a b c d e", "seven eight nine ten"), (3, "rain coat in the hall", "blue green red"), (4, "up", "down it"), (5, "an old stone bridge over water", "x y z here now")]
    held = [(11, "theicecreamvanshopnearus", "one two three four five six"), (12, "abcde", "seven eight nine eleven"), (13, "red green blue", "raincoat in the hall"), (14, "left", "right then"), (15, "anoldstone bridge over water", "xyzherenow"), (16, "the ice cream van shop near us", "quite another one altogether here now")]
    cols = "pair_id bigint, sentence1 string, sentence2 string"
    got = {tuple(r) for r in O.cross_split_pairs(spark.createDataFrame(rows, cols), spark.createDataFrame(held, cols)).collect()}
    assert got == {(1, 11), (2, 12), (3, 13), (4, 14), (5, 15)}
    assert O.distance("a bc d x".split(), "ab c d y".split()) == 1 and O.distance("a b c".split(), "d e f".split()) == 3


def test_leaks_behind_an_early_cluster_of_edits(spark):
    p = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(40)]
    swap = lambda at, n=40: " ".join(f"zq{chr(97 + i)}" if i in at else w for i, w in enumerate(p[:n]))
    docs = spark.createDataFrame([(1, swap((7, 9, 11))), (2, swap((5, 7, 13, 23, 24, 25)))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["matched_words"] for r in L.leaked_items(docs, spark.createDataFrame([(5, " ".join(p))], "item_id bigint, text string")).collect()}
    # 1: after the third edit the copy goes on; 2: the second run lies inside what the first one reaches (words 0 to 12)
    assert got == {1: 32, 2: 17}


def test_every_seed_counts():
    rng = random.Random(8)
    for trial in range(60):
        p = [rng.choice("abcdefgh") + rng.choice("xy") for _ in range(45)]
        d = edit(rng, p, rng.randrange(3, 12))
        seeds = [(i, j) for i in range(len(p) - L.SEED + 1) for j in range(len(d) - L.SEED + 1) if p[i : i + L.SEED] == d[j : j + L.SEED]]
        want = max((L.widest(p, d, i, j)[0] for i, j in seeds), default=0)
        got = [r for b in L._scan(SimpleNamespace(value=(str(trial), [(1, p)])))(iter([pa.record_batch([pa.array([7], pa.int64()), pa.array([" ".join(d)])], names=["doc_id", "text"])])) for r in b.to_pylist()]
        assert [r["matched_words"] for r in got] == ([want] if want >= L.WINDOW else [])


def test_packing(spark):
    rng = random.Random(2)
    docs = [(i, text(rng, rng.choice([1, 5, 40, 90, 150, 900]))) for i in range(300)] + [(1000 + i, "the same copy " * 20) for i in range(150)] + [(2000, None), (2001, ""), (2002, "word " * 3000)]
    enc = P.encoder(P.TOKENIZER)
    n = {k: len(enc.encode_ordinary(t)) for k, t in docs if t}
    rows = P.pack_texts(spark.createDataFrame(docs, "doc_id bigint, text string"), docs_per_task=200, block=64).collect()
    per, doc = {}, {}
    for r in rows:
        per[r["container_id"]] = per.get(r["container_id"], 0) + r["n_tokens"]
        doc.setdefault(r["doc_id"], []).append((r["token_start"], r["n_tokens"]))
    assert max(per.values()) <= 512 and {k: sum(s for _, s in v) for k, v in doc.items()} == n
    assert all(len(v) == -(-n[k] // 512) for k, v in doc.items())
    assert all(sum(s for _, s in sorted(v)[:i]) == sorted(v)[i][0] for v in doc.values() for i in range(len(v)))
    assert sum(per.values()) / (512 * len(per)) > 0.9
    assert P.pack_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    at = P.hilbert(grid, 3)
    assert sorted(at.tolist()) == list(range(512))
    path = grid[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


BAD = ["you are a filthy {}", "shut up you {} or else", "all of you {} should rot"]
SLURS = ["mugwump", "dunderfool", "blatherskite"]


def corpus(rng, n):
    out = []
    for i in range(n):
        s = [text(rng, 8).capitalize() + "." for _ in range(5)]
        toxic = i % 4 == 0
        if toxic:
            s.insert(rng.randrange(5), rng.choice(BAD).format(rng.choice(SLURS)) + "!")
        elif i % 4 == 1:
            s.insert(2, f"The guide lists {rng.choice(SLURS)} as a term for review.")
        out.append((i, " ".join(s), int(toxic)))
    return out


def test_toxic_spans_and_scores(spark):
    rng = random.Random(8)
    train, held = corpus(rng, 240), corpus(rng, 120)
    model = X.fit([t for _, t, _ in train], [bool(y) for _, _, y in train])
    tagger = X.Tagger(model)
    score, _ = tagger.score([t for _, t, _ in held])
    assert np.mean((score >= 0.5) == np.array([y for _, _, y in held], bool)) > 0.9
    hidden = ["Fine day. You are a fi*thy mug­wump! Bye.", "YOU ARE A FILTHY d u n d e r f o o l", "all of you bl4thersk1te should rooooot", "", None]
    assert (tagger.score(hidden)[0] >= 0.5).tolist() == [True, True, True, False, False]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in train] + [(900, hidden[0], None), (901, None, "S "), (902, "", "s"), (900, hidden[0], None)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(900, 1), (1, None), (None, 1), (7, 1), (7, 0)], "doc_id bigint, toxic int")
    rows = X.score_documents(docs, labels).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 244 and got[901]["score"] == 0 and got[902]["offences"] == []
    assert any("mug\u00adwump" in hidden[0][s["start"] : s["stop"]] for s in got[900]["offences"])
    rate = X.rates(X.score_documents(docs, labels), docs.select("doc_id", "source").distinct()).collect()
    assert {r["source"] for r in rate} == {"s", None}
    assert X.score_documents(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0] == 0
    assert X.score_documents(docs.limit(0), labels).count() == 0


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    b = X.Batch([[0, 1, 2, 3], [1], [2, 0]])
    e, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    p, moves, z = X.marginals(b, e, trans)
    want_p, want_moves = np.zeros(7), np.zeros((2, 2))
    for s, (a, n) in enumerate(zip(b.starts, b.sizes)):
        total = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            total[y] = np.exp(sum(e[a + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
        t = sum(total.values())
        assert np.isclose(z[s], np.log(t))
        for y, w in total.items():
            want_p[a : a + n] += np.array(y) * w / t
            for i in range(n - 1):
                want_moves[y[i], y[i + 1]] += w / t
    assert np.allclose(p, want_p) and np.allclose(moves, want_moves)


def test_token_marginals_are_those_of_forward_backward():
    rng = np.random.default_rng(6)
    b = X.Batch([list(range(n)) for n in (7, 1, 12, 3, 3)])
    e, trans = rng.normal(size=26) * 4, rng.normal(size=(2, 2))
    assert np.allclose(X.token_marginals(b, e, trans), X.marginals(b, e, trans)[0])
    assert len(X.token_marginals(X.Batch([]), np.zeros(0), trans)) == 0
