import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import tokenize as K
from quern.plans.token_queries import BPE, VOCAB
from quern.sources.vocab import index, make_bpe, read_transliteration, read_vocabulary, rule_vocabulary, transliteration_table

STRINGS = ["Hello world", "Der schnelle Fuchs über ß", "¿Qué tal, niño?", "日本語のテキスト", "Привет, мир", "中文", "a\tb\nc", "emoji 🚀🚀 x", "x", "", "  two  blanks ", "hello????????world", "naïve café"]


def test_vocabulary_files():
    v = read_vocabulary(["a\n", "\n", "  \n", "b\n", "a\n"])
    assert v == ["a", "b", "a"] and index(v) == {"a": 2, "b": 1}
    assert len(set(rule_vocabulary())) == len(rule_vocabulary())
    assert transliteration_table()[ord("é")] == "e"
    row = "1\t" + "\t".join(repr("x" if i == 5 else "") for i in range(256))
    assert read_transliteration([row])[0x105] == "x"
    with pytest.raises(ValueError):
        read_transliteration(["1\t'a'"])


@pytest.mark.parametrize(("word", "want"), [("the", ["the"]), ("thex", ["the", "##x"]), ("q", ["[UNK]"]), ("thzz!", ["th", "[UNK]"]), ("x" * 51, []), ("", []), ("zz", ["[UNK]"])])
def test_word_pieces(word, want):
    vocab = index(["[UNK]", "the", "th", "##x", "##xx"])
    assert K.word_pieces(word, vocab) == want


def test_wordpiece_columns(spark):
    w = K.WordPiece(VOCAB, max_tokens=8)
    df = spark.createDataFrame(list(enumerate([*STRINGS, None])), "id int, text string")
    rows = {r["id"]: r["t"] for r in df.select("id", w.tokens(F.col("text")).alias("t")).collect()}
    assert rows[0] == ["he", "##ll", "##o", "wo", "##rl", "##d"] and rows[9] == [] and rows[13] == []
    enc = w.encode(df, "id", "text").collect()
    width = {len(r["input_ids"]) for r in enc} | {len(r["attention_mask"]) for r in enc} | {len(r["token_type_ids"]) for r in enc}
    assert width == {8}
    first = next(r for r in enc if r["id"] == 0)
    assert first["input_ids"][0] == VOCAB["[CLS]"] and first["input_ids"][-1] == VOCAB["[SEP]"] and sum(first["attention_mask"]) == 8
    back = df.select("id", K.untokenize(w.tokens(F.col("text"))).alias("t")).where("id = 0").first()["t"]
    assert back == ["hello", "world"]
    raw = df.where("id = 0").select(w.raw(F.col("text")).alias("r")).first()["r"]
    assert {x["original"] for x in raw} == {"hello", "world"}


def test_aligned_offsets_are_monotone_and_verbatim(spark):
    df = spark.createDataFrame(list(enumerate(STRINGS)), "id int, text string")
    for r in df.select("text", K.wordpiece_aligned(VOCAB)(F.col("text")).alias("t")).collect():
        starts = [t["start"] for t in r["t"]]
        assert starts == sorted(starts)
        assert all(r["text"][t["start"] : t["approx_end"]] == t["original"] and t["approx_end"] > t["start"] for t in r["t"])
    assert K.utf16("a🚀b", 2) == 3


def test_collapse_and_positions(spark):
    df = spark.createDataFrame([("hello????????world",), ("a  b\n\nc--d",), ("aa",), ("",), ("🚀🚀x",)], "text string")
    got = [(r["c"], r["k"]) for r in df.select(T.collapse_repeats(F.col("text")).alias("c"), T.kept_positions(F.col("text")).alias("k")).collect()]
    assert [c for c, _ in got] == ["hello?world", "a b\nc-d", "aa", "", "🚀x"]
    assert all(len(c) == len(k) for c, k in got)


def test_bpe_against_the_tokenizers_library(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models

    from quern.sources.vocab import read_bpe_json

    tok = tokenizers.Tokenizer(models.BPE({k: v for k, v in BPE.vocab.items()}, [("t", "h"), ("th", "e"), ("▁", "the"), ("a", "n"), ("an", "d"), ("▁", "and"), ("e", "r"), ("i", "n"), ("o", "n"), ("e", "n"), ("r", "e"), ("e", "s")], byte_fallback=True))
    tok.save(str(tmp_path / "t.json"))
    mine = read_bpe_json(str(tmp_path / "t.json"))
    for t in [*STRINGS, "the hand and the other end", "thethe then", "a" * 50]:
        assert K.bpe_ids(t, mine) [1:-1] == tok.encode(t.replace(" ", "▁")).ids, t
    df = spark.createDataFrame([(s,) for s in STRINGS if s], "text string")
    out = df.select("text", K.file_tokenizer(str(tmp_path / "t.json"))(F.regexp_replace("text", " ", "▁")).alias("e")).collect()
    assert all(list(r["e"]["ids"]) == K.bpe_ids(r["text"], mine)[1:-1] for r in out)


def test_bpe_truncation_and_added_tokens():
    b = make_bpe({"<bos>": 0, "<eos>": 1, "a": 2, "b": 3, "ab": 4}, ["a b", "x y"], {"<s>": 9, "<s>>": 10})
    assert K.bpe_ids("ab<s>>a", b) == [0, 4, 10, 2, 1]
    assert K.bpe_ids("abab", b, 3) == [0, 4, 1] and K.bpe_ids("abab", b, 3, keep_eos=False) == [0, 4, 4]
    assert [(s, e) for _, s, e in K.bpe_spans("a<s>b", b)] == [(0, 1), (1, 4), (4, 5)]


def _aligned(text, bpe):
    return [{"token": bpe.tokens[i], "original": text[s:e], "start": s, "approx_end": e} for i, s, e in K.bpe_spans(text, bpe) if e > s]


def test_bpe_aligned_sends_a_batch_back_in_bounded_pieces(spark):
    texts = ["the hand 日 and 42 " * 50] * 1500 + [None, "", "the end"]
    tracemalloc.start()
    pieces, peak = [], 0
    for p in K.bpe_aligned(BPE).func(iter([pa.array(texts)])):
        pieces.append((len(p), len(p.flatten()), p[-1].as_py()))
        peak = max(peak, tracemalloc.get_traced_memory()[1] + p.nbytes)
    tracemalloc.stop()
    one = len(_aligned(texts[0], BPE))
    assert sum(n for n, _, _ in pieces) == len(texts) and sum(t for _, t, _ in pieces) == 1500 * one + len(_aligned("the end", BPE))
    assert len(pieces) > 4 and all(t <= (K.PIECE // len(texts[0]) + 1) * one + 9 for _, t, _ in pieces) and peak < 40e6
    assert pieces[0][2] == _aligned(texts[0], BPE) and pieces[-1][2] == _aligned("the end", BPE)


@pytest.mark.parametrize(
    "bpe",
    [
        BPE,
        make_bpe({"a": 0, "b": 1, "▁": 2, "a▁": 3, "a▁b": 4, "ab": 5}, ["a ▁", "a▁ b", "a b"]),  # a merge joins a blank to what is before it
        make_bpe({"a": 0, "b": 1, "▁": 2, "▁▁": 3, "▁▁a": 4, "<0xC3>": 5}, ["▁ ▁", "▁▁ a"]),  # bytes of most characters are missing
        make_bpe({"a": 0, "b": 1, "aa": 2, "ab": 3}, ["a b", "a a"], {"<s>": 9, "b<": 10}),
        make_bpe({"a": 0}, []),
    ],
)
def test_bpe_aligned_takes_the_spans_of_the_whole_text(spark, bpe):
    texts = [*STRINGS, "aab  ab a b", "   aé▁ aab", "aaa<s>ab<s", "a" * 99 + " b" * 40, "日本<s>aa\n ab"]
    got = K.bpe_aligned(bpe).func(iter([pa.array(texts[:3]), pa.array(texts[3:])]))
    assert [r for p in got for r in p.to_pylist()] == [_aligned(t, bpe) for t in texts]


def test_bpe_round_trip_of_more_than_a_piece(spark, monkeypatch):
    from quern.plans import token_queries as Q

    texts = {i: t for i, t in enumerate([*STRINGS, None, "x🚀é\r\n the " * 30_000, *["die Hand, the end. " * 40] * 500])}
    monkeypatch.setattr(Q, "docs", lambda s, sf: s.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1))
    assert {r["doc_id"]: r["text"] for r in Q.bpe_round_trip(spark, None).collect()} == {i: t or "" for i, t in texts.items()}
    monkeypatch.setattr(Q, "docs", lambda s, sf: s.createDataFrame([], "doc_id bigint, text string"))
    assert Q.bpe_round_trip(spark, None).collect() == []
    odd = [("a", 0, 1), ("a", 0, 1), ("b", 1, 2), (None, 2, 3), ("c", 3, 4), None, ("d", 4, 5)]
    df = spark.createDataFrame([(odd,), ([],), (None,)], "t array<struct<original:string,start:int,approx_end:int>>")
    assert [r[0] for r in df.select(K.joined(F.col("t"))).collect()] == ["abcd", "", None]


def test_segments_and_cut(spark):
    df = spark.createDataFrame([(["[CLS]", "a", "[SEP]", "b", "[SEP]"],)], "t array<string>")
    assert df.select(K.segment_ids(F.col("t"))).first()[0] == [0, 0, 0, 1, 1]
    ids = spark.createDataFrame([([5, 6, 7, 8],)], "i array<bigint>")
    assert ids.select(K.keep_last(F.col("i"), 3, 1)).first()[0] == [5, 6, 1]
    assert ids.select(K.keep_last(F.col("i"), 3, 1, False)).first()[0] == [5, 6, 7]
    assert np.all(ids.select(K.keep_last(F.col("i"), 9, 1)).first()[0] == [5, 6, 7, 8])


def test_untokenize_takes_the_whole_text(spark, monkeypatch):
    from quern.plans import token_queries as Q

    lists = [["##a", "##b", "c"], [], None, ["a"], ["a", "##b", "##c", "d", "##", "e"], ["x", "##y"] * 5000]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, t array<string>")
    got = {r["id"]: r["w"] for r in df.select("id", K.untokenize(F.col("t")).alias("w")).collect()}
    assert got == {0: ["##ab", "c"], 1: [], 2: None, 3: ["a"], 4: ["abc", "d", "e"], 5: ["xy"] * 5000}
    monkeypatch.setattr(Q, "docs", lambda s, sf: s.createDataFrame([(1, "the end " * 400)], "doc_id bigint, text string"))
    assert len(Q.wordpiece_untokenize(spark, None).first()["text"].split(" ")) == 800
