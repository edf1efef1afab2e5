import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vector as V
from quern.operators import chunk as C
from quern.operators import encode as E
from quern.operators import metrics as M
from quern.operators import pairs as P
from quern.operators import search as S
from quern.operators import whiten as W


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def arr(x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vector_literals(spark):
    assert one(spark, V.l2_normalise(arr([3, 4, 0, 12]))) == pytest.approx([3 / 13, 4 / 13, 0, 12 / 13])
    x = np.array([1, 2, 3, 0.5, -1])
    assert one(spark, V.softmax(arr(x))) == pytest.approx(np.exp(x) / np.exp(x).sum())
    assert one(spark, V.cosine(arr([0, 0]), arr([1, 0]))) == 0
    assert one(spark, V.layer_norm(arr(x))) == pytest.approx((x - x.mean()) / x.std(), abs=1e-6)
    assert one(spark, V.prefix_dims(F.array(F.lit(4), F.lit(99), F.lit(0), F.lit(4)), 8)) == [4, 8]
    assert one(spark, V.quantise_int8(arr([0, 0])))["scale"] == 1.0
    w = F.array(arr([1, 0]), arr([0, 2]))
    assert one(spark, V.whiten(arr([2, 2]), arr([1, 1]), w)) == pytest.approx([1 / math.sqrt(5), 2 / math.sqrt(5)])
    assert one(spark, V.let(F.lit(2), lambda x: x * x)) == 4


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 69), st.integers(1, 13), st.integers(0, 13))
def test_windows_cover_everything(n, length, overlap):
    length, overlap = C.clamp_arguments(length, overlap, 100)
    step = max(1, length - overlap)
    starts = [k * step for k in range(math.ceil(max(n - length, 0) / step) + 1)] if n else []
    assert sorted({i for s in starts for i in range(s, min(n, s + length))}) == (list(range(n)) if overlap < length or step == 1 else list(range(n)))


def test_windows_in_spark_match_the_closed_form(spark):
    df = spark.range(40).select("id", F.transform(F.sequence(F.lit(0), F.col("id").cast("int")), lambda x: x.cast("string")).alias("t"))
    got = C.chunk_tokens(df, "id", F.slice("t", 1, F.col("id").cast("int")), 7, 2).collect()
    for n in range(40):
        mine = sorted((r["chunk_id"], r["chunk"]) for r in got if r["id"] == n)
        want = [(k, " ".join(map(str, range(k * 5, min(n, k * 5 + 7))))) for k in range(math.ceil(max(n - 7, 0) / 5) + 1)] if n else []
        assert mine == want
    assert C.chunk_tokens(df, "id", F.col("t"), 7, 2, max_chunks=2).agg(F.max("chunk_id")).first()[0] == 1
    assert C.chunk_tokens(df, "id", F.col("t"), 7, 2, max_chunks=2, legacy_cap=True).agg(F.max("chunk_id")).first()[0] == 2


def test_aligned_chunks_are_slices(spark):
    texts = [" ".join(f"w{i}" for i in range(200)), "  lead. Tail\n\n", "日本語 テキスト。次", "", None, "one", "a🚀b 🚀"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in C.chunk_aligned(df, "id", "text", 9, 3).collect():
        t = texts[r["id"]]
        assert r["value"] == t[r["start"] : r["approx_end"]] and r["start"] <= r["last_start"] < r["approx_end"]
    assert C.clamp_arguments(0, -1, 50) == (50, 10) and C.clamp_arguments(10, 10, 50) == (10, 10) and C.clamp_arguments(10, 10, 50, True) == (10, 2)


def test_word_packing(spark):
    text = " ".join(f"w{i}" for i in range(50))
    parts = C.pack_words(text, 30, 8)
    assert all(len(p) <= 30 for p in parts) and parts[0].split()[0] == "w0" and parts[-1].split()[-1] == "w49"
    assert len(C.pack_words(" ".join(f"w{i}" for i in range(200)), 30, 5, 3)) <= 4
    assert C.pack_words("", 30, 5) == [] and C.pack_words("hello world", 30, 5) == ["hello world"] and C.pack_words("x" * 40, 30, 5) == ["x" * 40]
    assert C.pack_words(None, 30, 5) == []


def test_page_tags_and_spans(spark):
    df = spark.createDataFrame([("⁎1⁑a⁎2⁑b",), ("x",), ("⁎3⁑",), ("⁎⁑y",)], "t string")
    assert [r[0] for r in df.select(T.page_tag(F.col("t"))).collect()] == ["1-2", "", "3", ""]
    span = lambda t, s, e: one(spark, C.from_original(F.lit(t), F.lit(s), F.lit(e)))
    assert span("alpha beta gamma", 0, 8) == "alpha beta" and span("alpha beta", 0, 99) == "alpha beta"
    assert span("alpha beta", 0, 5) == "alpha" and span("a" * 40 + " b", 0, 5) == "aaaaa"


def test_encoders_agree_and_dedupe(spark):
    df = spark.createDataFrame([(0, "The cat the CAT"), (1, "a dog"), (2, None), (3, "the cat the cat"), (4, "a dog")], "id int, text string")
    e = E.HashEncoder(16)
    rows = df.select("id", e.encode(F.col("text")).alias("a"), e.encode_expr(F.col("text")).alias("b")).collect()
    assert all(np.allclose(r["a"], r["b"]) for r in rows) and not any(rows[2]["a"])
    got = {r["id"]: r["vector"] for r in E.encode_distinct(df, "text", e).collect()}
    assert len(got) == 5 and got[1] == got[4]
    seen = []
    m = E.ModelEncoder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), 2, 2)
    assert df.select(m.encode(F.col("text")).alias("v")).count() == 5 and not seen
    E.register("two", lambda: m)
    assert E.encoder("two") is m
    with pytest.raises(KeyError):
        E.encoder("none")
    store = df.where("id < 2").select(F.md5("text").alias("text_key"), e.encode(F.col("text")).alias("vector"))
    assert E.encode_distinct(df, "text", e, store=store).count() == 5


def vectors(spark, n=60, d=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")


@pytest.mark.parametrize("block", [7, 2048])
def test_search_against_brute_force(spark, block):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in S.top_k(df, df, 4, exclude_self=True, block=block).collect()}
    for i in range(60):
        order = [j for j in sorted(range(60), key=lambda j: (-s[i, j], j)) if j != i][:4]
        assert [got[(i, k + 1)] for k in range(4)] == order
    empty = df.where("id < 0")
    assert S.scores(empty, df).count() == 0 and S.scores(df, empty).count() == 0
    nulls = df.union(spark.createDataFrame([(None, [1.0] * 8), (99, None)], df.schema))
    assert S.top_k(nulls, nulls, 1).count() == 60


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (2.0, 5.0), (4.0, 7.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    x, y = np.array([1, 2.5, 2.5, 4]), np.array([1.5, 1.5, 3, 4])
    assert M.spearman(df, "a", "b").first()[0] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert math.isnan(M.spearman(df.limit(1), "a", "b").first()[0]) and math.isnan(M.pearson(df.limit(0), "a", "b").first()[0])
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert M.pearson(flat, "a", "b").first()[0] == 0 and M.spearman(flat, "a", "b").first()[0] == 0
    x, v = vectors(spark, 30)
    p = v.select("id", "v", F.reverse("v").alias("p"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u[:, ::-1].T, 6)
    want = 1 + (s > np.diag(s)[:, None]).sum(1)
    assert [r["rank"] for r in M.retrieval_ranks(p, 8).orderBy("pair_id").collect()] == want.tolist()
    assert math.isnan(M.retrieval_metrics(M.retrieval_ranks(p.limit(1))).first()["mrr"])


def test_whitening(spark):
    x, df = vectors(spark, 200, 5, 3)
    mean, w = W.fit(df, "v", 5, 0.0)
    assert np.allclose(w @ np.cov(x.T, bias=True) @ w, np.eye(5), atol=1e-8)
    assert W.fit(df.limit(1), "v", 5) is None
    out = np.array([r["v"] for r in W.apply(df, "id", "v", mean, w).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(out, axis=1), 1)


def test_pairs(spark):
    df = spark.range(103).withColumnRenamed("id", "pair_id")
    s = P.split(df, "pair_id", 0.1, 7)
    assert s.where("validation").count() == 10 and sorted(r[0] for r in s.select("position").collect()) == list(range(103))
    assert P.validation_count(5, 0.5) == 2 and P.validation_count(1, 0.9) == 0
    with pytest.raises(ValueError):
        P.validation_count(5, 1.0)
    t = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "t string")
    assert sorted(map(tuple, P.intern(t, "t").collect())) == [("a", 0), ("b", 1)]
    e = spark.createDataFrame([(1, i, m) for i, m in enumerate([0.1, 0.3, 0.3, 0.2, 0.4])], "run int, epoch int, metric double")
    assert [r["since"] for r in P.early_stop(e, "run", "epoch", "metric", 2).orderBy("epoch").collect()] == [0, 0, 1, 2, 0]
    assert P.best_checkpoint(e, "run", "epoch", "metric").first()["epoch"] == 4
