"""Queries of vector functions, search, metrics, pairs, losses and statistics, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import vector as V
from quern.operators import encode as E
from quern.operators import losses as L
from quern.operators import metrics as M
from quern.operators import pairs as P
from quern.operators import search as S
from quern.operators import whiten as W
from quern.plans.text_queries import _NORM, hash_cte
from quern.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def emb(spark, sf):
    return table(spark, sf, "embeddings")


def r6(c):
    return F.round(c, 6)


def r6s(v):
    return F.transform(v, lambda x: F.round(x, 6))


def sdot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def snorm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda y: y::DOUBLE * y::DOUBLE)))"


def sround(v: str) -> str:
    return f"list_transform({v}, lambda x: round(x, 6))"


def sunit(v: str) -> str:
    return f"list_transform({v}, lambda x: x::DOUBLE / greatest({snorm(v)}, 1e-12))"


_E = "embedding"


@query(f"SELECT vec_id, {sround(sunit(_E))} AS v FROM embeddings")
def l2_normalize(spark, sf):
    return emb(spark, sf).select("vec_id", r6s(V.l2_normalise(F.col("embedding"))).alias("v"))


_PAIRS = "pairs AS (SELECT a.vec_id // 2 AS pair_id, a.embedding AS anchor, b.embedding AS positive, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END::DOUBLE AS score, (a.vec_id // 2) // 16 AS batch_id FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"


def pairs(spark, sf):
    """Consecutive rows as anchor and positive, gold score 1 for equal labels."""
    a = emb(spark, sf).where(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("ida"), F.col("embedding").alias("anchor"), F.col("label").alias("la"))
    b = emb(spark, sf).select((F.col("vec_id") - 1).alias("ida"), F.col("embedding").alias("positive"), F.col("label").alias("lb"))
    j = a.join(b, "ida").withColumn("pair_id", F.floor(F.col("ida") / 2))
    return j.select("pair_id", "anchor", "positive", (F.col("la") == F.col("lb")).cast("double").alias("score"), F.floor(F.col("pair_id") / 16).alias("batch_id"))


@query(f"WITH {_PAIRS} SELECT pair_id, round({sdot('anchor', 'positive')}, 6) AS dot, round({sdot('anchor', 'positive')} / ({snorm('anchor')} * {snorm('positive')}), 6) AS cosine, round({sdot('anchor', 'positive')} / ({snorm('anchor')} * {snorm('positive')} + 1e-12), 6) AS cosine_eps, round(1 - (1 - {sdot('anchor', 'positive')} / ({snorm('anchor')} * {snorm('positive')})), 6) AS distance_score FROM pairs")
def pair_cosine(spark, sf):
    a, b = F.col("anchor"), F.col("positive")
    return pairs(spark, sf).select("pair_id", r6(V.dot(a, b)).alias("dot"), r6(V.cosine(a, b)).alias("cosine"), r6(V.cosine(a, b, 1e-12)).alias("cosine_eps"), r6(1 - (1 - V.cosine(a, b))).alias("distance_score"))


@query(f"SELECT count(*) AS n, count(*) FILTER (abs({snorm(_E)} - 1) > 0.01) AS off FROM embeddings")
def unit_norm_check(spark, sf):
    return emb(spark, sf).agg(F.count("*").alias("n"), F.count_if(~V.is_unit(F.col("embedding"))).alias("off"))


_ROWS = "list_transform(range(0, 4), lambda i: embedding[i * 16 + 1 : i * 16 + 16])"


def _rows(spark, sf):
    return emb(spark, sf).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16))).alias("rows"))


@query("SELECT vec_id, list_transform(range(1, 17), lambda d: round((embedding[d]::DOUBLE + embedding[16 + d]::DOUBLE + embedding[48 + d]::DOUBLE) / 3.0, 6)) AS v FROM embeddings")
def mean_pool(spark, sf):
    mask = F.array(F.lit(1), F.lit(1), F.lit(0), F.lit(1))
    return _rows(spark, sf).select("vec_id", r6s(V.mean_pool(F.col("rows"), mask, 16)).alias("v"))


@query(f"SELECT vec_id, {sround(sunit('embedding[1:16]'))} AS v FROM embeddings")
def cls_pool(spark, sf):
    return _rows(spark, sf).select("vec_id", r6s(V.first_pool(F.col("rows"))).alias("v"))


@query("SELECT vec_id, list_transform(embedding[49:64], lambda x: round(x::DOUBLE, 6)) AS v FROM embeddings")
def last_pool(spark, sf):
    return _rows(spark, sf).select("vec_id", F.transform(V.last_pool(F.col("rows")), lambda x: F.round(x.cast("double"), 6)).alias("v"))


@query(f"SELECT vec_id, {sround(sunit('embedding[1:32]'))} AS v FROM embeddings")
def matryoshka(spark, sf):
    return emb(spark, sf).select("vec_id", r6s(V.prefix(F.col("embedding"), 32)).alias("v"))


_AM = "list_max(list_transform({}, lambda y: abs(y::DOUBLE)))"


@query(f"SELECT vec_id, round({_AM.format(_E)} / 127.0, 9) AS scale, list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::DOUBLE / ({_AM.format(_E)} / 127.0), 0)::INT))) AS q FROM embeddings")
def quantize_int8(spark, sf):
    q = V.quantise_int8(F.col("embedding"))
    return emb(spark, sf).select("vec_id", F.round(q["scale"], 9).alias("scale"), q["q"].alias("q"))


_G = "embedding[g * 32 + 1 : g * 32 + 32]"


@query(f"""WITH g AS (SELECT vec_id, g, {_G} AS v FROM embeddings, range(0, 2) t(g)), q AS (SELECT vec_id, g, {_AM.format('v')} / 7.0 AS scale, v FROM g),
n AS (SELECT vec_id, g, scale, list_transform(v, lambda x: greatest(-7, least(7, round_even(x::DOUBLE / scale, 0)::INT)) + 8) AS u FROM q)
SELECT vec_id, g::INT AS group_id, round(scale, 9) AS scale, list_transform(range(0, 16), lambda i: (u[i * 2 + 1] + 16 * u[i * 2 + 2])::INT) AS packed FROM n""")
def quantize_int4(spark, sf):
    g = emb(spark, sf).select("vec_id", F.posexplode(V.quantise_int4(F.col("embedding"), 64)).alias("group_id", "s"))
    return g.select("vec_id", "group_id", F.round("s.scale", 9).alias("scale"), V.pack_nibbles(F.col("s.q"), 32).alias("packed"))


_U8 = "list_transform(embedding, lambda x: greatest(0, least(255, round_even(x::DOUBLE * 127, 0)::INT + 128)))"


def _u8(c):
    return F.transform(c, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(x.cast("double") * 127).cast("int") + 128)))


@query(f"SELECT vec_id, list_transform({_U8}, lambda q: round((q - 128)::DOUBLE * 0.0027, 6)) AS v, list_transform({_U8}, lambda q: round((q - 128)::DOUBLE * 0.0027, 6)) AS reinterpreted FROM embeddings")
def dequantize_u8(spark, sf):
    q = _u8(F.col("embedding"))
    signed = F.transform(q, lambda x: F.when(x > 127, x - 256).otherwise(x))
    return emb(spark, sf).select("vec_id", r6s(V.dequantise_u8(q, 0.0027, 128)).alias("v"), r6s(V.dequantise_u8(signed, 0.0027, 128)).alias("reinterpreted"))


@query("SELECT vec_id, list_transform(list_zip(embedding, range(0, 64)), lambda z: round(z[1]::DOUBLE + z[2] / 100.0::DOUBLE, 6)) AS v FROM embeddings")
def bias_add(spark, sf):
    bias = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / F.lit(100.0))
    return emb(spark, sf).select("vec_id", r6s(V.add(F.col("embedding"), bias)).alias("v"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e, embedding AS v, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 AS m, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64 AS ms FROM embeddings)
SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS softmax, list_transform(v, lambda x: round((x::DOUBLE - m) / sqrt(list_sum(list_transform(v, lambda y: (y::DOUBLE - m) * (y::DOUBLE - m))) / 64 + 1e-12), 6)) AS layer_norm, list_transform(v, lambda x: round(x::DOUBLE / sqrt(ms + 1e-6), 6)) AS rms_norm FROM e""")
def normalisers(spark, sf):
    v = F.col("embedding")
    return emb(spark, sf).select("vec_id", r6s(V.softmax(v)).alias("softmax"), r6s(V.layer_norm(v)).alias("layer_norm"), r6s(V.rms_norm(v)).alias("rms_norm"))


@query("SELECT vec_id, list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda z: round(0.5::DOUBLE * z[1]::DOUBLE * (1 + tanh(0.7978845608028654::DOUBLE * (z[1]::DOUBLE + 0.044715::DOUBLE * z[1]::DOUBLE * z[1]::DOUBLE * z[1]::DOUBLE))) * z[2]::DOUBLE, 6) + 0.0) AS v FROM embeddings")
def geglu(spark, sf):
    return emb(spark, sf).select("vec_id", r6s(V.geglu(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))).alias("v"))


def _queries(spark, sf):
    return emb(spark, sf).where(F.col("vec_id") % 100 == 0).select("vec_id", "embedding")


def _docs(spark, sf):
    return emb(spark, sf).select("vec_id", "embedding")


_SC = f"s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({sdot('q.embedding', 'd.embedding')} / ({snorm('q.embedding')} * {snorm('d.embedding')}), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"


@query(f"WITH {_SC} SELECT query_id, doc_id, score FROM s")
def score_matrix(spark, sf):
    return S.scores(_queries(spark, sf), _docs(spark, sf))


@query(f"WITH {_SC} SELECT * FROM r")
def ranked_docs(spark, sf):
    return S.ranked(S.scores(_queries(spark, sf), _docs(spark, sf)))


@query(f"WITH {_SC} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE query_id <> doc_id QUALIFY rank <= 10")
def topk(spark, sf):
    return S.top_k(_queries(spark, sf), _docs(spark, sf), 10, exclude_self=True)


@query(f"WITH {_SC} SELECT query_id, doc_id, score FROM r WHERE rank = 1")
def best_answer(spark, sf):
    return S.best_answer(_queries(spark, sf), _docs(spark, sf))


@query(f"WITH {_SC} SELECT query_id, doc_id, score, query_id = doc_id AS diagonal FROM s")
def cross_similarity(spark, sf):
    """Rows of the self-similarity matrix, the diagonal marked: the stated query set against all rows."""
    return S.scores(_queries(spark, sf), _docs(spark, sf)).withColumn("diagonal", F.col("query_id") == F.col("doc_id"))


@query(f"WITH {_SC} SELECT query_id, doc_id, score FROM s WHERE doc_id > query_id")
def pairwise_upper(spark, sf):
    return S.scores(_queries(spark, sf), _docs(spark, sf), upper=True)


_Q8 = f"list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::DOUBLE / ({_AM.format(_E)} / 127.0), 0))) * ({_AM.format(_E)} / 127.0))"
_PJ = f"p AS (SELECT vec_id, label, embedding AS a, {_Q8} AS b FROM embeddings)"


def _restored(spark, sf):
    q = V.quantise_int8(F.col("embedding"))
    return emb(spark, sf).withColumn("z", q).select("vec_id", V.scale_by(F.col("z.q"), F.col("z.scale")).alias("embedding"))


@query(f"WITH {_PJ} SELECT vec_id, round({sdot('a', 'b')} / ({snorm('a')} * {snorm('b')}), 6) AS score FROM p")
def parity_join(spark, sf):
    return S.pair_similarity(_docs(spark, sf), _restored(spark, sf), "vec_id", "embedding").select("vec_id", r6(F.col("score")).alias("score"))


@query(f"WITH {_PJ}, s AS (SELECT label, {sdot('a', 'b')} / ({snorm('a')} * {snorm('b')}) AS score FROM p) SELECT label, count(*) AS n, round(min(score), 6) AS least, round(avg(score), 6) AS mean, round(max(score), 6) AS most, min(score) >= 0.998 AS passed FROM s GROUP BY label")
def parity_stats(spark, sf):
    s = S.pair_similarity(_docs(spark, sf), _restored(spark, sf), "vec_id", "embedding").join(emb(spark, sf).select("vec_id", "label"), "vec_id")
    return M.parity(s, "score", 0.998, ["label"])


@query(f"WITH {_PJ} SELECT round(max(list_max(list_transform(list_zip(a, b), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE)))), 9) AS max_abs FROM p")
def max_abs_diff(spark, sf):
    j = _docs(spark, sf).join(_restored(spark, sf).toDF("vec_id", "b"), "vec_id")
    return j.agg(F.round(F.max(V.max_abs_difference(F.col("embedding"), F.col("b"))), 9).alias("max_abs"))


@query(f"WITH {_PJ} SELECT round(sqrt(sum(list_sum(list_transform(list_zip(a, b), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) / sum(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS error FROM p")
def rel_l2_error(spark, sf):
    j = _docs(spark, sf).join(_restored(spark, sf).toDF("vec_id", "b"), "vec_id")
    flat = j.select(F.explode(F.arrays_zip("embedding", "b")).alias("z")).select(F.col("z.embedding").cast("double").alias("x"), F.col("z.b").alias("y"))
    return flat.agg(r6(M.relative_l2(F.col("x"), F.col("y"))).alias("error"))


@query(f"WITH {_PAIRS}, s AS (SELECT i.pair_id AS query_id, j.pair_id AS doc_id, round({sdot('i.anchor', 'j.positive')} / ({snorm('i.anchor')} * {snorm('j.positive')}), 6) AS score FROM pairs i, pairs j WHERE i.pair_id <> j.pair_id) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score <= 0.95 QUALIFY rank <= 3")
def mine_negatives(spark, sf):
    p = pairs(spark, sf)
    return S.mine_negatives(p.select("pair_id", "anchor"), p.select("pair_id", "positive"), 3)


_RK = f"{_PAIRS}, s AS (SELECT i.pair_id, j.pair_id AS o, round({sdot('i.anchor', 'j.positive')} / ({snorm('i.anchor')} * {snorm('j.positive')}), 6) AS score FROM pairs i, pairs j), own AS (SELECT pair_id, score AS mine FROM s WHERE pair_id = o), rk AS (SELECT pair_id, 1 + count(*) FILTER (o <> pair_id AND score > mine) AS rank FROM s JOIN own USING (pair_id) GROUP BY pair_id)"


@query(f"WITH {_RK} SELECT * FROM rk")
def retrieval_rank(spark, sf):
    return M.retrieval_ranks(pairs(spark, sf).select("pair_id", "anchor", "positive"))


@query(f"WITH {_RK} SELECT count(*) AS pairs, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(1.0 / rank), 6) AS mrr FROM rk")
def retrieval_accuracy_mrr(spark, sf):
    return M.retrieval_metrics(M.retrieval_ranks(pairs(spark, sf).select("pair_id", "anchor", "positive")))


def _sts(spark, sf):
    e = E.HashEncoder()
    t = table(spark, sf, "stsb_train")
    return t.select("pair_id", "source", "score", r6(V.cosine(e.encode(F.col("sentence1")), e.encode(F.col("sentence2")))).alias("cosine"))


_STS = f"{hash_cte('v1', 'pair_id', 'sentence1', 'stsb_train')}, {hash_cte('v2', 'pair_id', 'sentence2', 'stsb_train')}, sts AS (SELECT t.pair_id, t.source, t.score, CASE WHEN {snorm('v1.n')} * {snorm('v2.n')} > 0 THEN round({sdot('v1.n', 'v2.n')} / ({snorm('v1.n')} * {snorm('v2.n')}), 6) ELSE 0 END AS cosine FROM stsb_train t JOIN v1 USING (pair_id) JOIN v2 USING (pair_id)), ok AS (SELECT * FROM sts WHERE score IS NOT NULL AND NOT isnan(score))"


@query(f"WITH {_STS} SELECT round(corr(cosine, score), 6) AS pearson FROM ok")
def pearson(spark, sf):
    return M.pearson(_sts(spark, sf), "cosine", "score").select(r6(F.col("pearson")).alias("pearson"))


_RANKS = "rk AS (SELECT rank() OVER (ORDER BY cosine) + (count(*) OVER (PARTITION BY cosine) - 1) / 2.0 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS b FROM ok)"


@query(f"WITH {_STS}, {_RANKS} SELECT round(corr(a, b), 6) AS spearman FROM rk")
def spearman(spark, sf):
    return M.spearman(_sts(spark, sf), "cosine", "score").select(r6(F.col("spearman")).alias("spearman"))


@query("SELECT pair_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM stsb_train WHERE score IS NOT NULL AND NOT isnan(score)")
def average_rank(spark, sf):
    t = table(spark, sf, "stsb_train").where("score is not null and not isnan(score)").select("pair_id", "score")
    return M.average_ranks(t, "score", "r").select("pair_id", "r")


@query(f"WITH {_STS}, {_RANKS} SELECT 'hash-64' AS encoder, round(corr(a, b), 6) AS spearman FROM rk UNION ALL SELECT 'pearson-64', round(corr(cosine, score), 6) FROM ok")
def eval_report(spark, sf):
    s = _sts(spark, sf)
    a = M.spearman(s, "cosine", "score").select(F.lit("hash-64").alias("encoder"), r6(F.col("spearman")).alias("spearman"))
    return a.unionByName(M.pearson(s, "cosine", "score", "spearman").select(F.lit("pearson-64").alias("encoder"), r6(F.col("spearman")).alias("spearman")))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, list_sort(list(value))[count(value) // 2 + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def timing_stats(spark, sf):
    t = table(spark, sf, "events").where("value is not null")
    return t.groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"), M.upper_median("value").alias("median"))


@query("SELECT l_returnflag, round(count(*) / sum(l_quantity)::DOUBLE, 6) AS texts_per_s, round(sum(l_extendedprice)::DOUBLE / sum(l_quantity)::DOUBLE, 6) AS tokens_per_s FROM lineitem GROUP BY l_returnflag")
def throughput(spark, sf):
    t = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("s"), F.lit(1).alias("texts"), F.col("l_extendedprice").cast("double").alias("tokens"))
    return M.throughput(t, "l_returnflag", "s", "texts", "tokens")


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stage_profile(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT i AS dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY i")
def column_mean(spark, sf):
    _, mean, _ = W.mean_and_covariance(emb(spark, sf), "embedding", 64)
    return spark.createDataFrame([(i, float(np.round(x, 6))) for i, x in enumerate(mean)], "dim bigint, mean double")


_CV = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM e)"


@query(f"WITH {_CV} SELECT a.i, b.i AS j, round(sum(a.x * b.x) / count(*), 6) + 0.0 AS cov FROM c a JOIN c b USING (vec_id) WHERE a.i <= b.i GROUP BY a.i, b.i")
def covariance(spark, sf):
    _, _, cov = W.mean_and_covariance(emb(spark, sf), "embedding", 64)
    return spark.createDataFrame([(i, j, float(np.round(cov[i, j], 6) + 0.0)) for i in range(64) for j in range(i, 64)], "i bigint, j bigint, cov double")


@query()
def whitening(spark, sf):
    fitted = W.fit(emb(spark, sf), "embedding", 64)
    return W.apply(emb(spark, sf), "vec_id", "embedding", *fitted)


@query("SELECT pair_id, score FROM stsb_train WHERE score IS NULL OR (score >= 3 AND NOT isnan(score))")
def score_filter(spark, sf):
    return P.at_least(table(spark, sf, "stsb_train").select("pair_id", "score"), 3)


def _named(t):
    return t.select("pair_id", F.col("sentence1").alias("anchor"), F.col("sentence2").alias("positive"), "score")


@query("SELECT pair_id, 'q: ' || coalesce(sentence1, '') AS anchor, 'd: ' || coalesce(sentence2, '') AS positive, coalesce(score, 1) AS score FROM stsb_train WHERE score IS NULL OR (score >= 3 AND NOT isnan(score))")
def positive_threshold(spark, sf):
    return P.training_examples(_named(table(spark, sf, "stsb_train")), 3, True, "q: ", "d: ")


@query("SELECT count(*) > 0 AND count(*) = count(score) AS all_scored FROM stsb_train")
def all_scored(spark, sf):
    return P.all_scored(table(spark, sf, "stsb_train"))


_SH = "sh AS (SELECT pair_id, row_number() OVER (ORDER BY md5('42:' || pair_id::VARCHAR), pair_id) - 1 AS position, (SELECT round_even(count(*) * 0.1, 0) FROM stsb_train) AS nv FROM stsb_train)"


@query(f"WITH {_SH} SELECT pair_id, position, position < nv AS validation FROM sh")
def split(spark, sf):
    return P.split(table(spark, sf, "stsb_train").select("pair_id"), "pair_id", 0.1)


@query(f"WITH {_SH} SELECT pair_id, position // 16 AS batch_id FROM sh")
def batches(spark, sf):
    s = P.split(table(spark, sf, "stsb_train").select("pair_id"), "pair_id", 0.1)
    return P.batches(s, 16).select("pair_id", "batch_id")


@query("SELECT DISTINCT sentence1 AS text FROM stsb_train WHERE sentence1 IS NOT NULL UNION SELECT sentence2 FROM stsb_train WHERE sentence2 IS NOT NULL")
def unique_texts(spark, sf):
    return P.unique_texts(table(spark, sf, "stsb_train"), "sentence1", "sentence2")


@query("SELECT sentence2, min(pair_id) AS first_key FROM stsb_train WHERE sentence2 IS NOT NULL GROUP BY sentence2")
def first_seen(spark, sf):
    return P.first_seen(table(spark, sf, "stsb_train"), "sentence2", "pair_id")


@query("SELECT sentence1, dense_rank() OVER (ORDER BY sentence1) - 1 AS text_index FROM (SELECT DISTINCT sentence1 FROM stsb_train WHERE sentence1 IS NOT NULL)")
def intern(spark, sf):
    return P.intern(table(spark, sf, "stsb_train"), "sentence1")


_BT = f"{_SH}, bt AS (SELECT t.pair_id, t.sentence1 AS anchor, t.sentence2 AS positive, sh.position // 16 AS batch_id FROM stsb_train t JOIN sh USING (pair_id))"


@query(f"WITH {_BT} SELECT a.batch_id, a.pair_id AS i, b.pair_id AS j FROM bt a JOIN bt b USING (batch_id) WHERE a.pair_id <> b.pair_id AND (a.positive = b.positive OR a.anchor = b.anchor OR b.positive = a.anchor OR b.anchor = a.positive)")
def fn_mask(spark, sf):
    t = table(spark, sf, "stsb_train")
    b = P.batches(P.split(t.select("pair_id"), "pair_id", 0.1), 16).select("pair_id", "batch_id")
    return P.conflicts(_named(t).join(b, "pair_id"))


_LG = f"{_PAIRS}, lg AS (SELECT i.batch_id, i.pair_id AS i, j.pair_id AS j, {sdot('i.anchor', 'j.positive')} / ({snorm('i.anchor')} * {snorm('j.positive')}) / 0.05 AS l FROM pairs i JOIN pairs j USING (batch_id)), rows AS (SELECT batch_id, ln(sum(exp(l))) - max(CASE WHEN i = j THEN l END) AS x FROM lg GROUP BY batch_id, i UNION ALL SELECT batch_id, ln(sum(exp(l))) - max(CASE WHEN i = j THEN l END) FROM lg GROUP BY batch_id, j)"


@query(f"WITH {_LG} SELECT batch_id, round(sum(x) / count(*), 6) AS loss FROM rows GROUP BY batch_id")
def infonce_loss(spark, sf):
    return L.infonce(pairs(spark, sf)).select("batch_id", r6(F.col("loss")).alias("loss"))


def _cos_pairs(spark, sf):
    return pairs(spark, sf).select("batch_id", "pair_id", "score", V.cosine(F.col("anchor"), F.col("positive")).alias("cosine"))


_CP = f"{_PAIRS}, cp AS (SELECT batch_id, pair_id, score, {sdot('anchor', 'positive')} / ({snorm('anchor')} * {snorm('positive')}) AS c FROM pairs)"


@query(f"WITH {_CP} SELECT k.batch_id, round(ln(1 + coalesce(sum(CASE WHEN k.score > l.score THEN exp((l.c - k.c) / 0.05) END), 0)), 6) AS loss FROM cp k JOIN cp l USING (batch_id) GROUP BY k.batch_id")
def cosent_loss(spark, sf):
    return L.cosent(_cos_pairs(spark, sf)).select("batch_id", r6(F.col("loss")).alias("loss"))


@query(f"WITH {_CP} SELECT batch_id, round(avg((c - score) * (c - score)), 6) AS loss FROM cp GROUP BY batch_id")
def regression_loss(spark, sf):
    return L.regression(_cos_pairs(spark, sf)).select("batch_id", r6(F.col("loss")).alias("loss"))


def _prefixed(d: int) -> str:
    return f"SELECT i.batch_id, i.pair_id AS i, j.pair_id AS j, {d} AS d, {sdot(f'i.anchor[1:{d}]', f'j.positive[1:{d}]')} / ({snorm(f'i.anchor[1:{d}]')} * {snorm(f'j.positive[1:{d}]')}) / 0.05 AS l FROM pairs i JOIN pairs j USING (batch_id)"


@query(f"WITH {_PAIRS}, lg AS ({_prefixed(16)} UNION ALL {_prefixed(32)} UNION ALL {_prefixed(64)}), rows AS (SELECT batch_id, d, ln(sum(exp(l))) - max(CASE WHEN i = j THEN l END) AS x FROM lg GROUP BY batch_id, d, i UNION ALL SELECT batch_id, d, ln(sum(exp(l))) - max(CASE WHEN i = j THEN l END) FROM lg GROUP BY batch_id, d, j), per AS (SELECT batch_id, d, sum(x) / count(*) AS loss FROM rows GROUP BY batch_id, d) SELECT batch_id, round(avg(loss), 6) AS loss FROM per GROUP BY batch_id")
def matryoshka_loss(spark, sf):
    return L.matryoshka(pairs(spark, sf), [16, 32, 64]).select("batch_id", r6(F.col("loss")).alias("loss"))


@query("SELECT s AS step, round(CASE WHEN s < 100 THEN 5e-4 * (s + 1) / 100.0 ELSE 5e-4 * 0.5 * (1 + cos(pi() * (s - 100) / 900.0)) END, 12) AS lr FROM range(0, 1000) t(s)")
def lr_schedule(spark, sf):
    return spark.range(1000).select(F.col("id").alias("step"), F.round(L.learning_rate(F.col("id"), 1000), 12).alias("lr"))


_EP = "ep AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS metric FROM events WHERE value IS NOT NULL)"


def _epochs(spark, sf):
    t = table(spark, sf, "events").where("value is not null")
    return t.select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("epoch"), F.col("value").alias("metric"))


@query(f"WITH {_EP}, b AS (SELECT *, max(metric) OVER w AS best, max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ep WINDOW w AS (PARTITION BY run ORDER BY epoch)), m AS (SELECT *, CASE WHEN prev IS NULL OR metric > prev THEN epoch END AS hit FROM b), s AS (SELECT run, epoch, metric, best, epoch - max(hit) OVER (PARTITION BY run ORDER BY epoch) AS since FROM m) SELECT *, since >= 3 AS stop FROM s")
def early_stop(spark, sf):
    return P.early_stop(_epochs(spark, sf), "run", "epoch", "metric", 3)


@query(f"WITH {_EP} SELECT * FROM ep QUALIFY row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) = 1")
def best_checkpoint(spark, sf):
    return P.best_checkpoint(_epochs(spark, sf), "run", "epoch", "metric")
