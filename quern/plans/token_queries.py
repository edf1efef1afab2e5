"""Queries of the sub-word tokenizers and of generated corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import tokenize as K
from quern.plans.text_queries import docs
from quern.session import table
from quern.sources import datasets as D
from quern.sources.vocab import index, make_bpe, rule_vocabulary

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COMMON = ("the", "and", "of", "in", "with", "near", "every", "after", "before", "from", "la", "el", "der", "die", "das", "le")
VOCAB = index(rule_vocabulary(COMMON))
BYTES = {f"<0x{i:02X}>": i + 3 for i in range(256)}
LETTERS = "▁abcdefghijklmnopqrstuvwxyz.,"
PAIRS = ["th", "the", "▁the", "an", "and", "▁and", "er", "in", "▁of", "on", "en", "re", "es", "▁t", "▁a", "▁s"]
BPE = make_bpe({"<pad>": 0, "<eos>": 1, "<bos>": 2, **BYTES, **{c: 259 + i for i, c in enumerate(LETTERS)}, **{t: 300 + i for i, t in enumerate(PAIRS)}}, ["t h", "th e", "▁ the", "a n", "an d", "▁ and", "e r", "i n", "o n", "e n", "r e", "e s"], {"<pad>": 0, "<eos>": 1, "<bos>": 2})


def piece():
    return K.WordPiece(VOCAB)


@query()
def wordpiece_tokens(spark, sf):
    t = docs(spark, sf).select("doc_id", piece().tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("h"))


@query()
def wordpiece_encode(spark, sf):
    return piece().encode(docs(spark, sf), "doc_id", "text")


@query()
def wordpiece_untokenize(spark, sf):
    t = docs(spark, sf).select("doc_id", piece().tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join(K.untokenize(F.col("t")), " ").alias("text"))


@query()
def wordpiece_aligned(spark, sf):
    t = docs(spark, sf).select("doc_id", F.explode(K.wordpiece_aligned(VOCAB)(F.col("text"))).alias("t"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("t.approx_end").alias("last"))


@query()
def bpe_encode(spark, sf):
    return docs(spark, sf).select("doc_id", K.bpe_encode(BPE)(F.col("text")).alias("ids")).select("doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("h"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def bpe_round_trip(spark, sf):
    """The originals of the aligned tokens are the text again."""
    return docs(spark, sf).select("doc_id", K.joined(K.bpe_aligned(BPE)(F.col("text"))).alias("text"))


_T = r"t AS (SELECT pair_id, list_concat(['[CLS]'], list_concat(regexp_extract_all(lower(coalesce(sentence1, '')), '[a-z0-9]+'), list_concat(['[SEP]'], list_concat(regexp_extract_all(lower(coalesce(sentence2, '')), '[a-z0-9]+'), ['[SEP]'])))) AS tok FROM stsb_dev)"


def _framed(spark, sf):
    w = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf, "stsb_dev").select("pair_id", F.concat(F.array(F.lit(K.CLS)), w(F.col("sentence1")), F.array(F.lit(K.SEP)), w(F.col("sentence2")), F.array(F.lit(K.SEP))).alias("tok"))


@query(f"WITH {_T} SELECT pair_id, list_transform(range(1, len(tok) + 1), lambda i: len(list_filter(tok[1 : i - 1], lambda x: x = '[SEP]'))::BIGINT) AS segments FROM t")
def segment_ids(spark, sf):
    return _framed(spark, sf).select("pair_id", K.segment_ids(F.col("tok")).alias("segments"))


@query(f"WITH {_T}, w AS (SELECT max(len(tok)) AS width FROM t) SELECT pair_id, list_concat(list_transform(tok, lambda x: length(x)::BIGINT), list_transform(range(0, width - len(tok)), lambda i: 0::BIGINT)) AS ids FROM t, w")
def pad_batch(spark, sf):
    t = _framed(spark, sf)
    width = t.agg(F.max(F.size("tok")).alias("width"))
    return t.join(F.broadcast(width)).select("pair_id", F.concat(F.transform("tok", lambda x: F.length(x).cast("bigint")), F.array_repeat(F.lit(0).cast("bigint"), F.col("width") - F.size("tok"))).alias("ids"))


@query(f"WITH {_T} SELECT pair_id, CASE WHEN len(tok) > 40 THEN list_concat(list_transform(tok[1:39], lambda x: length(x)::BIGINT), [1::BIGINT]) ELSE list_transform(tok, lambda x: length(x)::BIGINT) END AS ids FROM t")
def eos_truncate(spark, sf):
    return _framed(spark, sf).select("pair_id", K.keep_last(F.transform("tok", lambda x: F.length(x).cast("bigint")), 40, 1).alias("ids"))


_POOL = ["amber", "valve", "river", "token", "cloud", "stone", "paper"]


@query("""WITH w AS (SELECT id, i, ['amber', 'valve', 'river', 'token', 'cloud', 'stone', 'paper'][('0x' || substr(md5('4:' || id || ':' || i), 1, 8))::BIGINT % 7 + 1] AS x FROM range(0, 200) a(id), range(0, 90) b(i)),
s AS (SELECT id, i // 6 AS s, string_agg(x, ' ' ORDER BY i) || '.' AS x FROM w GROUP BY id, i // 6), p AS (SELECT id, s // 5 AS p, string_agg(x, ' ' ORDER BY s) AS x FROM s GROUP BY id, s // 5)
SELECT id, string_agg(x, chr(10) || chr(10) ORDER BY p) AS text FROM p GROUP BY id""")
def synthetic_corpus(spark, sf):
    return D.synthetic_corpus(spark, 200, 3, 5, 6, _POOL)
