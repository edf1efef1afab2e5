"""Queries of normalisation, tokens, chunks and encoding over documents and the pair tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunk as C
from quern.operators import encode as E
from quern.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


_S = r"\s\p{Sc}\p{So}(){}\[\]\-–—~''\"”“`‘´’‚„»«「」『』（）〔〕【】《》〈〉…:;!?.,¿¡<>_#*&"
_SP = r""".,;:\\/?!#$%()=+\-*"''–_`<>&\^@{}\[\]|~"""
_COLLAPSE = f"list_filter(string_split(coalesce(text, ''), ''), lambda v, i: i = 1 OR NOT (v = string_split(text, '')[i - 1] AND regexp_matches(v, '^[{_S}]$')))"
_ACC, _PLN = T._ACCENTED, T._PLAIN


def _translit(x: str) -> str:
    out = f"translate({x}, '{_ACC}', '{_PLN}')"
    for a, b in T.LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


_CLEAN = f"clean AS (SELECT doc_id, coalesce(text, '') AS text, {_translit(f'''array_to_string({_COLLAPSE}, '')''')} AS t FROM documents)"
_WORDS = r"words AS (SELECT doc_id, list_filter(string_split_regex(t, ' |\r\n'), lambda x: x <> '') AS w FROM clean)"
_TOKENS = f"tokens AS (SELECT doc_id, list_transform(flatten(list_transform(w, lambda x: regexp_extract_all(x, '[^{_SP}]+|[{_SP}]'))), lambda x: lower(x)) AS tok FROM words)"
_BASIC = f"WITH {_CLEAN}, {_WORDS}, {_TOKENS}"


@query(f"SELECT doc_id, array_to_string({_COLLAPSE}, '') AS collapsed FROM documents WHERE text IS NOT NULL")
def collapse_repeats(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", T.collapse_repeats(F.col("text")).alias("collapsed"))


@query(f"""SELECT doc_id, list_sum(list_transform(list_filter(range(1, length(text) + 1), lambda i: i = 1 OR NOT (text[i] = text[i - 1] AND regexp_matches(text[i], '^[{_S}]$'))), lambda i: i - 1))::BIGINT AS position_sum
FROM documents WHERE text <> ''""")
def collapse_alignment(spark, sf):
    kept = T.kept_positions(F.col("text"))
    return docs(spark, sf).where("text <> ''").select("doc_id", F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("position_sum"))


@query(f"SELECT doc_id, {_translit('text')} AS plain FROM documents WHERE text IS NOT NULL")
def transliterate_latin(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", T.transliterate(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, ' |\r\n'), lambda x: x <> ''))::BIGINT AS words FROM documents WHERE text IS NOT NULL")
def split_reference_ws(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", F.size(T.split_words(F.col("text"))).cast("bigint").alias("words"))


@query(_BASIC + " SELECT doc_id, len(tok)::BIGINT AS n_tokens, md5(array_to_string(tok, chr(31))) AS token_hash FROM tokens")
def basic_tokens(spark, sf):
    t = docs(spark, sf).select("doc_id", T.basic_tokens(F.col("text")).alias("tok"))
    return t.select("doc_id", F.size("tok").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tok", "\x1f")).alias("token_hash"))


@query(_BASIC + " SELECT w AS token, count(*) AS n FROM (SELECT unnest(tok) AS w FROM tokens) GROUP BY w")
def lowercase_tokens(spark, sf):
    return docs(spark, sf).select(F.explode(T.basic_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {_CLEAN}, {_WORDS} SELECT doc_id, len(flatten(list_transform(w, lambda x: regexp_extract_all(x, '[^{_SP}]+|[{_SP}]'))))::BIGINT AS n_tokens FROM words")
def cased_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.basic_tokens(F.col("text"), lower=False)).cast("bigint").alias("n_tokens"))


@query("SELECT doc_id, md5(replace(text, ' ', '▁')) AS h FROM documents WHERE text IS NOT NULL")
def metaspace(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", F.md5(T.metaspace(F.col("text"))).alias("h"))


_PG = r"list_transform(list_filter(regexp_extract_all(text, '⁎(\d*)⁑', 1), lambda x: x <> ''), lambda x: x::INT)"
_TAG = f"CASE WHEN len({_PG}) = 0 THEN '' WHEN list_min({_PG}) = list_max({_PG}) THEN list_min({_PG})::VARCHAR ELSE list_min({_PG}) || '-' || list_max({_PG}) END"


@query(rf"SELECT doc_id, md5(regexp_replace(text, '⁎\d*⁑', '', 'g')) AS stripped, {_TAG} AS tag FROM documents WHERE text IS NOT NULL")
def strip_page_tags(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", F.md5(T.strip_pages(F.col("text"))).alias("stripped"), T.page_tag(F.col("text")).alias("tag"))


@query("SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source")
def utf8_bytes(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(T.utf8_bytes(F.col("text"))).cast("bigint").alias("bytes"))


@query(f"WITH {_CLEAN}, {_WORDS} SELECT doc_id, len(list_filter(w, lambda x: length(x) <= 50))::BIGINT AS kept FROM words")
def drop_long_words(spark, sf):
    words = T.split_words(T.transliterate(T.collapse_repeats(T.or_empty(F.col("text")))))
    return docs(spark, sf).select("doc_id", F.size(T.drop_long_words(words)).cast("bigint").alias("kept"))


@query("SELECT doc_id, CASE WHEN length(text) > 30 THEN left(text, 27) || '...' ELSE text END AS label FROM documents")
def display_label(spark, sf):
    return docs(spark, sf).select("doc_id", T.label(F.col("text")).alias("label"))


@query("SELECT pair_id, md5('Instruct: Given a web search query, retrieve relevant passages that answer the query' || chr(10) || 'Query: ' || coalesce(sentence1, '')) AS h FROM stsb_test")
def encode_queries_prefix(spark, sf):
    return table(spark, sf, "stsb_test").select("pair_id", F.md5(T.with_prompt(F.col("sentence1"), T.PROMPTS["web_search"])).alias("h"))


@query(r"SELECT doc_id, regexp_matches(coalesce(text, ''), '^[ \t\n\r]*$') AS blank, least(greatest(coalesce(n_chars, -1), 0), length(coalesce(text, ''))) AS clamped FROM documents")
def blank_and_clamp(spark, sf):
    t = table(spark, sf, "documents")
    return t.select("doc_id", T.is_blank(T.or_empty(F.col("text"))).alias("blank"), T.clamp_offset(F.coalesce("n_chars", F.lit(-1)), F.length(T.or_empty(F.col("text")))).cast("bigint").alias("clamped"))


_COVER = r"cover AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ \t\n\r]*(?:[\p{L}\p{N}]+|[^ \t\n\r\p{L}\p{N}])|[ \t\n\r]+') AS tok FROM documents)"


def _windows(length: int, overlap: int, src: str = "cover") -> str:
    step = max(1, length - overlap)
    return f"win AS (SELECT doc_id, text, tok, unnest(range(0, ceil(greatest(len(tok) - {length}, 0) / {step}.0)::BIGINT + 1)) AS chunk_id FROM {src} WHERE len(tok) > 0), chunks AS (SELECT doc_id, text, chunk_id::INT AS chunk_id, chunk_id * {step} AS off, tok, tok[chunk_id * {step} + 1 : chunk_id * {step} + {length}] AS part FROM win)"


_NB = r"NOT regexp_matches({}, '^[ \t\n\r]*$')"


@query(f"WITH {_COVER} SELECT doc_id, len(tok)::BIGINT AS n FROM cover")
def token_count(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.covering_tokens(T.or_empty(F.col("text")))).cast("bigint").alias("n"))


_CT = _BASIC + ", cover AS (SELECT doc_id, '' AS text, tok FROM tokens), " + _windows(64, 16) + f" SELECT doc_id, chunk_id, len(part)::BIGINT AS n_tokens, md5(array_to_string(part, ' ')) AS h FROM chunks WHERE {_NB.format('array_to_string(part, chr(32))')}"


@query(_CT)
def chunk_tokens(spark, sf):
    c = C.chunk_tokens(docs(spark, sf), "doc_id", T.basic_tokens(F.col("text")), 64, 16)
    return c.select("doc_id", "chunk_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.md5("chunk").alias("h"))


@query(_CT + " AND chunk_id < 3")
def chunk_cap(spark, sf):
    c = C.chunk_tokens(docs(spark, sf), "doc_id", T.basic_tokens(F.col("text")), 64, 16, max_chunks=3)
    return c.select("doc_id", "chunk_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.md5("chunk").alias("h"))


_AL = f"WITH {_COVER}, {_windows(64, 16)} SELECT doc_id, chunk_id, md5(array_to_string(part, '')) AS h, length(array_to_string(tok[1 : off], ''))::INT AS start, (length(array_to_string(tok[1 : off], '')) + length(array_to_string(part, '')) - length(part[-1]))::INT AS last_start, (length(array_to_string(tok[1 : off], '')) + length(array_to_string(part, '')))::INT AS approx_end FROM chunks WHERE {_NB.format('array_to_string(part, chr(32))')}"


@query(_AL)
def chunk_aligned(spark, sf):
    c = C.chunk_aligned(docs(spark, sf), "doc_id", "text", 64, 16)
    return c.select("doc_id", "chunk_id", F.md5("value").alias("h"), "start", "last_start", "approx_end")


@query(f"WITH {_COVER}, {_windows(64, 16)} SELECT doc_id, chunk_id, md5(regexp_replace(text, '⁎\\d*⁑', '', 'g')) AS h, {_TAG} AS tag FROM (SELECT doc_id, chunk_id, array_to_string(part, '') AS text FROM chunks) WHERE {_NB.format('text')}")
def chunk_tagged(spark, sf):
    c = C.with_tags(C.chunk_aligned(docs(spark, sf), "doc_id", "text", 64, 16), "value")
    return c.select("doc_id", "chunk_id", F.md5("value").alias("h"), "tag")


@query("SELECT doc_id, length(left(coalesce(text, ''), 64 * 3 * 6))::BIGINT AS n FROM documents")
def chunk_budget(spark, sf):
    return docs(spark, sf).select("doc_id", F.length(C.char_budget(T.or_empty(F.col("text")), 64, 3, 6)).cast("bigint").alias("n"))


@query(r"""WITH a AS (SELECT aligned_key, original_text AS t, start_pos AS s, approx_end AS e FROM encoded_chunk_aligned WHERE original_text IS NOT NULL AND start_pos IS NOT NULL AND approx_end IS NOT NULL),
b AS (SELECT aligned_key, t, s, CASE WHEN e >= length(t) THEN length(t) WHEN NOT regexp_matches(substring(t, e + 1, 1), '^\s') AND regexp_matches(substring(t, e + 1, 10), '[ \n]')
  THEN e + length(regexp_extract(substring(t, e + 1, 10), '^[^ \n]*')) ELSE e END AS stop FROM a)
SELECT aligned_key, md5(CASE WHEN stop > s THEN substring(t, s + 1, stop - s) ELSE '' END) AS h FROM b""")
def from_original(spark, sf):
    t = table(spark, sf, "encoded_chunk_aligned").where("original_text is not null and start_pos is not null and approx_end is not null")
    return t.select("aligned_key", F.md5(C.from_original(F.col("original_text"), F.col("start_pos"), F.col("approx_end"))).alias("h"))


@query()
def chunk_string(spark, sf):
    return C.chunk_strings(docs(spark, sf), "doc_id", "text", 400, 80)


_HASH = """{name} AS (SELECT {key}, list_transform(range(0, 64), lambda b: (len(list_filter(s, lambda x: x = b + 1)) - len(list_filter(s, lambda x: x = -(b + 1))))::DOUBLE) AS n
  FROM (SELECT {key}, list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 64 + 1) * CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT % 2 = 1 THEN -1 ELSE 1 END) AS s FROM {src}))"""


def hash_cte(name: str, key: str, text: str, src: str) -> str:
    return _HASH.format(name=name, key=key, text=text, src=src)


_NORM = "list_transform(n, lambda x: x / greatest(sqrt(list_sum(list_transform(n, lambda y: y * y))), 1e-12))"


@query(f"WITH {hash_cte('v', 'doc_id', 'text', 'documents')} SELECT doc_id, list_transform({_NORM}, lambda x: round(x, 6)) AS vector FROM v")
def encode_hash(spark, sf):
    return E.encode(docs(spark, sf), "text", E.HashEncoder()).select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(f"WITH {hash_cte('v', 'pair_id', 'sentence1', 'stsb_train')} SELECT pair_id, list_transform({_NORM}, lambda x: round(x, 6)) AS vector FROM v")
def encode_dedup(spark, sf):
    t = table(spark, sf, "stsb_train").select("pair_id", "sentence1")
    return E.encode_distinct(t, "sentence1", E.HashEncoder()).select("pair_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("SELECT md5(coalesce(sentence1, '')) AS text_key FROM stsb_dev EXCEPT SELECT md5(coalesce(sentence1, '')) FROM stsb_train")
def cache_misses(spark, sf):
    key = F.md5(T.or_empty(F.col("sentence1"))).alias("text_key")
    have = table(spark, sf, "stsb_train").select(key)
    return table(spark, sf, "stsb_dev").select(key).distinct().join(have, "text_key", "left_anti")


@query("SELECT doc_id, [length(coalesce(text, ''))::DOUBLE, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE ord(text) END::DOUBLE, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT::DOUBLE, 1.0] AS v FROM documents")
def fake_encoder(spark, sf):
    return docs(spark, sf).select("doc_id", E.FakeEncoder().encode(F.col("text")).alias("v"))


_CE = f"WITH {_COVER}, {_windows(128, 25)}, kept AS (SELECT doc_id, chunk_id, array_to_string(part, '') AS text, length(array_to_string(tok[1 : off], ''))::INT AS start FROM chunks WHERE {_NB.format('array_to_string(part, chr(32))')})"


@query(f"{_CE}, {hash_cte('v', 'doc_id, chunk_id', 'text', 'kept')} SELECT doc_id, chunk_id, list_transform({_NORM}, lambda x: round(x, 6)) AS vector FROM v")
def chunk_and_encode(spark, sf):
    c = E.chunk_and_encode(docs(spark, sf), "doc_id", "text", E.HashEncoder())
    return c.select("doc_id", "chunk_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(f"{_CE}, {hash_cte('v', 'doc_id, chunk_id, start', 'text', 'kept')} SELECT doc_id, chunk_id, start, list_transform({_NORM}, lambda x: round(x, 6)) AS vector FROM v")
def chunk_and_encode_aligned(spark, sf):
    c = E.chunk_and_encode(docs(spark, sf), "doc_id", "text", E.HashEncoder(), aligned=True)
    return c.select("doc_id", "chunk_id", "start", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(f"{_CE}, clean AS (SELECT doc_id, chunk_id, start, {_TAG} AS tag, regexp_replace(text, '⁎\\d*⁑', '', 'g') AS text FROM kept), {hash_cte('v', 'doc_id, chunk_id, start, tag', 'text', 'clean')} SELECT doc_id, chunk_id, start, tag, list_transform({_NORM}, lambda x: round(x, 6)) AS vector FROM v")
def chunk_and_encode_tagged_aligned(spark, sf):
    c = E.chunk_and_encode(docs(spark, sf), "doc_id", "text", E.HashEncoder(), aligned=True, tagged=True)
    return c.select("doc_id", "chunk_id", "start", "tag", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))
