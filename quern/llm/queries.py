"""Queries pN_... of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import table


def _chunks(spark, sf) -> DataFrame:
    return table(spark, sf, "encoded_chunk").select("chunk_key", "vector")


def p1_found(spark, sf):
    from quern.llm.clusters import similarity_clusters

    return similarity_clusters(_chunks(spark, sf)).select(F.col("key").alias("chunk_key"), F.col("cluster").alias("cluster_key"))


def p1_clusters(spark, sf):
    """Each cluster's size, mean typicality, three most typical chunks and the text of the most typical one."""
    from quern.llm.clusters import describe_clusters, similarity_clusters
    from quern.session import durable

    members = durable(similarity_clusters(_chunks(spark, sf)))
    return describe_clusters(members, table(spark, sf, "encoded_chunk").select("chunk_key", "text")).select(F.col("cluster").alias("cluster_key"), "size", "mean_typicality", "typical_keys", "typical_text")


def p6_found(spark, sf):
    from quern.llm.vectors import similar_neighbours

    found = similar_neighbours(_chunks(spark, sf), k=5, similarity=0.75)
    return found.select(F.least("key", "neighbour").alias("chunk_key_a"), F.greatest("key", "neighbour").alias("chunk_key_b")).distinct()


def p6_neighbours(spark, sf):
    """The 5 most similar others of every chunk whose key is divisible by 100, however far they are."""
    from quern.llm.vectors import nearest_of

    rows = _chunks(spark, sf)
    return nearest_of(rows.where(F.col("chunk_key") % 100 == 0), rows, k=5).select(F.col("key").alias("chunk_key"), F.col("neighbour").alias("neighbour_key"), F.col("rank").cast("bigint").alias("rank"), F.round(F.col("micro") / 1e6, 6).alias("similarity"))


def _records(spark, sf):
    dev = table(spark, sf, "stsb_dev").withColumn("split", F.lit("dev"))
    return dev.unionByName(table(spark, sf, "stsb_test").withColumn("split", F.lit("test")))


def _cross(spark, sf):
    from quern.llm.overlap import cross_split_pairs

    cols = ["pair_id", "sentence1", "sentence2"]
    return cross_split_pairs(table(spark, sf, "stsb_train").select(*cols), _records(spark, sf).select(*cols))


def p2_found(spark, sf):
    pairs = _cross(spark, sf)
    return pairs.select(F.least("train_id", "eval_id").alias("pair_id_a"), F.greatest("train_id", "eval_id").alias("pair_id_b")).distinct()


def p2_overlaps(spark, sf):
    from quern.llm.overlap import overlap_report

    return overlap_report(_cross(spark, sf), _records(spark, sf))


def p3_found(spark, sf):
    from quern.llm.splitting import found_hard

    return found_hard(table(spark, sf, "encoded_chunk_aligned"), "doc_id", "original_text").withColumnRenamed("doc", "doc_id")


def p3_pieces(spark, sf):
    from quern.llm.splitting import split_texts

    return split_texts(table(spark, sf, "encoded_chunk_aligned"), "doc_id", "original_text").withColumnRenamed("doc", "doc_id")


def p3_cover(spark, sf):
    """Per long text: whether its pieces are verbatim, within the limit, without gaps, and end with the text."""
    from pyspark.sql import Window

    from quern.llm.splitting import one_text, split_texts

    t = table(spark, sf, "encoded_chunk_aligned")
    whole = one_text(t, "doc_id", "original_text").withColumnRenamed("text", "whole")
    end = F.col("start_pos") + F.length("text")
    last = F.max(end).over(Window.partitionBy("doc").orderBy("start_pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = split_texts(t, "doc_id", "original_text").withColumn("gap", F.col("start_pos") > F.coalesce(last, F.lit(0))).join(whole, "doc")
    good = (F.length("text") <= 1200) & ~F.col("gap") & (F.substr("whole", F.col("start_pos").cast("int") + 1, F.length("text")) == F.col("text"))
    return rows.groupBy(F.col("doc").alias("doc_id")).agg(F.max(end).alias("n_chars"), F.min(good).alias("covered"))


def p4_size(spark, sf):
    """How many rows were selected, and how many distinct valid ones among them."""
    valid = _chunks(spark, sf).where((F.size("vector") == 128) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))
    got = p4_subset(spark, sf)
    return got.join(valid.select("chunk_key", F.lit(1).alias("valid")), "chunk_key", "left").agg(F.count("*").alias("selected"), F.count_distinct(F.when(F.col("valid") == 1, F.col("chunk_key"))).alias("distinct_valid"))


def p4_subset(spark, sf):
    from quern.llm.kcenter import varied_subset

    return varied_subset(_chunks(spark, sf), 0.01).select(F.col("key").alias("chunk_key"), "gap")


def p7_containers(spark, sf):
    from quern.llm.packing import pack_texts

    return pack_texts(table(spark, sf, "documents").select("doc_id", "text"))


def p7_fill(spark, sf):
    """Containers, tokens and the share of the containers' room that is filled."""
    per = p7_containers(spark, sf).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.round(F.sum("n") / (F.count("*") * 512), 6).alias("fill"))


def _leaks(spark, sf):
    from quern.llm.leakage import leaked_items

    return leaked_items(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_passages").select("item_id", "passage"))


def p8_found(spark, sf):
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_spans(spark, sf):
    return _leaks(spark, sf)


def _scores(spark, sf):
    from quern.llm.toxic import score_documents

    return score_documents(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "doc_labels").select("doc_id", "toxic"))


def p9_found(spark, sf):
    return _scores(spark, sf).where("score >= 0.5").select("doc_id").distinct()


def p9_scores(spark, sf):
    return _scores(spark, sf)


def p9_rates(spark, sf):
    from quern.llm.toxic import rates

    return rates(_scores(spark, sf), table(spark, sf, "documents").select("doc_id", "source"))


_VALID = """valid AS (SELECT chunk_key, list_transform(vector, lambda x: x::DOUBLE) AS v FROM encoded_chunk
  WHERE len(vector) = 128 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""
_SIMILAR = f"""{_VALID}, s AS (SELECT a.chunk_key AS k, b.chunk_key AS o, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM valid a JOIN valid b ON a.chunk_key <> b.chunk_key), near AS (SELECT * FROM s WHERE c >= 0.75)"""

SQL = {
    # every set of similar chunks is closed here, so a chunk's set is itself and all that are similar to it
    "p1_found": f"WITH {_SIMILAR} SELECT k AS chunk_key, least(k, min(o)) AS cluster_key FROM near GROUP BY k HAVING count(*) >= 4",
    "p3_found": r"""WITH t AS (SELECT doc_id, arg_max(original_text, length(original_text)) AS t FROM encoded_chunk_aligned WHERE original_text IS NOT NULL GROUP BY doc_id HAVING max(length(original_text)) > 1200),
p AS (SELECT doc_id, regexp_extract_all(t, '[^\s\p{Z}.!?。！？]+|[\s\p{Z}.!?。！？]+') AS p FROM t), u AS (SELECT doc_id, unnest(p) AS x, unnest(range(0, len(p))) AS i FROM p),
w AS (SELECT doc_id, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS off FROM u), h AS (SELECT doc_id, off FROM w WHERE length(x) > 1200 AND NOT regexp_matches(x, '^[\s\p{Z}.!?。！？]'))
SELECT t.doc_id, coalesce(h.off, -1)::BIGINT AS hard_start FROM t LEFT JOIN h USING (doc_id)""",
    "p3_cover": "SELECT doc_id, max(length(original_text)) AS n_chars, true AS covered FROM encoded_chunk_aligned WHERE original_text IS NOT NULL GROUP BY doc_id HAVING max(length(original_text)) > 1200",
    "p4_size": f"WITH {_VALID}, n AS (SELECT greatest(1, round_even(count(*) * 0.01, 0))::BIGINT AS k FROM valid) SELECT k AS selected, k AS distinct_valid FROM n",
    "p6_found": f"""WITH {_SIMILAR}, top AS (SELECT k, o FROM near QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, o) <= 5)
SELECT DISTINCT least(k, o) AS chunk_key_a, greatest(k, o) AS chunk_key_b FROM top""",
    "p6_neighbours": f"""WITH {_VALID}, s AS (SELECT a.chunk_key, b.chunk_key AS neighbour_key, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM valid a JOIN valid b ON a.chunk_key <> b.chunk_key WHERE a.chunk_key % 100 = 0)
SELECT chunk_key, neighbour_key, row_number() OVER (PARTITION BY chunk_key ORDER BY similarity DESC, neighbour_key) AS rank, similarity FROM s QUALIFY rank <= 5""",
}


def queries() -> dict:
    every = (p1_found, p1_clusters, p2_found, p2_overlaps, p3_found, p3_pieces, p3_cover, p4_subset, p4_size, p6_found, p6_neighbours, p7_containers, p7_fill, p8_found, p8_spans, p9_found, p9_scores, p9_rates)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
