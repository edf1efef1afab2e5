"""Evaluation metrics over score columns and pair vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.search import _normal, matrix, query_blocks
from quern.session import durable, local_broadcast


def correlation(x: Column, y: Column) -> Column:
    """Null where a column does not vary (the built-in raises in ANSI mode)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pearson(df: DataFrame, a: str, b: str, out: str = "pearson") -> DataFrame:
    """One row: NaN without rows, 0 where a column does not vary. One pass of moments, combined map-side."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    ok = df.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    r = ok.agg(F.count("*").alias("n"), correlation(x, y).alias("r"))
    return r.select(F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).alias(out))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the 1-based rank in which ties share their mean: counts of smaller values, taken over the distinct values only, so that no
    task sees all rows. Nulls get no row; equal values cost one row of the ranking."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    parts = counts.select(column, "__n").repartitionByRange(column).withColumn("__p", F.spark_partition_id())
    parts = durable(parts)
    sizes = parts.groupBy("__p").agg(F.sum("__n").alias("__s"))  # one row a partition
    before = sizes.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inner = F.sum("__n").over(Window.partitionBy("__p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    ranks = parts.withColumn("__c", inner).join(before, "__p").select(column, (F.col("__b") + F.col("__c") - F.col("__n") + (F.col("__n") + 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, column)


def spearman(df: DataFrame, a: str, b: str, out: str = "spearman") -> DataFrame:
    """Pearson of average ranks over rows where both are present; NaN below two rows, 0 without variation."""
    ok = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    ok = durable(ok)  # read once for each ranking and for each join back
    r = average_ranks(average_ranks(ok, "x", "rx"), "y", "ry").agg(F.count("*").alias("n"), correlation(F.col("rx"), F.col("ry")).alias("r"))
    return r.select(F.when(F.col("n") < 2, F.lit(float("nan"))).otherwise(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).alias(out))


def retrieval_ranks(pairs: DataFrame, block: int = 2_048) -> DataFrame:
    """(pair_id, rank): 1 + the number of other pairs' positives that are more similar to the anchor than its own, compared at 6 decimals.

    pairs is (pair_id, anchor, positive). Anchors go out in blocks; partitions count, nothing else is shuffled."""
    spark = pairs.sparkSession
    rows = pairs.select(F.col(pairs.columns[0]).alias("pair_id"), F.col(pairs.columns[1]).alias("a"), F.col(pairs.columns[2]).alias("p")).where("a is not null and p is not null")
    own = rows.select("pair_id", F.concat("a", "p").alias("both"))
    out = None
    for keys, both in query_blocks(own, block):
        half = both.shape[1] // 2
        a, p = _normal(both[:, :half]), _normal(both[:, half:])
        mine = np.round(np.einsum("ij,ij->i", a, p), 6)
        sent = local_broadcast(spark, (keys, a, mine), 256 << 20, a.nbytes)

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            k, a, mine = sent.value
            over = np.zeros(len(k), np.int64)
            for b in it:
                ids, v = matrix(b)
                if len(ids):
                    s = np.round(a @ _normal(v).T, 6)
                    over += ((s > mine[:, None]) & (k[:, None] != ids.to_numpy(zero_copy_only=False)[None, :])).sum(1)
            yield pa.record_batch([pa.array(k, pa.int64()), pa.array(over)], names=["pair_id", "over"])

        part = rows.select(F.col("pair_id").cast("bigint"), "p").mapInArrow(run, "pair_id bigint, over bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "pair_id bigint, rank bigint")
    return out.groupBy("pair_id").agg((F.sum("over") + 1).alias("rank"))


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """(pairs, accuracy, mrr); both metrics are NaN below two pairs."""
    n = F.count("*")
    nan = F.lit(float("nan"))
    return ranks.agg(n.alias("pairs"), F.when(n < 2, nan).otherwise(F.round(F.avg((F.col("rank") == 1).cast("double")), 6)).alias("accuracy"), F.when(n < 2, nan).otherwise(F.round(F.avg(F.lit(1.0) / F.col("rank")), 6)).alias("mrr"))


def parity(df: DataFrame, score: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Least, mean and largest score, and whether the least reaches the threshold."""
    aggs = (F.count("*").alias("n"), F.round(F.min(score), 6).alias("least"), F.round(F.avg(score), 6).alias("mean"), F.round(F.max(score), 6).alias("most"), (F.min(score) >= threshold).alias("passed"))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def upper_median(column: str) -> Column:
    """The element n/2 of the sorted values, exactly, from counts of the distinct values that are combined map-side."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def relative_l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.sum((a - b) * (a - b)) / F.sum(a * a))


def throughput(df: DataFrame, by: str, seconds: str, texts: str, tokens: str) -> DataFrame:
    """Per group: rates of bytes, texts and tokens over the summed seconds."""
    return df.groupBy(by).agg(F.sum(seconds).alias("s"), F.sum(texts).alias("texts"), F.sum(tokens).alias("tokens")).select(by, F.round(F.col("texts") / F.col("s"), 6).alias("texts_per_s"), F.round(F.col("tokens") / F.col("s"), 6).alias("tokens_per_s"))
