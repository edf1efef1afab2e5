"""Scored sentence pairs: filters, split, shuffle, batches, unique texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import durable


def scored(df: DataFrame, score: str = "score") -> DataFrame:
    return df.where(F.col(score).isNotNull())


def at_least(df: DataFrame, least: float | None, score: str = "score") -> DataFrame:
    """Keeps unscored rows; a NaN score reaches no threshold, though Spark orders it above all numbers."""
    return df if least is None else df.where(F.col(score).isNull() | _reaches(score, least))


def _reaches(score: str, least: float) -> Column:
    return (F.col(score) >= least) & ~F.isnan(F.col(score).cast("double"))


def training_examples(df: DataFrame, threshold: float, contrastive: bool, query_prefix: str = "", document_prefix: str = "") -> DataFrame:
    """Contrastive: scored pairs below the threshold are dropped, unscored ones stay; otherwise a score is required. Missing scores
    count 1, prefixes go before anchor and positive."""
    kept = df.where(F.col("score").isNull() | _reaches("score", threshold)) if contrastive else scored(df)
    return kept.withColumns({"anchor": F.concat(F.lit(query_prefix), F.coalesce("anchor", F.lit(""))), "positive": F.concat(F.lit(document_prefix), F.coalesce("positive", F.lit(""))), "score": F.coalesce("score", F.lit(1.0))})


def all_scored(df: DataFrame, score: str = "score") -> DataFrame:
    return df.agg(((F.count("*") > 0) & (F.count("*") == F.count(score))).alias("all_scored"))


def shuffle_key(key: Column, seed: int) -> Column:
    """The order of a seeded shuffle, the same in every engine and for every partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def numbered(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Adds the 0-based global position in the given order without a one-partition window: rows are range-partitioned, partitions are
    counted, positions are offsets."""
    parts = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__s"))
    before = sizes.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order))).join(before, "__p").withColumn(out, F.col("__b") + F.col("__r") - 1).drop("__p", "__r", "__b")


def validation_count(n: int, fraction: float) -> int:
    if not 0 <= fraction < 1:
        raise ValueError("the validation fraction lies in [0, 1)")
    return min(max(round(n * fraction), 0), max(0, n - 1))


def split(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Adds position (in the seeded shuffle) and validation: exactly round-half-even(n x fraction) rows, at most n - 1."""
    n = validation_count(df.count(), fraction)
    return numbered(df, [shuffle_key(F.col(key), seed), F.col(key)]).withColumn("validation", F.col("position") < n)


def batches(df: DataFrame, size: int, position: str = "position") -> DataFrame:
    return df.withColumn("batch_id", F.floor(F.col(position) / size))


def unique_texts(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct non-null texts of the given columns."""
    out = df.select(F.col(columns[0]).alias("text"))
    for c in columns[1:]:
        out = out.union(df.select(c))
    return out.where("text is not null").distinct()


def first_seen(df: DataFrame, text: str, key: str) -> DataFrame:
    """Each distinct text with the smallest key at which it occurs."""
    return df.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias("first_key"))


def intern(df: DataFrame, text: str) -> DataFrame:
    """Each distinct text with its 0-based place in text order."""
    return numbered(df.where(F.col(text).isNotNull()).select(text).distinct(), [F.col(text)], "text_index")


def conflicts(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch_id, i, j): in-batch pairs that are no negatives of each other, their anchor or positive texts being equal. df holds
    pair_id, anchor, positive and a batch of bounded size."""
    other = df.select(batch, F.col("pair_id").alias("j"), F.col("anchor").alias("a2"), F.col("positive").alias("p2"))
    same = (F.col("positive") == F.col("p2")) | (F.col("anchor") == F.col("a2")) | (F.col("p2") == F.col("anchor")) | (F.col("a2") == F.col("positive"))
    return df.join(other, batch).where((F.col("pair_id") != F.col("j")) & same).select(batch, F.col("pair_id").alias("i"), "j")


def early_stop(df: DataFrame, run: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """Adds best (so far), since (epochs without a better value) and stop."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(metric) > before)
    marked = df.withColumn("best", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__at", F.when(better, F.col(epoch)))
    return marked.withColumn("since", F.col(epoch) - F.max("__at").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("stop", F.col("since") >= patience).drop("__at")


def best_checkpoint(df: DataFrame, run: str, epoch: str, metric: str) -> DataFrame:
    """Each run's best epoch; of equal ones the first."""
    w = Window.partitionBy(run).orderBy(F.desc(metric), epoch)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
