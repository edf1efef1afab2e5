"""Incremental ingestion: a stream of documents goes through the same chunk and encode steps, vectors land in a store keyed by text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import encode as E

STORE = "text_key string, vector array<double>"


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def chunk_stream(stream: DataFrame, key: str, text: str, by: E.Encoder, length: int = 128, overlap: int = 25) -> DataFrame:
    """Chunks with vectors, stateless: each row of the stream becomes its chunks."""
    return E.chunk_and_encode(stream, key, text, by, length, overlap, aligned=True, tagged=True)


def encode_into_store(stream: DataFrame, text: str, by: E.Encoder, store: str, checkpoint: str):
    """Encodes the texts of each micro-batch that the store (a Parquet folder of text_key, vector) does not hold yet. A batch that is
    run again after a failure writes its own folder again, so nothing is stored twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        need = batch.select(F.md5(T.or_empty(F.col(text))).alias("text_key"), T.or_empty(F.col(text)).alias("t")).dropDuplicates(["text_key"])
        own = os.path.join(store, f"batch={number}")
        if os.path.isdir(store) or "://" in store:
            try:
                have = spark.read.schema(STORE + ", batch bigint").parquet(store).where(F.col("batch") != number)
                need = need.join(have.select("text_key"), "text_key", "left_anti")
            except Exception as e:  # an empty store has no files yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        need.select("text_key", by.encode(F.col("t")).alias("vector")).write.mode("overwrite").parquet(own)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
