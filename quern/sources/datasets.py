"""Sentence-pair data sets and embedding files as DataFrames with explicit schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = "anchor string, positive string, score float, negative string"


def read_stsb(spark: SparkSession, path: str) -> DataFrame:
    """(anchor, positive, score, negative): quoted three-column records without header; the score, out of 5, is scaled and clamped to
    [0, 1]; records with fewer fields or an unreadable score are left out. Raises if the file holds no record."""
    raw = spark.read.schema("a string, b string, s string").option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    if raw.isEmpty():
        raise ValueError(f"no record in {path}")
    score = F.col("s").try_cast("double")
    return raw.where(score.isNotNull()).select(F.col("a").alias("anchor"), F.col("b").alias("positive"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / 5)).cast("float").alias("score"), F.lit(None).cast("string").alias("negative"))


def read_patents(spark: SparkSession, path: str) -> DataFrame:
    """(anchor, positive, score, negative) of a five-column file with header: anchor, target, rating, score, context; other widths are
    left out, scores clamped to [0, 1]."""
    lines = spark.read.text(path)
    f = F.split("value", ",", -1)
    rows = lines.where((F.size(f) == 5) & (F.col("value") != "anchor,target,rating,score,context")).select(f.alias("f"))
    score = F.element_at("f", 4).try_cast("double")
    return rows.where(score.isNotNull()).select(F.element_at("f", 1).alias("anchor"), F.element_at("f", 2).alias("positive"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).cast("float").alias("score"), F.lit(None).cast("string").alias("negative"))


SPLITS = {"train": "train", "dev": "dev", "validation": "dev", "test": "test"}


def load_dataset(spark: SparkSession, name: str, folder: str, split: str) -> DataFrame:
    """Data set registry; an unknown split means test. Files are {name}-{split}.csv below the folder."""
    readers = {"stsb": ("stsb-en", read_stsb), "patents": ("patents", read_patents)}
    if name not in readers:
        raise KeyError(f"no data set {name!r}; known: {sorted(readers)}")
    stem, reader = readers[name]
    return reader(spark, os.path.join(folder, f"{stem}-{SPLITS.get(split, 'test')}.csv"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(model, dim, position, sentence, embedding) of a golden-embedding JSON document."""
    j = spark.read.schema("model string, dim int, sentences array<string>, embeddings array<array<float>>").json(path, multiLine=True)
    return j.select("model", "dim", F.posexplode(F.arrays_zip("sentences", "embeddings")).alias("position", "z")).select("model", "dim", "position", F.col("z.sentences").alias("sentence"), F.col("z.embeddings").alias("embedding"))


def write_golden(path: str, model: str, sentences: list[str], embeddings: list[list[float]]) -> None:
    import json

    with open(path, "w", encoding="utf-8") as f:
        json.dump({"model": model, "dim": len(embeddings[0]) if embeddings else 0, "sentences": sentences, "embeddings": embeddings}, f, ensure_ascii=False)


def synthetic_corpus(spark: SparkSession, texts: int, paragraphs: int, sentences: int, words: int, pool: list[str], seed: int = 4) -> DataFrame:
    """(id, text): paragraphs of sentences of pool words chosen by hash, the same for every partitioning."""
    pick = lambda s: F.element_at(F.array(*map(F.lit, pool)), (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), s.cast("string"))), 1, 8), 16, 10).cast("bigint") % len(pool) + 1).cast("int"))
    sentence = lambda i: F.concat(F.array_join(F.transform(F.sequence(i * words, i * words + words - 1), pick), " "), F.lit("."))
    paragraph = lambda p: F.array_join(F.transform(F.sequence(p * sentences, p * sentences + sentences - 1), sentence), " ")
    return spark.range(texts).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(paragraphs - 1)), paragraph), "\n\n").alias("text"))


def calibrated_text(count, target: int, words: list[str]) -> str:
    """Grows a text word by word, then by ' a', until count(text) reaches the target number of tokens."""
    out, i = "", 0
    while True:
        longer = (out + " " + words[i % len(words)]).strip()
        if count(longer) > target:
            break
        out, i = longer, i + 1
        if count(out) == target:
            return out
    while count(out + " a") <= target:
        out += " a"
    return out


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
