"""Row to many rows: token windows with offsets, character-budget chunks, page tags. Windows have a closed form, so no UDF is needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.vector import let


def clamp_arguments(length: int, overlap: int, most: int, strict: bool = False) -> tuple[int, int]:
    """length <= 0 or beyond `most` becomes `most`; a negative overlap, or one beyond length (strict: of length or more), a fifth of it."""
    length = most if length <= 0 or length > most else length
    bad = overlap < 0 or (overlap >= length if strict else overlap > length)
    return length, length // 5 if bad else overlap


def window_starts(n: Column, length: int, overlap: int) -> Column:
    """Zero-based starts of the windows over n tokens."""
    step = max(1, length - overlap)
    last = F.ceil(F.greatest(n - length, F.lit(0)) / F.lit(step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def char_budget(c: Column, length: int, max_chunks: int | None, ratio: int) -> Column:
    """Limit push-down below the tokeniser: the first characters that a bounded number of chunks can use."""
    return c if max_chunks is None else F.left(c, F.lit(min(2**31 - 1, length * max_chunks * ratio)))


def chunk_tokens(df: DataFrame, key: str, tokens: Column, length: int, overlap: int, joiner: str = " ", max_chunks: int | None = None, legacy_cap: bool = False) -> DataFrame:
    """(key, chunk_id, n_tokens, chunk): windows of tokens, blank ones left out without renumbering the others.

    max_chunks keeps the first of them; legacy_cap allows one more. Null texts have no tokens and give no chunk."""
    one = lambda t: lambda at: let(F.slice(t, at + 1, length), lambda p: F.struct(F.size(p).alias("n_tokens"), F.array_join(p, joiner).alias("chunk")))
    windows = let(tokens, lambda t: F.transform(window_starts(F.size(t), length, overlap), one(t)))  # sliced before the explode: a window's row holds its own tokens only
    out = df.select(key, F.posexplode(windows).alias("chunk_id", "w")).select(key, "chunk_id", "w.n_tokens", "w.chunk").where(~T.is_blank(F.col("chunk")))
    return out if max_chunks is None else out.where(F.col("chunk_id") < max_chunks + legacy_cap)


def chunk_aligned(df: DataFrame, key: str, text: str, length: int, overlap: int, max_chunks: int | None = None) -> DataFrame:
    """(key, chunk_id, value, start, last_start, approx_end): verbatim slices of the text with code point offsets."""
    step = max(1, length - overlap)
    steps = lambda t: F.transform(window_starts(F.size(t), length, overlap), lambda at: F.length(F.array_join(F.slice(t, at + 1, step), "")))
    one = lambda t, before: lambda at, i: let(F.slice(t, at + 1, length), lambda p: F.struct(F.array_join(p, "").alias("value"), F.aggregate(F.slice(before, 1, i), F.lit(0), lambda a, x: a + x).alias("start"), F.length(F.element_at(p, -1)).alias("tail")))
    # tokens cover the text, so a window starts where the steps before it end; each token's length is taken once
    windows = let(T.covering_tokens(T.or_empty(F.col(text))), lambda t: let(steps(t), lambda before: F.transform(window_starts(F.size(t), length, overlap), one(t, before))))
    out = df.select(key, F.posexplode(windows).alias("chunk_id", "w")).select(key, "chunk_id", "w.*")
    out = out.withColumn("approx_end", F.col("start") + F.length("value")).withColumn("last_start", F.col("approx_end") - F.col("tail")).drop("tail").where(~T.is_blank(F.col("value")))
    return (out if max_chunks is None else out.where(F.col("chunk_id") < max_chunks)).select(key, "chunk_id", "value", "start", "last_start", "approx_end")


def from_original(text: Column, start: Column, end: Column, reach: int = 10) -> Column:
    """The original span; an end inside a word moves to the next blank or line end if that is near."""
    n = F.length(text)
    rest = F.substring(text, end + 1, F.lit(reach))
    here = F.substring(text, end + 1, F.lit(1))
    gap = F.regexp_instr(rest, F.lit("[ \\n]"))
    stop = F.when(end >= n, n).when(~here.rlike("^\\s") & (gap > 0), end + gap - 1).otherwise(end)
    return F.substring(text, start + 1, stop - start)


def with_tags(chunks: DataFrame, text: str, strip: Callable[[Column], Column] = T.strip_pages, tag: Callable[[Column], Column] = T.page_tag) -> DataFrame:
    """Adds the tag and takes the marks out of the text column; both callables are the user's."""
    return chunks.withColumn("tag", tag(F.col(text))).withColumn(text, strip(F.col(text)))


def pack_words(text: str | None, length: int, overlap: int, max_chunks: int | None = None) -> list[str]:
    """Greedy packing of words into chunks of at most `length` characters, keeping a tail of at most `overlap` characters.

    A single longer word is a chunk of its own. At most max_chunks + 1 chunks come out."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for word in (w for w in (text or "").replace("\n", " ").replace("\r", " ").split(" ") if w):
        if held and size + 1 + len(word) > length:
            out.append(" ".join(held))
            if max_chunks is not None and len(out) > max_chunks:
                return out
            while held and (size > overlap or size + 1 + len(word) > length):
                size -= len(held.pop(0)) + (1 if held else 0)
        size += len(word) + (1 if held else 0)
        held.append(word)
    if held:
        out.append(" ".join(held))
    return out


def chunk_strings(df: DataFrame, key: str, text: str, length: int, overlap: int, max_chunks: int | None = None) -> DataFrame:
    """(key, chunk_id, chunk) of pack_words; the packing is a loop over words, so it runs over Arrow batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(k, i, c) for k, t in zip(pdf[key], pdf[text]) for i, c in enumerate(pack_words(t, length, overlap, max_chunks))]
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "chunk"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_id int, chunk string")
