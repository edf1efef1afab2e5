"""Cuts long texts into overlapping pieces at natural boundaries, range by range, without any worker holding a whole text.

A text (a table's column or a UTF-8 file) is cut into byte ranges with halos. Each range finds its boundaries alone: the first natural
boundary after a range's start is a forced cut that the range before finds too, in its right halo, so ranges agree without talking.
Small boundary tables (length, leading and trailing unbroken run) are stitched by window functions: prefix sums turn offsets inside
a range into offsets of the text, and runs that cross ranges are added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.vector import let
from quern.session import durable

BREAKERS = ".!?。！？"
_RUN = re.compile(rf"[^\s{BREAKERS}]+")
_SENTENCE = re.compile(r"(?:[.!?](?=\s)|[。！？]|\n)[\s\"'»”)]*")
_SPACE = re.compile(r"\s+")

#: Bytes of a range, of its left halo (the overlap) and right halo (the search for a boundary) a code point of the limit.
SIZE, HALO = 32_768, 5
TABLE_SCHEMA = "doc {kind}, r int, n bigint, lead bigint, trail bigint, whole boolean, inner array<struct<start:bigint,len:bigint>>"
PIECE_SCHEMA = "doc {kind}, r int, rel bigint, piece string"


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def text_ranges(df: DataFrame, key: str, text: str, size: int, halo: int) -> DataFrame:
    """(doc, r, raw, lo, hi): byte ranges of `size` with halos of the non-null texts of df, cut by the JVM; raw[lo:hi] is the range, up
    to whole characters. key must be unique."""

    def cut_up(raw):
        first = lambda s: F.greatest(s - halo, F.lit(0))
        piece = lambda s: F.struct((s / size).cast("int").alias("r"), F.substr(raw, first(s) + 1, s + size + halo - first(s)).alias("raw"), (s - first(s)).alias("lo"), (F.least(s + size, F.length(raw)) - first(s)).alias("hi"))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.length(raw) - 1, F.lit(0)), F.lit(size)), piece)

    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    return rows.select(F.col(key).alias("doc"), F.explode(let(F.col(text).cast("binary"), cut_up)).alias("p")).select("doc", "p.*")


def file_ranges(spark: SparkSession, paths: list[str], size: int = 8 << 20, halo: int = 6_000) -> DataFrame:
    """text_ranges() of UTF-8 files; doc is the path, or the URI of a shared file system. A worker seeks to its range and reads nothing
    else of the file."""
    from pyarrow import fs

    plan = []
    for p in paths:
        system, at = fs.FileSystem.from_uri(p)
        total = system.get_file_info(at).size
        plan += [(p, r, s, total) for r, s in enumerate(range(0, max(1, total), size))]
    ranges = spark.createDataFrame(plan, "doc string, r int, start bigint, total bigint").repartition(max(1, len(plan)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                system, at = fs.FileSystem.from_uri(row["doc"])
                lo, hi = row["start"], min(row["total"], row["start"] + size)
                first = max(0, lo - halo)
                with system.open_input_file(at) as f:
                    f.seek(first)
                    raw = f.read(hi + halo - first)
                yield pa.record_batch([pa.array([row["doc"]]), pa.array([row["r"]], pa.int32()), pa.array([raw], pa.binary()), pa.array([lo - first], pa.int32()), pa.array([hi - first], pa.int32())], names=["doc", "r", "raw", "lo", "hi"])

    return ranges.mapInArrow(run, "doc string, r int, raw binary, lo int, hi int")


def decoded(raw: bytes, lo: int, hi: int) -> tuple[str, str, str]:
    """Left halo, body and right halo; a range starts at the first whole character at or after its first byte."""
    ends = []
    for at in (lo, hi):
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        ends.append(at)
    return tuple(x.decode("utf-8", "ignore") for x in (raw[: ends[0]], raw[ends[0] : ends[1]], raw[ends[1] :]))


def boundary_table(ranges: DataFrame, limit: int) -> DataFrame:
    """One small row a range: its length, its leading and trailing unbroken runs and the runs inside that are longer than limit."""
    kind = _kind(ranges, "doc")
    struct = pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, lead, trail, whole, inner = [], [], [], [], []
            for x in (decoded(*row)[1] for row in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))):
                spans = [m.span() for m in _RUN.finditer(x)] if x else []
                n.append(len(x))
                lead.append(spans[0][1] if spans and spans[0][0] == 0 else 0)
                trail.append(len(x) - spans[-1][0] if spans and spans[-1][1] == len(x) else 0)
                whole.append(bool(spans) and spans[0] == (0, len(x)))
                inner.append([{"start": s, "len": e - s} for s, e in spans if e - s > limit and s > 0 and e < len(x)])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(lead, pa.int64()), pa.array(trail, pa.int64()), pa.array(whole), pa.array(inner, struct)], names=["doc", "r", "n", "lead", "trail", "whole", "inner"])

    return ranges.select("doc", "r", "raw", "lo", "hi").mapInArrow(run, TABLE_SCHEMA.format(kind=kind))


def stitch(table: DataFrame) -> DataFrame:
    """Adds base, the text's code points before the range, and the number of the unbroken stretch that each end belongs to."""
    before = Window.partitionBy("doc").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "stretch": F.coalesce(F.sum((~F.col("whole")).cast("int")).over(before), F.lit(0))})


def hard_stretches(stitched: DataFrame, limit: int) -> DataFrame:
    """(doc, hard_start, hard_length) of every longest stretch of more than limit code points without white space or sentence end."""
    ends = F.array(
        F.struct(F.col("stretch").alias("g"), F.col("base").alias("start"), F.when(F.col("whole"), F.col("n")).otherwise(F.col("lead")).alias("len")),
        F.struct((F.col("stretch") + 1).alias("g"), (F.col("base") + F.col("n") - F.col("trail")).alias("start"), F.when(F.col("whole"), 0).otherwise(F.col("trail")).alias("len")),
    )
    crossing = stitched.select("doc", F.explode(ends).alias("e")).select("doc", "e.*").where("len > 0").groupBy("doc", "g").agg(F.min("start").alias("hard_start"), F.sum("len").alias("hard_length")).drop("g")
    inside = stitched.select("doc", "base", F.explode("inner").alias("e")).select("doc", (F.col("base") + F.col("e.start")).alias("hard_start"), F.col("e.len").alias("hard_length"))
    return crossing.unionByName(inside).where(F.col("hard_length") > limit)


def _sync(body: str, limit: int) -> int:
    """The forced cut of a range: behind the first sentence end within the limit, else behind the first white space, else at 0."""
    head = body[:limit]
    m = _SENTENCE.search(head) or _SPACE.search(head)
    return m.end() if m and m.end() < len(head) else 0


def cut(text: str, start: int, end: int, first: int, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of pieces that cover text[start:end]; the first one begins at `first` <= start, the last ends at end."""
    p = first
    while p < end or p == start == first == end:
        if end - p <= limit:
            if end > p:
                yield p, end
            return
        low = p + limit // 2
        stop = 0
        for m in _SENTENCE.finditer(text, low, p + limit):
            stop = m.end()
        if stop <= low:
            for m in _SPACE.finditer(text, low, p + limit):
                stop = m.end()
        if stop <= low:
            stop = p + limit
        yield p, stop
        p = max(p + 1, _restart(text, stop, overlap))


def _restart(text: str, stop: int, overlap: int) -> int:
    """About `overlap` before stop, at the start of a word if one begins nearby."""
    want = max(0, stop - overlap)
    reach = overlap // 4
    near = [m.end() for m in _SPACE.finditer(text, max(0, want - reach), min(stop, want + reach))]
    return min(near, key=lambda x: abs(x - want)) if near else want


def range_pieces(ranges: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of each range, with offsets relative to the range's start."""
    kind = _kind(ranges, "doc")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, no, rel, out = [], [], [], []
            for key, r, *row in zip(*(b.column(i).to_pylist() for i in range(5))):
                lt, bd, rt = decoded(*row)
                whole = lt + bd + rt
                start = len(lt) + (_sync(bd, limit) if r else 0)
                end = len(lt) + len(bd) + (_sync(rt, limit) if rt else 0)
                first = _restart(whole, start, overlap) if r else start
                for s, e in cut(whole, start, end, first, limit, overlap):
                    at.append(key), no.append(r), rel.append(s - len(lt)), out.append(whole[s:e])
            if at:
                yield pa.record_batch([pa.array(at, b.schema.field(0).type), pa.array(no, pa.int32()), pa.array(rel, pa.int64()), pa.array(out)], names=["doc", "r", "rel", "piece"])

    return ranges.mapInArrow(run, PIECE_SCHEMA.format(kind=kind))


def split_ranges(ranges: DataFrame, limit: int = 1_200, overlap: int = 120) -> DataFrame:
    """(doc, text, start_pos) of all pieces of texts longer than limit, from their ranges.

    Pieces hold at most limit code points, end behind a sentence or a line where one ends in their second half, else behind white
    space, else at the limit, and begin about `overlap` before the end of the piece before. start_pos counts code points. A range must
    hold at least limit characters of any length and its halos as well: 4 x limit bytes. Empty texts and texts within the limit have
    no pieces.
    """
    base = stitch(durable(boundary_table(ranges, limit)))
    total = base.groupBy("doc").agg(F.sum("n").alias("total")).where(F.col("total") > limit)
    where = base.select("doc", "r", "base").join(total, "doc")
    return range_pieces(ranges, limit, overlap).join(where, ["doc", "r"]).select("doc", F.col("piece").alias("text"), (F.col("base") + F.col("rel")).alias("start_pos"))


def one_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a key: its longest text, of equally long ones the last in order. Null keys and texts are left out."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return rows.groupBy("doc").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("m")).select("doc", F.col("m.text").alias("text"))


def found_hard(df: DataFrame, key: str, text: str, limit: int = 1_200, size: int = SIZE) -> DataFrame:
    """(doc, hard_start): the hard stretches of each text longer than limit, or -1 where it has none."""
    ranges = text_ranges(one_text(df, key, text), "doc", "text", size, 4)  # a range reads on to its last character's end
    stitched = stitch(durable(boundary_table(ranges, limit)))
    long = stitched.groupBy("doc").agg(F.sum("n").alias("total")).where(F.col("total") > limit).select("doc")
    return long.join(hard_stretches(stitched, limit), "doc", "left").select("doc", F.coalesce("hard_start", F.lit(-1)).cast("bigint").alias("hard_start"))


def split_texts(df: DataFrame, key: str, text: str, limit: int = 1_200, overlap: int = 120, size: int = SIZE) -> DataFrame:
    """(doc, text, start_pos) of the pieces of every text of df that is longer than limit; repeated rows of a key count once. Ranges have
    `size` bytes, at least 4 x limit."""
    whole = durable(one_text(df, key, text))  # ranges are read twice: for boundaries and for pieces
    return split_ranges(text_ranges(whole, "doc", "text", max(size, 4 * limit), HALO * limit), limit, overlap)
