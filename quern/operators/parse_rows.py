"""Delimited records: strict load of the conforming ones, anti-join for the rest, and a diagnosis of that remainder.

All steps are built-in expressions over one split of the record at its quotes, so no regular expression can run deep on a long
record: the even parts of the split lie outside quotes, the odd ones inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vector import let

#: Stands between fields while they are taken apart; a record that holds it itself is a bad value anyway.
_SEP = "\x01"
_CONTROL = "[\\x00-\\x08\\x0B-\\x1F\\uFFFD]"
_SCORE = "^0*([0-4](\\.[0-9]+)?|5(\\.0+)?)$|^0+(\\.[0-9]+)?$"


def _parts(record: Column) -> Column:
    return F.split(record, '"', -1)


def well_quoted(parts: Column) -> Column:
    """Quotes come in pairs, open at the start of a field and close at its end; a doubled quote leaves an empty even part."""

    def judge(ps: Column, n: Column) -> Column:
        def ok(p: Column, i: Column) -> Column:
            first, last = i == 0, i == n - 1
            opens = last | (p == "") | p.endswith(",")
            closes = first | (p == "") | p.startswith(",")
            return (i % 2 == 1) | (opens & closes)

        return (n % 2 == 1) & F.forall(F.transform(ps, ok), lambda x: x)

    return let(parts, lambda ps: let(F.size(ps), lambda n: judge(ps, n)))


def fields(parts: Column) -> Column:
    """The fields of a well-quoted record, quotes taken off and doubled quotes made one."""

    def marked(ps: Column, n: Column) -> Column:
        return F.transform(ps, lambda p, i: F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < n - 1), F.lit('"')).otherwise(F.translate(p, ",", _SEP)))

    return F.split(F.array_join(let(parts, lambda ps: let(F.size(ps), lambda n: marked(ps, n))), ""), _SEP, -1)


def field_count(parts: Column) -> Column:
    """One more than the commas outside quotes."""
    return F.aggregate(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.length(p) - F.length(F.translate(p, ",", ""))).otherwise(0)), F.lit(1), lambda a, x: a + x)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, "^[ \\t]+|[ \\t]+$", "")


def good_sentence(c: Column) -> Column:
    return (_trim(c) != "") & ~c.rlike(_CONTROL)


def good_score(c: Column) -> Column:
    # $ would also match before a final line feed
    return _trim(c).rlike(_SCORE) & ~_trim(c).contains("\n")


def _record(df: DataFrame, raw: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), "\\r\\z", "")


def strict_load(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """Every row of df whose record conforms, with sentence1, sentence2 and score added (extra columns of those names are replaced)."""
    out = df.withColumn("__parts", _parts(_record(df, raw)))
    out = out.where(well_quoted(F.col("__parts")) & (field_count(F.col("__parts")) == 3)).withColumn("__f", fields(F.col("__parts"))).where(F.size("__f") == 3)
    f = [F.get("__f", F.lit(i)) for i in range(3)]
    out = out.where(good_sentence(f[0]) & good_sentence(f[1]) & good_score(f[2]))
    return out.withColumns({"sentence1": f[0], "sentence2": f[1], "score": F.expr("try_cast(regexp_replace(get(__f, 2), '[ \\t]', '') as double)")}).drop("__parts", "__f")


def diagnose(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """Adds the first reason that applies: quoting, column_count or bad_value."""
    out = df.withColumn("__parts", _parts(_record(df, raw)))
    out = out.withColumn("__n", F.when(well_quoted(F.col("__parts")), field_count(F.col("__parts"))))
    reason = F.when(F.col("__n").isNull(), "quoting").when(F.col("__n") != 3, "column_count").otherwise("bad_value")
    return out.withColumn("reason", reason).drop("__parts", "__n")


def reject_rows(df: DataFrame, key: list[str], raw: str = "raw_line") -> DataFrame:
    """The rows of df that the strict load does not take, with the reason.

    key: the columns that hold the record's place (file, line, id); the raw record's hash joins them, so that repeated keys with
    different records are told apart. A null or empty record is one blank field (column_count); null keys count as equal. Exact
    repeats are judged alike and all come out. A record may be of any length. An empty table gives an empty result.
    """
    place = [F.col(k) for k in key]
    mark = F.xxhash64(F.coalesce(F.col(raw), F.lit("")))
    loaded = strict_load(df, raw).select(*[c.alias(f"__k{i}") for i, c in enumerate(place)], mark.alias("__h")).distinct()
    marked = df.withColumn("__mark", mark)
    cond = F.col("__mark") == F.col("__h")
    for i, c in enumerate(place):
        cond = cond & c.eqNullSafe(F.col(f"__k{i}"))
    return diagnose(marked.join(loaded, cond, "left_anti").drop("__mark"), raw)
