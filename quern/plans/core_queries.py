"""The general data operators' queries."""

from __future__ import annotations

from quern.operators.parse_rows import reject_rows, strict_load
from quern.session import table

PLACE = ["line_id", "file_name", "line_no"]


def p5_found(spark, sf):
    return reject_rows(table(spark, sf, "stsb_train_raw"), PLACE).select("line_id", "reason")


def p5_loaded(spark, sf):
    return strict_load(table(spark, sf, "stsb_train_raw")).select("line_id", "sentence1", "sentence2", "score")


_RAW = r"""raw AS (SELECT line_id, regexp_replace(coalesce(raw_line, ''), '\r\z', '') AS r FROM stsb_train_raw),
marked AS (SELECT line_id, r,
  regexp_matches(r, '^(?:"(?:[^"]|"")*"|[^",][^",]*|)(?:,(?:"(?:[^"]|"")*"|[^",][^",]*|))*\z') AS quoted,
  regexp_matches(r, '^(?:"(?:[^"]|"")*"|[^",][^",]*|)(?:,(?:"(?:[^"]|"")*"|[^",][^",]*|)){2}\z') AS three,
  regexp_extract(r, '^("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*)\z', ['a', 'b', 'c']) AS f FROM raw),
plain AS (SELECT line_id, quoted, three,
  CASE WHEN f.a LIKE '"%' THEN replace(f.a[2:-2], '""', '"') ELSE f.a END AS a,
  CASE WHEN f.b LIKE '"%' THEN replace(f.b[2:-2], '""', '"') ELSE f.b END AS b,
  trim(CASE WHEN f.c LIKE '"%' THEN replace(f.c[2:-2], '""', '"') ELSE f.c END, E' \t') AS c FROM marked),
judged AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT three THEN 'column_count'
  WHEN trim(a, E' \t') = '' OR trim(b, E' \t') = '' OR regexp_matches(a, '[\x00-\x08\x0B-\x1F\x{FFFD}]') OR regexp_matches(b, '[\x00-\x08\x0B-\x1F\x{FFFD}]')
    OR NOT regexp_matches(c, '^[0-9]+(\.[0-9]+)?\z') OR try_cast(c AS DECIMAL(38, 20)) > 5 OR try_cast(c AS DOUBLE) > 5 THEN 'bad_value' END AS reason FROM plain)"""

SQL = {
    "p5_found": f"WITH {_RAW} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_loaded": f"WITH {_RAW} SELECT line_id, a AS sentence1, b AS sentence2, c::DOUBLE AS score FROM judged WHERE reason IS NULL",
}
QUERIES = {"p5_found": p5_found, "p5_loaded": p5_loaded}
