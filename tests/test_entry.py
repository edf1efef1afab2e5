import pathlib
import re
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
SMALL = pathlib.Path("/root/testdata/sf0.001")


def test_catalogue_is_consistent():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())


def test_the_library_does_not_need_the_pipeline_subpackage():
    for p in (ROOT / "quern").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"quern\.llm|from quern import llm", p.read_text()), p


def test_no_lineage_is_cut_locally():
    for p in (ROOT / "quern").rglob("*.py"):
        assert "localCheckpoint(" not in p.read_text() and ".crossJoin(" not in p.read_text(), p


@pytest.mark.skipif(not SMALL.exists(), reason="no tables here")
def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", "chunk_id", "vector"] and df.count() > 0
