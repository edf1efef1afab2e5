import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.models.encoders import Bert, BertConfig
from quern.models.lora import new_adapter
from quern.operators.encode import HashEncoder
from quern.operators.parse_rows import reject_rows, strict_load
from quern.sources import datasets as D
from quern.sources import tensors as X

PLACE = ["line_id", "file_name", "line_no"]
RAW = [
    ("a,b,1.5", None), ('"a ""x"" y",b,5', None), ('"a,b","c\nd",0.0\r', None), ("a,b,05.00", None), ('"",b,1', "bad_value"), (" \t,b,1", "bad_value"), ("a,b,5.1", "bad_value"), ("a,b,1.", "bad_value"),
    ("a,b,-1", "bad_value"), ("a,b,", "bad_value"), ("a,b,1\n", "bad_value"), ("a�,b,1", "bad_value"), ("a\x01,b,1", "bad_value"), ("a,b,\x01", "bad_value"), ("a,b", "column_count"), ("a,b,c,1", "column_count"),
    ("", "column_count"), (None, "column_count"), ('a"x,b,1', "quoting"), ('"a,b,1', "quoting"), ('"a"x,b,1', "quoting"), (' "a",b,1', "quoting"), ('"a\\"",b,1', "quoting"), ('a,b,"1.200"', None), ('"a","b","3"\r', None), ('"a"""",b,1', "quoting"), ('""""', "column_count"), ('"x" ,b,1', "quoting"),
    ("x" * 200_000 + ',"' + 'q""' * 20_000 + '",2', None),
]


def test_rows_that_fail_to_parse(spark):
    rows = [(i, "f", i, r) for i, (r, _) in enumerate(RAW)]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, raw_line string").withColumn("reason", F.lit("mine")).withColumn("score", F.lit("s"))
    got = {r["line_id"]: r["reason"] for r in reject_rows(df.drop("reason"), PLACE).collect()}
    assert got == {i: w for i, (_, w) in enumerate(RAW) if w}
    load = {r["line_id"]: r for r in strict_load(df).collect()}
    assert set(load) == {i for i, (_, w) in enumerate(RAW) if not w}
    assert load[1]["sentence1"] == 'a "x" y' and load[2]["sentence2"] == "c\nd" and load[3]["score"] == 5.0
    assert reject_rows(df.limit(0), PLACE).count() == 0


def test_repeated_and_keyless_rows(spark):
    df = spark.createDataFrame([(1, None, 1, "a,b,1"), (1, None, 1, "a,b"), (1, None, 1, "a,b"), (None, None, None, "x")], "line_id bigint, file_name string, line_no int, raw_line string")
    assert sorted((r["line_id"] or 0, r["reason"]) for r in reject_rows(df, PLACE).collect()) == [(0, "column_count"), (1, "column_count"), (1, "column_count")]


def test_pair_files(spark, tmp_path):
    p = tmp_path / "stsb-en-train.csv"
    p.write_text('"a ""q"", b",c,2.5\nx,y,no\nz,w,9\nonly,two\n')
    rows = D.load_dataset(spark, "stsb", str(tmp_path), "train").collect()
    assert [(r["anchor"], round(r["score"], 3)) for r in rows] == [('a "q", b', 0.5), ("z", 1.0)]
    (tmp_path / "patents-test.csv").write_text("anchor,target,rating,score,context\na,b,x,0.75,c\na,b,x,0.5\n")
    assert [r["score"] for r in D.load_dataset(spark, "patents", str(tmp_path), "whatever").collect()] == [0.75]
    (tmp_path / "stsb-en-dev.csv").write_text("")
    with pytest.raises(ValueError):
        D.load_dataset(spark, "stsb", str(tmp_path), "validation")
    with pytest.raises(KeyError):
        D.load_dataset(spark, "none", str(tmp_path), "train")


def test_golden_file(spark, tmp_path):
    D.write_golden(str(tmp_path / "g.json"), "m", ["x", "ü"], [[1.0, 2.0], [3.0, 4.0]])
    rows = D.read_golden(spark, str(tmp_path / "g.json")).orderBy("position").collect()
    assert [(r["sentence"], list(r["embedding"])) for r in rows] == [("x", [1.0, 2.0]), ("ü", [3.0, 4.0])]


def test_safetensors():
    x = np.array([1.5, -2, 3, 1e-3], np.float32)
    blob = X.write_safetensors({"a": ("F32", x), "b": ("BF16", x[:3]), "c": ("F16", x.reshape(2, 2))})
    s = X.SafeTensors(blob)
    assert s.names() == ["a", "b", "c"] and np.array_equal(s.read("a"), x) and np.array_equal(s.read("b"), x[:3]) and s.read("c").shape == (2, 2)
    assert s.raw16("b").dtype == np.uint16
    for bad in (b"x", blob[:20], blob[:-1]):
        with pytest.raises(ValueError):
            X.SafeTensors(bad)
    assert struct.unpack("<Q", blob[:8])[0] == len(json.dumps(json.loads(blob[8 : 8 + struct.unpack("<Q", blob[:8])[0]])))
    assert np.array_equal(X.bf16_to_f32(X.f32_to_bf16(np.array([1.00390625, 1.01171875], np.float32))), np.array([1.0, 1.015625], np.float32))


def test_adapter_round_trip(spark, tmp_path):
    a = new_adapter(Bert.random(BertConfig(10, 12, 2, 3, 16, 8)), 6, 12, "all", True)
    a.whitening, a.mean = np.eye(12), np.zeros(12)
    X.save_adapter(spark, a, str(tmp_path / "ad"))
    b = X.load_adapter(spark, str(tmp_path / "ad"))
    assert b.rank == 6 and b.alpha == 12 and set(b.weights) == set(a.weights) and np.array_equal(b.whitening, np.eye(12))
    assert all(np.allclose(a.weights[k][0], b.weights[k][0]) and a.weights[k][1].shape == b.weights[k][1].shape for k in a.weights)
    n = X.parameter_count(spark.read.schema(X.ADAPTER).parquet(str(tmp_path / "ad"))).first()[0]
    assert n == a.parameters()


def test_calibrated_text():
    assert len(D.calibrated_text(lambda t: len(t.split()), 17, ["ab", "c"]).split()) == 17


def test_stream_into_store(spark, tmp_path):
    from quern.streaming import ingest as I

    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    docs = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(src)
    docs([(1, "a b"), (2, "c"), (3, "a b")])
    e = HashEncoder(8)
    for _ in range(2):
        I.encode_into_store(I.read_documents(spark, src), "text", e, store, str(tmp_path / "cp")).awaitTermination()
        docs([(4, "c"), (5, "new one")])
    keys = [r[0] for r in spark.read.parquet(store).select("text_key").collect()]
    assert len(keys) == len(set(keys)) == 3
    q = I.chunk_stream(I.read_documents(spark, src), "doc_id", "text", e).writeStream.format("memory").queryName("chunks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("chunks").count() == 7


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from quern import cli

    (tmp_path / "stsb-en-train.csv").write_text("".join(f"a man plays {i},a person plays {i},{5 if i % 2 else 1}\n" for i in range(12)))
    (tmp_path / "stsb-en-test.csv").write_text("a b,a c,3\nd e,d f,1\ng,h,4\n")
    out = str(tmp_path / "ad")
    assert cli.main(["train", "--data", str(tmp_path), "--out", out, "--epochs", "1", "--rank", "2", "--loss", "cosent", "--targets", "all"]) == 0
    assert cli.main(["eval", "--data", str(tmp_path), "--adapter", out]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert set(json.loads(lines[-1])) == {"base", "tuned"}
