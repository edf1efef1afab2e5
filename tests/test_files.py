import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.models import files as M
from quern.models.encoders import Bert, BertConfig, Gemma, GemmaConfig
from quern.operators import encode as E
from quern.sources import archives as A
from quern.sources.tensors import write_safetensors

WORDS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "river", "stone", "##s", "blue", ",", "the"]


def theirs(weights, table, layer):
    back = {v: k for k, v in table.items()}
    out = {}
    for n, x in weights.items():
        head, _, rest = n.partition(".")
        inner, place = (rest, f"{layer}.{head}.") if head.isdigit() else (n, "")
        bias = inner.endswith(".bias") and inner not in back
        stem = back[inner[:-5] if bias else inner]
        out[place + (stem if stem.endswith(("weight", "bias")) else stem + (".bias" if bias else ".weight"))] = np.float32(x)
    return out


def bert_folder(path):
    c = BertConfig(len(WORDS), 12, 2, 3, 16, 20)
    model = Bert.random(c, 3, 0.4)
    (path / "vocab.txt").write_text("\n".join(WORDS) + "\n")
    (path / "config.json").write_text(json.dumps({"model_type": "bert", "vocab_size": c.vocab, "hidden_size": 12, "num_hidden_layers": 2, "num_attention_heads": 3, "intermediate_size": 16, "max_position_embeddings": 20}))
    return model, theirs(model.weights, M.BERT, "encoder.layer")


def test_a_folder_of_safetensors(spark, tmp_path):
    model, named = bert_folder(tmp_path)
    (tmp_path / "model.safetensors").write_bytes(write_safetensors({f"bert.{n}": ("F32", x) for n, x in named.items()} | {"pooler.dense.weight": ("F32", np.zeros((12, 12)))}))
    df = spark.createDataFrame([(1, "The blue river"), (2, "stones, stone"), (3, None), (4, "river " * 60)], "k int, text string")
    got = {r["k"]: np.array(r["v"]) for r in df.select("k", E.encoder("folder", folder=str(tmp_path)).encode(F.col("text")).alias("v")).collect()}
    want = Bert(model.config, {n: np.float32(x) for n, x in model.weights.items()})
    for k, ids in {1: [2, 9, 7, 4, 3], 2: [2, 5, 6, 8, 5, 3], 3: [2, 3], 4: [2] + [4] * 19}.items():
        assert np.allclose(got[k], want.embed(ids), atol=1e-6), k
    named.pop("embeddings.word_embeddings.weight")
    (tmp_path / "model.safetensors").write_bytes(write_safetensors({n: ("F32", x) for n, x in named.items()}))
    with pytest.raises(ValueError, match="words"):
        M.load_model(str(tmp_path))


def test_an_archive_whose_factors_have_no_names(spark, tmp_path):
    model, named = bert_folder(tmp_path)
    tensors, nodes = {}, []
    for i, (n, x) in enumerate(sorted(named.items())):
        if n.startswith("encoder.") and x.ndim == 2:
            tensors[f"onnx::MatMul_{i}"] = x.T
            nodes += [{"node": f"m{i}", "op": "MatMul", "inputs": [f"x{i}", f"onnx::MatMul_{i}"], "outputs": [f"y{i}"]}, {"node": f"a{i}", "op": "Add", "inputs": [n[:-6] + "bias", f"y{i}"], "outputs": [f"z{i}"]}]
        else:
            tensors[n] = x
    data = A.write_archive(tensors, nodes)
    (tmp_path / "model.onnx").write_bytes(data)
    read, graph = A.read_archive(data)
    assert graph == nodes and all((read[n] == x).all() for n, x in tensors.items())
    loaded = M.load_model(str(tmp_path), spark)
    assert all(np.array_equal(loaded.weights[n], np.float32(x)) for n, x in model.weights.items())
    v = spark.createDataFrame([("the river",)], "text string").select(M.folder_encoder(str(tmp_path), spark=spark).encode(F.col("text")).alias("v")).first()["v"]
    assert np.allclose(v, loaded.embed([2, 9, 4, 3]))
    with pytest.raises(ValueError):
        A.read_archive(data[:-3])


@pytest.mark.parametrize("pooling", ["mean", "first"])
def test_inference_of_the_bidirectional_model(pooling):
    model = Bert.random(BertConfig(30, 64, 2, 4, 96, 20, pooling), 3, 0.2)
    for ids in ([2, 9, 7, 4, 3], [5], list(range(25))):
        want = model.embed(ids)
        assert np.allclose(model.inference(ids), want, atol=2e-5)
        assert model.inference(ids, "int8") @ want > 0.99 and model.inference(ids, "int4") @ want > 0.9
    assert not model.inference([]).any()


def test_a_causal_folder_in_three_precisions(tmp_path):
    c = GemmaConfig(len(WORDS), 32, 2, 2, 1, 16, 64, 40)
    model = Gemma.random(c, 5, 0.3)
    (tmp_path / "vocab.txt").write_text("\n".join(WORDS) + "\n")
    (tmp_path / "config.json").write_text(json.dumps({"model_type": "gemma3_text", "vocab_size": c.vocab, "hidden_size": 32, "num_hidden_layers": 2, "num_attention_heads": 2, "num_key_value_heads": 1, "head_dim": 16, "intermediate_size": 64, "max_position_embeddings": 40}))
    (tmp_path / "model.safetensors").write_bytes(write_safetensors({"model." + n: ("F32", x) for n, x in theirs(model.weights, M.GEMMA, "layers").items()}))
    ids = [2, 9, 7, 4, 3]
    want = Gemma(c, {n: np.float32(x) for n, x in model.weights.items()}).embed(ids)
    for precision, least in (("fp32", 0.99999), ("int8", 0.99), ("int4", 0.9)):
        run = M.folder_encoder(str(tmp_path), precision).load()
        assert run(["the blue river"])[0] @ want > least, precision


def test_ids_back_to_text(spark, tmp_path):
    import tokenizers

    from quern.operators import tokenize as K

    tok = tokenizers.Tokenizer(tokenizers.models.WordPiece({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]"))
    tok.pre_tokenizer, tok.decoder = tokenizers.pre_tokenizers.BertPreTokenizer(), tokenizers.decoders.WordPiece()
    tok.add_special_tokens(["[CLS]", "[SEP]"])
    tok.save(str(tmp_path / "tokenizer.json"))
    df = spark.createDataFrame([(1, [2, 9, 7, 5, 6, 3]), (2, []), (3, None)], "k int, ids array<bigint>")
    got = {r["k"]: r["t"] for r in df.select("k", K.file_untokenizer(str(tmp_path / "tokenizer.json"))(F.col("ids")).alias("t")).collect()}
    assert got == {1: "the blue stones", 2: "", 3: ""}
