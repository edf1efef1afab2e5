"""Encoders from a model folder: config.json, weights (model.safetensors or model.onnx) and a tokenizer file."""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark.sql import SparkSession

from quern.models.encoders import Bert, BertConfig, Gemma, GemmaConfig
from quern.operators.encode import ModelEncoder, register
from quern.sources.archives import named_weights
from quern.sources.tensors import SafeTensors

#: The published names of the weights, and ours.
BERT = {
    "embeddings.word_embeddings.weight": "words", "embeddings.position_embeddings.weight": "places", "embeddings.token_type_embeddings.weight": "types",
    "embeddings.LayerNorm.weight": "start.gain", "embeddings.LayerNorm.bias": "start.shift",
    "attention.self.query": "q", "attention.self.key": "k", "attention.self.value": "v", "attention.output.dense": "o", "intermediate.dense": "up", "output.dense": "down",
    "attention.output.LayerNorm.weight": "n1.gain", "attention.output.LayerNorm.bias": "n1.shift", "output.LayerNorm.weight": "n2.gain", "output.LayerNorm.bias": "n2.shift",
}
GEMMA = {
    "embed_tokens.weight": "words", "norm.weight": "end.scale",
    "self_attn.q_proj": "q", "self_attn.k_proj": "k", "self_attn.v_proj": "v", "self_attn.o_proj": "o", "mlp.gate_proj": "gate", "mlp.up_proj": "up", "mlp.down_proj": "down",
    "self_attn.q_norm.weight": "q_norm", "self_attn.k_norm.weight": "k_norm", "input_layernorm.weight": "before_attention", "post_attention_layernorm.weight": "after_attention",
    "pre_feedforward_layernorm.weight": "before_mlp", "post_feedforward_layernorm.weight": "after_mlp",
}
_LAYER = re.compile(r"(?:.*\.)?layers?\.(\d+)\.(.+)")


def our_names(tensors: dict[str, np.ndarray], table: dict[str, str]) -> dict[str, np.ndarray]:
    """Weights under our names; tensors that the encoder does not use are left out."""
    out = {}
    for name, x in tensors.items():
        m = _LAYER.fullmatch(name)
        inner = m[2] if m else re.sub(r"^(?:bert|model|language_model)\.", "", name)
        stem, end = inner.rsplit(".", 1) if "." in inner else (inner, "")
        ours = table.get(inner) or (table[stem] + (".bias" if end == "bias" else "") if stem in table and end in ("weight", "bias") else None)
        if ours:
            out[f"{m[1]}.{ours}" if m else ours] = np.asarray(x, np.float32)
    return out


def load_model(folder: str, spark: SparkSession | None = None, pooling: str = "mean"):
    """The encoder of a folder; an archive of the exchange format needs a session for its trace. Missing weights raise ValueError."""
    with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
        c = json.load(f)
    path = os.path.join(folder, "model.safetensors")
    if os.path.exists(path):
        source = SafeTensors(path)
        tensors = {n: source.read(n) for n in source.names()}
    else:
        tensors = named_weights(spark, os.path.join(folder, "model.onnx"))
    if str(c.get("model_type", "bert")).startswith("gemma"):
        config = GemmaConfig(c["vocab_size"], c["hidden_size"], c["num_hidden_layers"], c["num_attention_heads"], c["num_key_value_heads"], c["head_dim"], c["intermediate_size"], c["max_position_embeddings"], float(c.get("rope_theta", 1e6)))
        make, weights = Gemma, our_names(tensors, GEMMA)
    else:
        config = BertConfig(c["vocab_size"], c["hidden_size"], c["num_hidden_layers"], c["num_attention_heads"], c["intermediate_size"], c["max_position_embeddings"], pooling)
        make, weights = Bert, our_names(tensors, BERT)
    small = dict.fromkeys(("vocab", "positions"), 1)
    need = make.random(type(config)(**{**config.__dict__, **small})).weights
    lacks = sorted(set(need) - set(weights))
    if lacks:
        raise ValueError(f"{folder} lacks {lacks[:5]}")
    return make(config, {n: weights[n] for n in need})


def load_tokenizer(folder: str):
    """text -> ids: the folder's tokenizer.json, or lower-case word pieces of its vocab.txt between the two marks."""
    import tokenizers

    path = os.path.join(folder, "tokenizer.json")
    if os.path.exists(path):
        tok = tokenizers.Tokenizer.from_file(path)
    else:
        with open(os.path.join(folder, "vocab.txt"), encoding="utf-8") as f:
            vocab = {w.rstrip("\n"): i for i, w in enumerate(f)}
        tok = tokenizers.Tokenizer(tokenizers.models.WordPiece(vocab, unk_token="[UNK]"))
        tok.normalizer, tok.pre_tokenizer = tokenizers.normalizers.BertNormalizer(), tokenizers.pre_tokenizers.BertPreTokenizer()
        tok.post_processor = tokenizers.processors.BertProcessing(("[SEP]", vocab["[SEP]"]), ("[CLS]", vocab["[CLS]"]))
    return lambda text: tok.encode(text).ids


def folder_encoder(folder: str, precision: str = "fp32", pooling: str = "mean", spark: SparkSession | None = None, batch: int = 64) -> ModelEncoder:
    """An encoder column over a model folder that all workers can read. Safetensors are mapped once a worker; archives of the exchange
    format are read here and sent along. precision is fp32, int8 or int4; inference runs without a tape."""
    sent = None if os.path.exists(os.path.join(folder, "model.safetensors")) else load_model(folder, spark, pooling)
    with open(os.path.join(folder, "config.json"), encoding="utf-8") as f:
        dim = json.load(f)["hidden_size"]

    def load():
        model, ids = sent or load_model(folder, None, pooling), load_tokenizer(folder)
        most = model.config.positions
        return lambda texts: np.stack([model.inference(x, precision) if (x := ids(t)[:most]) else np.zeros(dim) for t in texts])

    return ModelEncoder(load, dim, batch)


register("folder", folder_encoder)
