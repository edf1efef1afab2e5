"""python -m quern.cli train | eval | embed: adapter training on pair files, evaluation, and embedding of a Parquet table."""

from __future__ import annotations

import argparse
import json
import sys

from quern.models.training import Options, Pair, Trainer

MODELS = ("bert-tiny", "gemma-tiny")


def make_model(name: str, seed: int = 1):
    """Seeded small models; real weights come through sources.tensors.SafeTensors."""
    from quern.models.encoders import Bert, BertConfig, Gemma, GemmaConfig

    if name == "bert-tiny":
        return Bert.random(BertConfig(vocab=4_096, hidden=48, layers=2, heads=4, inner=96, positions=256), seed, 0.2)
    if name == "gemma-tiny":
        return Gemma.random(GemmaConfig(vocab=4_096, hidden=48, layers=2, heads=4, kv_heads=1, head=16, inner=96, positions=256), seed, 0.2)
    raise KeyError(f"no model {name!r}; known: {MODELS}")


def tokenise(text: str) -> list[int]:
    import hashlib
    import re

    return [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 4_096 for w in re.findall(r"\w+|[^\w\s]", (text or "").lower())]


def load(spark, dataset: str, data: str, split: str, most: int | None) -> list[Pair]:
    from quern.sources.datasets import load_dataset

    rows = load_dataset(spark, dataset, data, split)
    rows = rows.limit(most) if most else rows
    return [Pair(r["anchor"] or "", r["positive"] or "", r["score"], r["negative"]) for r in rows.toLocalIterator()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("train", "eval"):
        s = sub.add_parser(verb)
        s.add_argument("--dataset", default="stsb")
        s.add_argument("--data", required=True)
        s.add_argument("--split", default="train" if verb == "train" else "test")
        s.add_argument("--model", default="bert-tiny")
        s.add_argument("--adapter")
        s.add_argument("--max-rows", type=int)
    t = sub.choices["train"]
    t.add_argument("--out", required=True)
    for name, kind in (("rank", int), ("alpha", float), ("epochs", int), ("batch", int), ("rate", float), ("decay", float), ("warm-up", float), ("temperature", float), ("max-tokens", int), ("validation", float), ("threshold", float), ("metric-threshold", float), ("negatives", int), ("max-negative-cosine", float), ("patience", int)):
        t.add_argument(f"--{name}", type=kind)
    t.add_argument("--targets", choices=("attention", "all"))
    t.add_argument("--loss", choices=("contrastive", "cosent", "regression"))
    t.add_argument("--seeds", type=lambda x: tuple(map(int, x.split(","))))
    t.add_argument("--dims", type=lambda x: tuple(map(int, x.split(","))))
    t.add_argument("--query-prefix")
    t.add_argument("--document-prefix")
    for flag in ("output-bias", "whiten", "learn-temperature"):
        t.add_argument(f"--{flag}", action="store_true", default=None)
    e = sub.add_parser("embed")
    e.add_argument("--table", required=True)
    e.add_argument("--key", default="doc_id")
    e.add_argument("--text", default="text")
    e.add_argument("--out", required=True)
    e.add_argument("--encoder", default="hash")
    return p


def options(args: argparse.Namespace) -> Options:
    names = Options.__dataclass_fields__
    return Options(**{k: v for k, v in vars(args).items() if k in names and v is not None})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from quern.session import reachable
    from quern.sources.tensors import load_adapter, save_adapter

    spark = SparkSession.builder.appName("quern").getOrCreate()
    reachable(spark)
    if args.verb == "embed":
        from quern.operators.encode import encode_distinct, encoder

        encode_distinct(spark.read.parquet(args.table).select(args.key, args.text), args.text, encoder(args.encoder)).write.mode("overwrite").parquet(args.out)
        return 0
    pairs = load(spark, args.dataset, args.data, args.split, args.max_rows)
    trainer = Trainer(make_model(args.model), tokenise, options(args) if args.verb == "train" else Options())
    if args.verb == "eval":
        report = {"base": trainer.metrics(pairs, None)}
        if args.adapter:
            report["tuned"] = trainer.metrics(pairs, load_adapter(spark, args.adapter))
        print(json.dumps(report))
        return 0
    report = trainer.train(pairs)
    save_adapter(spark, report.adapter, args.out)
    print(json.dumps({"baseline": report.baseline, "best": report.best, "epochs": report.epochs}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
