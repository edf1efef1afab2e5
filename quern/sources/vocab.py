"""Vocabulary, tokenizer and transliteration files, read on the driver and handed to workers once."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field


def read_vocabulary(lines) -> list[str]:
    """Non-blank lines; an entry's id is its place among them. lines is a path or an iterable."""
    if isinstance(lines, str):
        with open(lines, encoding="utf-8") as f:
            return read_vocabulary(list(f))
    return [x for x in (line.rstrip("\r\n") for line in lines) if x.strip()]


def index(vocabulary: list[str]) -> dict[str, int]:
    """token -> id; of repeated entries the later one wins."""
    return {t: i for i, t in enumerate(vocabulary)}


def rule_vocabulary(words: tuple[str, ...] = ()) -> list[str]:
    """A vocabulary made by rule where no file is at hand: special tokens, single characters and pairs, alone and as continuations,
    and the given words."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    pairs = [a + b for a in letters[:26] for b in letters[:26]]
    return ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *marks, *letters, *pairs, *("##" + x for x in letters), *("##" + x for x in pairs), *words]


@dataclass
class BpeFile:
    """A byte-fallback BPE tokenizer: vocabulary, merge ranks by id pair, added tokens and special ids."""

    vocab: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    added: dict[str, int] = field(default_factory=dict)
    bos: int | None = None
    eos: int | None = None
    pad: int = 0

    @property
    def tokens(self) -> dict[int, str]:
        return {i: t for t, i in {**self.vocab, **self.added}.items()}


def make_bpe(vocab: dict[str, int], merges: list, added: dict[str, int] | None = None, bos: str | None = "<bos>", eos: str | None = "<eos>", pad: str = "<pad>") -> BpeFile:
    """Merges whose parts or result are no vocabulary entries are ignored; a merge's rank is its place in the list."""
    table: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, m in enumerate(merges):
        a, b = m.split(" ", 1) if isinstance(m, str) else m
        if a in vocab and b in vocab and a + b in vocab:
            table.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    every = {**vocab, **(added or {})}
    return BpeFile(vocab, table, added or {}, every.get(bos), every.get(eos), every.get(pad, 0))


def read_bpe_json(path: str) -> BpeFile:
    """A tokenizer.json with a BPE model; parsed on the driver, never as a table."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    added = {t["content"]: t["id"] for t in j.get("added_tokens") or []}
    return make_bpe(j["model"]["vocab"], j["model"].get("merges") or [], added)


def transliteration_table(first: int = 0x80, last: int = 0x24F) -> dict[int, str]:
    """Code point -> ASCII by compatibility decomposition, for characters that have one."""
    out = {}
    for c in range(first, last + 1):
        plain = unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()
        if plain:
            out[c] = plain
    return out


def read_transliteration(lines) -> dict[int, str]:
    """Rows NNN<TAB>'..' x 256: replacements of the 256 characters with high byte NNN (hexadecimal); a malformed row raises."""
    import ast

    if isinstance(lines, str):
        with open(lines, encoding="utf-8") as f:
            return read_transliteration(list(f))
    out: dict[int, str] = {}
    for line in lines:
        if not line.strip():
            continue
        high, tab, rest = line.rstrip("\r\n").partition("\t")
        values = ast.literal_eval(f"[{rest.replace('%s' % chr(9), ',')}]") if tab else []
        if len(values) != 256:
            raise ValueError(f"row {high!r} holds {len(values)} replacements instead of 256")
        out |= {int(high, 16) * 256 + i: v for i, v in enumerate(values)}
    return out
