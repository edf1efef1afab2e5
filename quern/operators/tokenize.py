"""Sub-word tokenizers. Splitting a word is a greedy loop, so it runs over Arrow batches with a memory of words already split; all that
surrounds it (normalising, windows, padding, segment numbers, truncation) is plain Column work."""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.vector import let
from quern.session import durable
from quern.sources.vocab import BpeFile

UNK, CLS, SEP, MASK, PAD = "[UNK]", "[CLS]", "[SEP]", "[MASK]", ""
#: Words that a worker remembers.
MEMORY = 500_000
#: The same for aligned BPE, whose words are at most LONGEST characters; characters of text whose aligned tokens it holds at once.
BPE_MEMORY, LONGEST, PIECE = 100_000, 32, 1 << 18


def word_pieces(word: str, vocab: dict[str, int], longest: int = T.MAX_WORD) -> list[str]:
    """Sub-words of one word: the whole word if known, else the longest known prefix again and again, continuations written ##rest.

    A word beyond `longest` has none; the loop ends at two characters; where nothing fits, [UNK] follows what was found."""
    if len(word) > longest or not word:
        return []
    if word in vocab:
        return [word]
    out: list[str] = []
    rest = word
    while len(rest) > 2:
        least = 2 if rest.startswith("##") else 1
        for end in range(len(rest), least, -1) if least == 2 else range(len(rest), 0, -1):
            if rest[:end] in vocab:
                break
        else:
            out.append(UNK)
            break
        out.append(rest[:end])
        after = "##" + rest[end:]
        if after == rest:
            out.append(UNK)
            break
        rest = after
    if not out and word.strip():
        out.append(UNK)
    return out


def _worker(split: Callable[[str], list]) -> Callable[[list], list]:
    seen: dict[str, list] = {}

    def run(words: list) -> list:
        out: list = []
        for w in words:
            p = seen.get(w)
            if p is None:
                if len(seen) >= MEMORY:
                    seen.clear()
                p = seen[w] = split(w)
            out += p
        return out

    return run


class WordPiece:
    """Uncased (or cased) WordPiece tokenizer over a token -> id vocabulary."""

    def __init__(self, vocab: dict[str, int], lower: bool = True, max_tokens: int = 256, max_word: int = T.MAX_WORD, whitespace: str = "reference"):
        self.vocab, self.lower, self.max_tokens, self.max_word, self.whitespace = vocab, lower, max_tokens, max_word, whitespace

    def words(self, text: Column) -> Column:
        return T.basic_tokens(text, self.lower, self.whitespace)

    def tokens(self, text: Column) -> Column:
        """array<string> of sub-words."""
        vocab, longest = self.vocab, self.max_word

        @F.pandas_udf("array<string>")
        def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = _worker(lambda w: word_pieces(w, vocab, longest))
            for words in batches:
                yield pd.Series([run(list(w)) for w in words])

        return pieces(self.words(text))

    def raw(self, text: Column) -> Column:
        """array<struct<token, original>>: sub-words with the word they come from."""
        vocab, longest = self.vocab, self.max_word

        @F.pandas_udf("array<struct<token:string,original:string>>")
        def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = _worker(lambda w: [{"token": p, "original": w} for p in word_pieces(w, vocab, longest)])
            for words in batches:
                yield pd.Series([run(list(w)) for w in words])

        return pieces(self.words(text))

    def framed(self, tokens: Column, most: int | None = None) -> Column:
        """[CLS] tokens [SEP], cut to most: a long input loses its [SEP]."""
        return F.slice(F.concat(F.array(F.lit(CLS)), tokens, F.array(F.lit(SEP))), 1, most or self.max_tokens)

    def ids(self, tokens: Column) -> Column:
        vocab = self.vocab

        @F.pandas_udf("array<bigint>")
        def look(series: pd.Series) -> pd.Series:
            unk = vocab.get(UNK, 0)
            return pd.Series([[vocab.get(t, unk) for t in ts] for ts in series])

        return look(tokens)

    def encode(self, df: DataFrame, key: str, text: str, batch: str | None = None) -> DataFrame:
        """(key, input_ids, token_type_ids, attention_mask), right-padded with 0 to the longest of the batch (of all rows without)."""
        ids = durable(df.select(key, *([batch] if batch else []), self.framed(self.tokens(F.col(text))).alias("tokens")).withColumn("ids", self.ids(F.col("tokens"))))  # read for the widths and for the rows
        widths = ids.groupBy(batch).agg(F.max(F.size("ids")).alias("width")) if batch else ids.agg(F.max(F.size("ids")).alias("width"))
        joined = ids.join(widths, batch) if batch else ids.join(F.broadcast(widths))  # one row
        pad = lambda c: F.concat(c, F.array_repeat(F.lit(0).cast("bigint"), F.col("width") - F.size("ids")))
        return joined.select(key, *([batch] if batch else []), pad(F.col("ids")).alias("input_ids"), pad(segment_ids(F.col("tokens"))).alias("token_type_ids"), pad(F.transform("ids", lambda x: F.lit(1).cast("bigint"))).alias("attention_mask"))


def segment_ids(tokens: Column) -> Column:
    """Number of [SEP] before each token."""
    ends = F.transform(F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda s: s["t"] == SEP), lambda s: s["i"])
    return let(ends, lambda at: F.transform(tokens, lambda t, i: F.size(F.filter(at, lambda e: e < i)).cast("bigint")))


def untokenize(tokens: Column) -> Column:
    """Words again: a ## piece joins what is before it. Linear in the tokens: cut where a word begins, then join each word's pieces."""

    def words(t: Column, begins: Column) -> Column:
        ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(t) + 1))
        rest = lambda s, e: F.array_join(F.transform(F.slice(t, s + 1, e - s - 1), lambda x: F.substring(x, 3, F.length(x))), "")
        return F.zip_with(begins, ends, lambda s, e: F.concat(F.element_at(t, s), rest(s, e)))

    def whole(t: Column) -> Column:
        begins = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | ~F.coalesce(x.startswith("##"), F.lit(False)), i + 1)), lambda i: i.isNotNull())
        return F.when(F.size(t) > 0, let(begins, lambda b: words(t, b))).otherwise(t)

    return let(tokens, whole)


def keep_last(ids: Column, most: int, last: int, keep: bool = True) -> Column:
    """Truncation that keeps the end token (or plainly cuts)."""
    cut = F.concat(F.slice(ids, 1, most - 1), F.array(F.lit(last).cast("bigint"))) if keep else F.slice(ids, 1, most)
    return F.when(F.size(ids) > most, cut).otherwise(ids)


# ---- aligned tokens (offsets are code points; utf16 counts code units)


def aligned_words(text: str, lower: bool = True) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) after collapsing repeats, transliterating and splitting, offsets into the text as given."""
    special = re.compile(_python_class(T.SPECIAL))
    table = {ord(a): b for a, b in zip(T._ACCENTED, T._PLAIN)} | {ord(a): b for a, b in T.LIGATURES.items()}
    kept: list[tuple[str, int]] = []
    last = ""
    for i, c in enumerate(text):
        if c != last or not (special.match(c) or _symbol(c)):
            kept += [(x, i) for x in table.get(ord(c), c)]
        last = c
    flat = "".join(c for c, _ in kept)
    splitters = set(",.;:\\/?!#$%()=+-*\"'–_`<>&^@{}[]|~")
    for m in re.finditer(r"(?:(?!\r\n)[^ ])+", flat):
        at = m.start()
        for part in re.finditer(f"[^{re.escape(''.join(splitters))}]+|[{re.escape(''.join(splitters))}]", m[0]):
            s, e = at + part.start(), at + part.end()
            yield part[0].lower() if lower else part[0], kept[s][1], kept[e - 1][1] + 1


def _python_class(java: str) -> str:
    return "[" + java.replace("\\p{Sc}", "").replace("\\p{So}", "") + "]"


def _symbol(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c) in ("Sc", "So")


def utf16(text: str, offset: int) -> int:
    return offset + sum(ord(c) > 0xFFFF for c in text[:offset])


def wordpiece_aligned(vocab: dict[str, int], lower: bool = True, utf16_offsets: bool = False):
    """Column builder: array<struct<token, original, start, approx_end>>; the pieces of a word share its span."""

    @F.pandas_udf("array<struct<token:string,original:string,start:int,approx_end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, list[str]] = {}
        for texts in batches:
            out = []
            for t in texts:
                row = []
                for w, s, e in aligned_words(t or "", lower):
                    if w not in seen:
                        seen[w] = word_pieces(w, vocab)
                    at = (utf16(t, s), utf16(t, e)) if utf16_offsets else (s, e)
                    row += [{"token": p, "original": t[s:e], "start": at[0], "approx_end": at[1]} for p in seen[w]]
                out.append(row)
            yield pd.Series(out)

    return run


# ---- byte-fallback BPE


def added_pattern(added: dict[str, int]) -> re.Pattern | None:
    """Leftmost-longest match of the added tokens."""
    return re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None


def merge(run: str, bpe: BpeFile) -> list[tuple[int, int, int]]:
    """(id, start, end) of a run of normal text: blanks become metaspaces, the lowest-rank adjacent pair is merged until none is left
    (leftmost on ties), unknown characters fall back to their bytes, which share the character's span."""
    vocab = bpe.vocab
    ids = [vocab.get(T.METASPACE if c == " " else c) for c in run]
    n = len(ids)
    ends, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and ids[i] is not None and ids[j] is not None and (m := bpe.merges.get((ids[i], ids[j]))):
            heapq.heappush(heap, (m[0], i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    dead = [False] * n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if i < n else n
        if dead[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], ends[i], nxt[i], dead[j] = bpe.merges[(a, b)][1], ends[j], nxt[j], True
        if nxt[i] < n:
            prev[nxt[i]] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    out, i = [], 0
    while i < n:
        if ids[i] is not None:
            out.append((ids[i], i, ends[i]))
        else:
            c = T.METASPACE if run[i] == " " else run[i]
            out += [(vocab[f"<0x{x:02X}>"], i, i + 1) for x in c.encode() if f"<0x{x:02X}>" in vocab]
        i = nxt[i] if not dead[i] else i + 1
    return out


def bpe_spans(text: str, bpe: BpeFile) -> list[tuple[int, int, int]]:
    """(id, start, end) of a text without its end marks: added tokens and the runs between them."""
    pattern = added_pattern(bpe.added)
    out: list[tuple[int, int, int]] = []
    at = 0
    for m in pattern.finditer(text) if pattern else ():
        out += [(i, s + at, e + at) for i, s, e in merge(text[at : m.start()], bpe)]
        out.append((bpe.added[m[0]], m.start(), m.end()))
        at = m.end()
    return out + [(i, s + at, e + at) for i, s, e in merge(text[at:], bpe)]


def bpe_ids(text: str, bpe: BpeFile, most: int = 32_768, keep_eos: bool = True) -> list[int]:
    ids = [*([bpe.bos] if bpe.bos is not None else []), *(i for i, _, _ in bpe_spans(text, bpe)), *([bpe.eos] if bpe.eos is not None else [])]
    if len(ids) > most:
        ids = ids[: most - 1] + [bpe.eos] if keep_eos and bpe.eos is not None else ids[:most]
    return ids


def bpe_encode(bpe: BpeFile, most: int = 32_768, keep_eos: bool = True):
    """Column builder: array<bigint> of ids."""

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([bpe_ids(t or "", bpe, most, keep_eos) for t in texts])

    return run


def parts(bpe: BpeFile) -> tuple[str, str]:
    """Patterns of the parts of a run that no merge reaches across, so that each can be split by itself: words with the blanks before
    them (the whole run, if a merge joins a blank to what is before it), and the smallest parts that single characters tell."""
    first: dict[int, set[str]] = defaultdict(set)  # characters that a token of this id can begin with
    last: dict[int, set[str]] = defaultdict(set)
    for t, i in bpe.vocab.items():
        if len(t) == 1:
            first[i].add(t)
            last[i].add(t)
    grown = True
    while grown:
        grown = False
        for (a, b), (_, m) in bpe.merges.items():
            if not (first[a] <= first[m] and last[b] <= last[m]):
                first[m] |= first[a]
                last[m] |= last[b]
                grown = True
    pairs = [(last[a], first[b]) for a, b in bpe.merges if last[a] and first[b]]
    left, right = (set().union(*(p[k] for p in pairs)) for k in (0, 1))
    blank = f" {T.METASPACE}"
    chars = lambda s, more="": f"[{''.join(re.escape(blank if c == T.METASPACE else c) for c in sorted(s))}]{more}" if s else ""
    joins = any(T.METASPACE in b and a - {T.METASPACE} for a, b in pairs)
    return "(?s).+" if joins else f"[{blank}]*[^{blank}]+|[{blank}]+", f"(?s){chars(left)}(?:{chars(left & right, '*')}{chars(right)})?|." if pairs else "(?s)."


class Aligner:
    """Texts -> Arrow array of their (token, original, start, approx_end), by bpe_spans without empty spans. Every token is a kind, (id,
    original, step to the next token's start, width), and a word is remembered as the bytes of its kinds' numbers, so that a token
    takes some bytes and is made from its kind by NumPy and Arrow."""

    TYPE = pa.list_(pa.struct([("token", pa.string()), ("original", pa.string()), ("start", pa.int32()), ("approx_end", pa.int32())]))

    def __init__(self, bpe: BpeFile, words: str, small: str):
        self.bpe, self.names, self.added = bpe, bpe.tokens, added_pattern(bpe.added)
        self.words, self.small = re.compile(words), re.compile(small)
        self.forget()

    def forget(self) -> None:
        self.kinds: dict[tuple[int, str, int, int], int] = {}
        self.seen: dict[str, bytes] = {}
        self.columns: tuple = ()

    def numbers(self, spans: list[tuple[int, int, int]], text: str) -> bytes:
        """The numbers of the spans' kinds; a kind without width stands for text before the first token."""
        after = [*(s for _, s, _ in spans), len(text)]
        kinds = [(-1, "", after[0], 0)] if after[0] else []
        kinds += [(i, text[s:e], n - s, e - s) for (i, s, e), n in zip(spans, after[1:])]
        return array("i", [self.kinds.setdefault(k, len(self.kinds)) for k in kinds]).tobytes()

    def word(self, w: str) -> bytes:
        small = self.small.findall(w)
        if len(small) > 1:
            return b"".join([self.part(p, self.split) for p in small])
        return self.split(w)

    def split(self, w: str) -> bytes:
        return self.numbers(merge(w, self.bpe), w)

    def part(self, w: str, split: Callable[[str], bytes]) -> bytes:
        p = self.seen.get(w)
        if p is None:
            p = split(w)
            if len(w) <= LONGEST:
                self.seen[w] = p
        return p

    def run(self, text: str) -> bytes:
        seen, part, word = self.seen.get, self.part, self.word
        return b"".join([seen(w) or part(w, word) for w in self.words.findall(text)])

    def text(self, text: str) -> bytes:
        if not self.added:
            return self.run(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out.append(self.run(text[at : m.start()]))
            if m[0]:
                out.append(self.numbers([(self.bpe.added[m[0]], 0, len(m[0]))], m[0]))
            at = m.end()
        return b"".join([*out, self.run(text[at:])])

    def __call__(self, texts: list[str]) -> pa.Array:
        if max(len(self.seen), len(self.kinds)) > BPE_MEMORY:
            self.forget()
        found = [self.text(t) for t in texts]
        counts = np.array([len(x) // 4 for x in found], np.int64)
        at = np.frombuffer(b"".join(found), np.int32)
        if not self.columns or len(self.columns[0]) < len(self.kinds):
            ids, originals, steps, widths = zip(*self.kinds) if self.kinds else ((), (), (), ())
            self.columns = pa.array(["" if i < 0 else self.names[i] for i in ids], pa.string()), pa.array(originals, pa.string()), np.array(steps, np.int64), np.array(widths, np.int64)
        tokens, originals, steps, widths = self.columns
        step, rows = steps[at], np.repeat(np.arange(len(texts)), counts)
        before = np.cumsum([0, *map(len, texts)])
        start = np.cumsum(step) - step - before[rows]
        if not (full := widths[at] > 0).all():
            at, start, counts = at[full], start[full], np.bincount(rows[full], minlength=len(texts))
        values = [tokens.take(pa.array(at)), originals.take(pa.array(at)), pa.array(start, pa.int32()), pa.array(start + widths[at], pa.int32())]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.StructArray.from_arrays(values, fields=list(self.TYPE.value_type)), type=self.TYPE)


def bpe_aligned(bpe: BpeFile):
    """Column builder: array<struct<token, original, start, approx_end>>, empty spans left out. A batch's rows go back piece by piece:
    the tokens take many times the bytes of the text."""
    words, small = parts(bpe)

    @F.arrow_udf("array<struct<token:string,original:string,start:int,approx_end:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        align = Aligner(bpe, words, small)
        for texts in batches:
            piece, n = [], 0
            for t in texts:
                piece.append(t.as_py() or "")
                n += len(piece[-1])
                if n >= PIECE:
                    yield align(piece)
                    piece, n = [], 0
            if piece:
                yield align(piece)

    return run


def joined(tokens: Column) -> Column:
    """Text again, from the originals; tokens that share a span (the bytes of one character) count once."""
    same = lambda t, p: t["start"].eqNullSafe(p["start"]) & t["approx_end"].eqNullSafe(p["approx_end"])
    kept = lambda ts: F.transform(F.filter(ts, lambda t, i: ~same(t, F.get(ts, i - 1))), lambda t: t["original"])
    return F.array_join(let(tokens, kept), "")


def file_tokenizer(path: str, most: int = 32_768):
    """Column builder over a tokenizer.json through the tokenizers library: struct<ids, starts, ends>; loaded once a worker."""

    @F.pandas_udf("struct<ids:array<bigint>,starts:array<int>,ends:array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for texts in batches:
            rows = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
            yield pd.DataFrame({"ids": [r.ids[:most] for r in rows], "starts": [[s for s, _ in r.offsets[:most]] for r in rows], "ends": [[e for _, e in r.offsets[:most]] for r in rows]})

    return run


def file_untokenizer(path: str):
    """Column builder: ids back to text with the decoder of a tokenizer.json, marks left out; null ids give an empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        for ids in batches:
            yield pd.Series(t.decode_batch([[int(i) for i in x] if x is not None else [] for x in ids], skip_special_tokens=True))

    return run
