"""Text normalisation as Column builders; everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters whose immediate repetition is collapsed, and those that split words and are kept as tokens.
SPECIAL = "\\s\\p{Sc}\\p{So}(){}\\[\\]\\-–—~'\"”“`‘´’‚„»«「」『』（）〔〕【】《》〈〉…:;!?.,¿¡<>_#*&"
SPLITTERS = ".,;:\\\\/?!#$%()=+\\-*\"'–_`<>&\\^@{}\\[\\]|~"
PROMPTS = {
    "web_search": "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: ",
    "similarity": "Instruct: Retrieve semantically similar text\nQuery: ",
    "bitext": "Instruct: Retrieve parallel sentences\nQuery: ",
}
MAX_WORD = 50
METASPACE = "▁"
PAGE_MARK = "⁎(\\d*)⁑"
#: Latin letters that do not decompose.
LIGATURES = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i"}
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def with_prompt(c: Column, prompt: str) -> Column:
    return F.concat(F.lit(prompt), or_empty(c))


def collapse_repeats(c: Column) -> Column:
    """Drops a special character that equals its predecessor."""
    return F.regexp_replace(c, f"([{SPECIAL}])\\1+", "$1")


def kept_positions(c: Column) -> Column:
    """Zero-based code point positions that collapse_repeats keeps."""
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    before = F.concat(F.array(F.lit(None).cast("string")), chars)
    pairs = F.transform(F.zip_with(chars, before, lambda x, p: F.struct(x.alias("x"), p.alias("p"))), lambda s, i: F.struct(i.alias("i"), s["x"].alias("x"), s["p"].alias("p")))
    kept = F.filter(pairs, lambda s: s["x"].isNotNull() & ~(s["x"].eqNullSafe(s["p"]) & s["x"].rlike(f"^[{SPECIAL}]$")))
    return F.transform(kept, lambda s: s["i"])


def transliterate(c: Column, keep: str = "") -> Column:
    """Latin letters to ASCII: accents go, ligatures are spelled out; `keep` lists characters that stay, other scripts are untouched."""
    pairs = [(a, b) for a, b in zip(_ACCENTED, _PLAIN) if a not in keep]
    out = F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    for a, b in LIGATURES.items():
        if a not in keep:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(c.rlike("[^\\x00-\\x7F]"), out).otherwise(c)


def split_words(c: Column, whitespace: str = "reference") -> Column:
    """Words; 'reference' splits at blanks and CR LF only, 'unicode' at any white space. Empty pieces vanish."""
    return F.filter(F.split(c, " |\\r\\n" if whitespace == "reference" else "(?U)\\s+"), lambda x: x != "")


def split_keep(word: Column) -> Column:
    """A word cut at each splitter, which stays as a token of its own."""
    return F.regexp_extract_all(word, F.lit(f"[^{SPLITTERS}]+|[{SPLITTERS}]"), F.lit(0))


def basic_tokens(c: Column, lower: bool = True, whitespace: str = "reference") -> Column:
    """Collapse, transliterate, split at white space and at splitters, lower-case: the tokens before sub-word splitting."""
    text = transliterate(collapse_repeats(or_empty(c)))
    out = F.flatten(F.transform(split_words(text, whitespace), split_keep))
    return F.transform(out, F.lower) if lower else out


def drop_long_words(words: Column, most: int = MAX_WORD) -> Column:
    return F.filter(words, lambda w: F.length(w) <= most)


def metaspace(c: Column) -> Column:
    return F.translate(c, " ", METASPACE)


def clamp_offset(c: Column, length: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), length)


def strip_continuation(c: Column) -> Column:
    return F.regexp_replace(c, "^##", "")


def strip_pages(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_MARK, "")


def page_tag(c: Column) -> Column:
    """'' without a page mark, 'N' for one page, 'N-M' for the smallest and largest."""
    pages = F.transform(F.filter(F.regexp_extract_all(c, F.lit(PAGE_MARK), F.lit(1)), lambda x: x != ""), lambda x: x.try_cast("int"))
    lo, hi = F.array_min(pages).cast("string"), F.array_max(pages).cast("string")
    return F.when(F.size(pages) == 0, "").when(lo == hi, lo).otherwise(F.concat_ws("-", lo, hi))


def utf8_bytes(c: Column) -> Column:
    return F.octet_length(c)


def label(c: Column, most: int = 30) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


def is_blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[\\t\\n\\r]", " ")) == ""


def covering_tokens(c: Column) -> Column:
    """Tokens whose concatenation is the text: white space stays with the token that follows."""
    return F.regexp_extract_all(c, F.lit("[ \\t\\n\\r]*(?:[\\p{L}\\p{N}]+|[^ \\t\\n\\r\\p{L}\\p{N}])|[ \\t\\n\\r]+"), F.lit(0))
