"""Words of a text as comparisons see them: case, accents, punctuation, markup and page marks do not count."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_PAGE = re.compile(r"⁎\d*⁑")
_HYPHEN = re.compile(r"(\w)[-‐‑­][ \t]*\r?\n[ \t]*(?=\w)")
_INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF])
_LIST = re.compile(r"^[ \t]*(?:[-*•+‣·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])[ \t]+", re.M)
WORD = re.compile(r"\w+")


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};)")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]+")


def fold(text: str) -> str:
    """Lower case without accents; ASCII takes the short way."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_INVISIBLE)).casefold())


def _steps(text: str, lists: bool) -> list[tuple[re.Pattern, object]]:
    out: list[tuple[re.Pattern, object]] = []
    if "⁎" in text:
        out.append((_PAGE, lambda m: ""))
    if "&" in text:
        out.append((_ENTITY, lambda m: html.unescape(m[0])))
    if "<" in text or "&" in text:
        out.append((_TAG, lambda m: ""))
    if "\n" in text or "&" in text:
        out.append((_HYPHEN, lambda m: m[1]))
        if lists:
            out.append((_LIST, lambda m: ""))
    return out


def clean(text: str, lists: bool = True) -> str:
    """The text without markup, entities, page marks, line-end hyphens and list marks; still with its case."""
    for pattern, to in _steps(text, lists):
        text = pattern.sub(to, text)
    return text


def mapped(text: str, lists: bool = True) -> tuple[str, list[int]]:
    """fold(clean(text)) and the place in the original of each of its characters."""
    at = list(range(len(text)))
    for pattern, to in _steps(text, lists):
        out, where, last = [], [], 0
        for m in pattern.finditer(text):
            new = to(m)
            out += [text[last : m.start()], new]
            where += at[last : m.start()] + [at[m.start()]] * len(new)
            last = m.end()
        text, at = "".join([*out, text[last:]]), where + at[last:]
    out, where = [], []
    for c, i in zip(text, at):
        f = fold(c)
        out.append(f)
        where += [i] * len(f)
    return "".join(out), where


def words(text: str | None, lists: bool = True) -> list[str]:
    return WORD.findall(fold(clean(text, lists)).replace("_", " ")) if text else []
