"""Texts reduced to what a reader sees: case, look-alike characters, invisible characters, markup."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "п": "n", "г": "r",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "μ": "u",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d", "ſ": "s",
}
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>")
_BREAK = re.compile(r"(?<=[^\W\d_])-\r?\n[>\s]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


class _Look(dict):
    """Characters to their plain form, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) not in ("Mn", "Me", "Cf", "Cc") or x in "\t\n\r\x0b\x0c")
        plain = "".join(LOOK_ALIKE.get(x.lower(), x.lower()) for x in plain)
        self[code] = plain
        return plain


LOOK = _Look()


def plain(text: str) -> str:
    """Lower case, marks and invisible characters gone, look-alikes as Latin letters, compatibility forms resolved."""
    return text.lower() if text.isascii() else text.translate(LOOK)


def words(text: str) -> list[str]:
    """The words of a text without markup, punctuation and line breaks (a word divided at a line's end is whole again)."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-\n" in text or "-\r" in text:
        text = _BREAK.sub("", text)
    return _WORD.findall(plain(text))
