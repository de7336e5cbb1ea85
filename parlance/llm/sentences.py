"""Sentences of a text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The end of a piece: a newline, or . ! ? before white space or the end, or a full-width stop.
END = re.compile(r"[\n.!?。！？](?:(?<=[\n。！？])|(?=\s|\Z))")
COUNTS = re.compile(r"[^\W_]")
LETTER = re.compile(r"[^\W\d_]")
#: A character beyond the basic plane.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
#: For Java's regular expressions: a letter or digit.
WORDY = "[\\p{L}\\p{N}]"
#: Code points up to which what stands between two spaces is remembered.
SHORT = 24


def _alphabet() -> str:
    """Ranges of the letters of the basic plane but for Han, kana and Hangul, for a class that is one look-up a character."""
    apart = re.compile("[々぀-ヿ一-鿿가-힣]")
    out, first = [], None
    for k in range(0x10001):
        own = k < 0x10000 and (c := chr(k)).isalnum() and not c.isdecimal() and not apart.match(c)
        if own and first is None:
            first = k
        elif not own and first is not None:
            out.append(f"{chr(first)}-{chr(k - 1)}")
            first = None
    return "".join(out)


ALPHABET = _alphabet()


def pieces(text: str) -> list[tuple[int, int]]:
    """Spans of all pieces, counted or not; newlines belong to no piece."""
    out, at = [], 0
    for m in END.finditer(text):
        end = m.end()
        stop = end - 1 if text[end - 1] == "\n" else end
        if stop > at:
            out.append((at, stop))
        at = end
    if at < len(text):
        out.append((at, len(text)))
    return out


def sentences(text: str | None) -> list[str]:
    """The pieces with a letter or digit, in order; NULL has none."""
    if not text:
        return []
    return [s.strip() for a, b in pieces(text) if COUNTS.search(s := text[a:b])]


def nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def unaccented(text: str) -> str:
    """Without combining marks, đ as d."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")


def blank(c: Column) -> Column:
    """NULL or without any letter or digit."""
    return ~F.coalesce(c.rlike(WORDY), F.lit(False))
