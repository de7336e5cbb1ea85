"""Plain text to markdown, and markdown to pieces of bounded size.

Each text is handled by itself. What is a fold over the lines of one text runs in Arrow batches, in time linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parlance.functions import text as X


def paragraphs(c: Column) -> Column:
    """The paragraphs parted by empty lines, without outer white space; blank ones are left out."""
    parts = F.split(F.regexp_replace(X.trimmed(c), "\n{3,}", "\n\n"), "\n\n")
    return F.filter(F.transform(parts, X.trimmed), lambda p: p != "")


def enriched(paragraph: Column) -> Column:
    """A paragraph with its heading marked, the lines that a heading wraps into joined, and bullets as dashes."""
    lines = F.filter(F.transform(F.split(paragraph, "\n"), X.trimmed), lambda x: x != "")
    first, rest = X.bullet(F.get(lines, F.lit(0))), F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1))
    level = X.heading_level(first)
    # the heading takes the following lines as long as they continue it
    wrapped = F.coalesce(F.nullif(F.array_position(F.transform(rest, X.heading_continues), F.lit(False)), F.lit(0)) - 1, F.size(rest).cast("bigint")).cast("int")
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.array_join(F.concat(F.array(first), F.slice(rest, F.lit(1), wrapped)), " "))
    body = F.array_join(F.slice(rest, wrapped + 1, F.greatest(F.lit(0), F.size(rest) - wrapped)), "\n")
    plain = F.array_join(F.transform(lines, X.bullet), "\n")
    promoted = (level > 0) & ((F.size(lines) == 1) | (F.length(first) <= 220))
    return F.when(promoted & (body != ""), F.concat(heading, F.lit("\n\n"), body)).when(promoted, heading).otherwise(plain)


def inferred(c: Column) -> Column:
    """Markdown of a plain text; a text that already looks like markdown is left alone."""
    made = F.array_join(F.transform(paragraphs(c), enriched), "\n\n")
    return F.when(X.looks_markdown(c), c).otherwise(made)


def hard_pieces(text: str, n: int) -> list[str]:
    """Pieces of at most n code points; white space at the cuts is dropped."""
    out, at, end = [], 0, len(text)
    while at < end:
        while at < end and text[at].isspace():
            at += 1
        piece = text[at : at + n].rstrip()
        if piece:
            out.append(piece)
        at += n
    return out


def paragraph_pieces(text: str, n: int, separator: int = 2) -> list[str]:
    """Paragraphs joined by an empty line as long as they fit n code points; one that is too long by itself is cut hard."""
    out: list[str] = []
    held: list[str] = []
    used = 0
    for block in filter(None, (b.strip() for b in text.split("\n\n"))):
        more = len(block) + (separator if held else 0)
        if used + more > n and held:
            out.append("\n\n".join(held))
            held, used, more = [], 0, len(block)
        if more > n:
            out += hard_pieces(block, n)
        else:
            held.append(block)
            used += more
    return out + (["\n\n".join(held)] if held else [])


def screen_pieces(text: str, target: int = 4_500, most: int = 9_000, share: float = 0.35) -> list[str]:
    """Paragraphs joined up to `target`; what exceeds `most` is cut at the last newline or blank past `share` of it."""
    text = text.strip()
    if len(text) <= target:
        return [text] if text else []
    joined: list[str] = []
    held: list[str] = []
    used = 0
    for p in re.split(r"\n\n+", text):
        if used and used + 2 + len(p) > target:
            joined.append("\n\n".join(held))
            held, used = [], 0
        used += len(p) + (2 if used else 0)
        held = [*held, p] if held and used > len(p) else [p]
    joined.append("\n\n".join(held))
    out: list[str] = []
    for piece in filter(None, joined):
        if len(piece) <= most:
            out.append(piece)
            continue
        piece, at = piece.strip(), 0
        while at < len(piece):
            end = min(at + most, len(piece))
            if end < len(piece):
                cut = max(piece.rfind("\n", at, end), piece.rfind(" ", at, end)) - at
                end = at + cut + 1 if cut > most * share else end
            if part := piece[at:end].strip():
                out.append(part)
            at = end
    return out or [text]


def pieces_of(df: DataFrame, key: str, text: str, cut: Callable[[str], list[str]]) -> DataFrame:
    """(key, idx, piece) of every text by a function of one text; NULL and blank texts have none."""
    schema = T.StructType([df.schema[key], T.StructField("idx", T.IntegerType()), T.StructField("piece", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, idx, found = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                own = cut(t) if t else []
                who += [k] * len(own)
                idx += range(len(own))
                found += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int32())).cast(arrow.field(0).type), pa.array(idx, pa.int32()), pa.array(found, pa.string())], schema=arrow)

    return df.select(key, F.col(text)).mapInArrow(run, schema)
