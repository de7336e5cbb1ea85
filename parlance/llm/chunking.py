"""Splitting oversized texts at natural boundaries.

Dynamic programming over boundary positions minimises the penalties of the cuts and the imbalance of the sizes, subject
to the largest length and the overlap. Positions are code points; the cores of the pieces tile the text, so none is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parlance.llm.sentences import pieces

SPACE = re.compile(r"\s+")
OUTER = " \t\n\r"
#: The levels of a cut: at a newline, a sentence end, white space, inside a word.
LEVELS = ("paragraph", "sentence", "word", "none")
#: Weight of a piece's squared deviation from equal sizes.
BALANCE = 2.0


def boundary(text: str, limit: int) -> str:
    """The coarsest of paragraph, sentence, word whose pieces all fit the limit, else none, by definition: what `cuts` must find."""
    text = text.strip(OUTER)
    if max(map(len, text.split("\n")), default=0) <= limit:
        return "paragraph"
    if all(len(text[a:b].strip()) <= limit for a, b in pieces(text)):
        return "sentence"
    return "word" if max(map(len, text.split()), default=0) <= limit else "none"


def penalties(target: float, limit: int) -> list[float]:
    """Penalty of a cut by level.

    A cut inside a sentence that fits is dearer than cuts at both its ends with the piece between them, and so is one
    inside a word that fits: at most three pieces change their balance. So no such position need be offered.
    """
    most = BALANCE * max(1.0, (limit / target - 1) ** 2)
    word = 2 * 1.0 + 3 * most + 2
    return [0.0, 1.0, word, 2 * word + 3 * most + 2]


def candidates(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions where the text may be cut, their levels); finer ones only inside what is too long without them."""
    level: dict[int, int] = {}
    step = limit - overlap

    def offer(at: int, kind: int) -> None:
        if 0 < at < len(text):
            level[at] = min(level.get(at, 3), kind)

    def gap(a: int, b: int, kind: int) -> None:
        """White space, both ends and as often inside as it takes."""
        offer(a, kind)
        offer(b, kind)
        for at in range(a + step, b, step):
            offer(at, kind)

    for m in re.finditer("\n+", text):
        for at in range(m.start(), m.end() + 1) if m.end() - m.start() <= limit else [*range(m.start(), m.end(), step), m.end()]:
            offer(at, 0)
    for a, b in pieces(text):
        bare = text[a:b].strip()
        offer(b, 1)
        if bare and len(bare) < b - a:
            start = a + text[a:b].index(bare)
            gap(a, start, 1)
            gap(start + len(bare), b, 1)
        elif not bare:
            gap(a, b, 1)
        if len(bare) <= limit:
            continue
        at = a
        for m in [*SPACE.finditer(text, a, b), None]:
            stop = m.start() if m else b
            for hard in range(at + step, stop, step) if stop - at > limit else ():
                offer(hard, 3)
            if m:
                gap(m.start(), m.end(), 2)
                at = m.end()
    at = np.array(sorted(level), dtype=np.int64)
    return at, np.array([level[x] for x in at.tolist()], dtype=np.int64)


def programme(n: int, at: np.ndarray, penalty: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    """(first, last) of the pieces between the positions that cost least, or None if no choice fits the limit."""
    at, penalty = np.concatenate([[0], at, [n]]), np.concatenate([[0.0], penalty, [0.0]])
    target = n / np.ceil(n / (limit - overlap))
    if np.diff(at).max() > limit:
        return None
    best = np.full(len(at), np.inf)
    back = np.zeros(len(at), dtype=np.int64)
    best[0] = 0.0
    lows = np.searchsorted(at, at - limit)
    for j in range(1, len(at)):
        i = lows[j]
        core = at[j] - at[i:j]
        missing = np.where(at[i:j] > 0, np.maximum(0, core + overlap - limit), 0) / max(1, overlap)
        total = best[i:j] + BALANCE * ((core - target) / target) ** 2 + missing
        k = int(total.argmin())
        best[j], back[j] = total[k] + penalty[j], i + k
    out, j = [], len(at) - 1
    while j:
        i = int(back[j])
        out.append((int(at[i]), int(at[j])))
        j = i
    return out[::-1]


def cut(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], str]:
    """((start, core, end) of each piece, the coarsest level at which the programme finds pieces that fit).

    text[core:end] tile the text, text[start:core] repeats the end of the piece before. end - start is at most the limit;
    the overlap is `overlap`, or less where a natural piece leaves less room.
    """
    n = len(text)
    if not n:
        return [], LEVELS[0]
    if n <= limit:
        return [(0, 0, n)], LEVELS[0]
    at, level = candidates(text, limit, overlap)
    bare = text.strip(OUTER)
    first = text.index(bare) if bare else 0
    for edge in (first, first + len(bare)):
        if 0 < edge < n and edge not in at:
            where = int(np.searchsorted(at, edge))
            at, level = np.insert(at, where, edge), np.insert(level, where, 1)
    # outer white space doesn't count, so it may be cut at any level
    outer = (at <= first) | (at >= first + len(bare))
    cost = np.array(penalties(n / np.ceil(n / (limit - overlap)), limit))
    for k, name in enumerate(LEVELS):
        own = (level <= k) | outer
        found = programme(n, at[own], cost[level[own]], limit, overlap)
        if found is not None:
            break
    return [(core - min(overlap, limit - (end - core), core), core, end) for core, end in found], name


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    return cut(text, limit, overlap)[0]


def split(df: DataFrame, text: str, keep: list[str], limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """One row per piece: `keep`, piece_no, start, core, end, boundary (of the whole text) and, if wanted, the piece.

    A text within the limit is one piece. NULL and empty texts have none. Columns `keep` must not bear the names above.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    schema = T.StructType([df.schema[k] for k in keep])
    for name, kind in (("piece_no", T.IntegerType()), ("start", T.IntegerType()), ("core", T.IntegerType()), ("end", T.IntegerType()), ("boundary", T.StringType())):
        schema = schema.add(name, kind)
    if with_text:
        schema = schema.add("piece", T.StringType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows, kinds, bits = [], [], [], []
            for k, t in enumerate(b.column(len(keep)).to_pylist()):
                if not t:
                    continue
                found, kind = cut(t, limit, overlap)
                for no, (start, core, end) in enumerate(found):
                    take.append(k)
                    rows.append((no, start, core, end))
                    kinds.append(kind)
                    if with_text:
                        bits.append(t[start:end])
            index = pa.array(take, pa.int32())
            numbers = np.array(rows, dtype=np.int32).reshape(-1, 4)
            columns = [b.column(i).take(index).cast(arrow.field(i).type) for i in range(len(keep))]
            columns += [pa.array(numbers[:, i]) for i in range(4)] + [pa.array(kinds, pa.string())] + ([pa.array(bits, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
