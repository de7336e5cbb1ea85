"""Greedy batches of ordered items.

Greedy filling is sequential in one document and parallel across documents. The folds run in Arrow batches over arrays of
sizes, in time linear in the items; texts themselves never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbers(sizes: list[int], limit: int, separator: int = 1, empties_ride: bool = True) -> list[int]:
    """Batch number of each size, from 0.

    An item joins while the running size, with a separator between items, stays within the limit; it is never divided.
    Empty items ride along without closing or charging a batch, yet count as members for the next separator.
    """
    out, batch, used, any_ = [], 0, 0, False
    for size in sizes:
        if not (empties_ride and size == 0):
            more = size + (separator if any_ else 0)
            if used + more <= limit:
                used += more
            else:
                batch, used = batch + any_, size
        any_ = True
        out.append(batch)
    return out


def segment_numbers(sizes: list[int], alone: list[bool], limit: int = 5_000, most: int = 30) -> list[int]:
    """Batch number of each segment: within limit and count; one marked `alone` closes the batch before and its own."""
    out, batch, used, n, closed = [], -1, 0, 0, True
    for size, own in zip(sizes, alone, strict=True):
        if closed or own or used + size > limit or n >= most:
            batch, used, n = batch + 1, 0, 0
        used, n, closed = used + size, n + 1, own
        out.append(batch)
    return out


def _fold(one: Callable[..., list[int]], *columns: Column) -> Column:
    """A fold of whole arrays, each once, in Arrow batches; NULL stays NULL."""

    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else np.array(one(*(x.tolist() for x in row)), np.int32) for row in zip(*parts, strict=True)], dtype=object)

    if len(columns) == 1:

        def single(a: pd.Series) -> pd.Series:
            return run(a)

        return F.pandas_udf(single, "array<int>")(*columns)

    def double(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return F.pandas_udf(double, "array<int>")(*columns)


def batch_numbers(sizes: Column, limit: int, separator: int = 1, empties_ride: bool = True) -> Column:
    """`numbers` of an array of sizes."""
    return _fold(lambda x: numbers(x, limit, separator, empties_ride), sizes)


def segment_batch_numbers(segments: Column, limit: int = 5_000, most: int = 30) -> Column:
    """`segment_numbers` of an array of (size, is_html)."""
    return _fold(lambda x, y: segment_numbers(x, y, limit, most), F.transform(segments, lambda x: x["size"]), F.transform(segments, lambda x: x["is_html"]))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, line) of every line of every text."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("idx", "line"))


def batched(df: DataFrame, key: str, text: str, limit: int, separator: int = 1) -> DataFrame:
    """(key, idx, n, batch): the lines of each text in greedy batches; one row of arrays per text, no shuffle."""
    arrays = df.where(F.col(text).isNotNull()).select(key, F.transform(F.split(text, "\n"), lambda x: F.length(x)).alias("sizes"))
    zipped = arrays.select(key, F.arrays_zip("sizes", batch_numbers(F.col("sizes"), limit, separator).alias("batches")).alias("z"))
    return zipped.select(key, F.posexplode("z").alias("idx", "x")).select(key, "idx", F.col("x.sizes").alias("n"), F.col("x.batches").alias("batch"))


def thinned(percents: Column, step: int = 5) -> Column:
    """Those percents that lie at least `step` above the one emitted before."""

    def one(values: list[int]) -> list[int]:
        out: list[int] = []
        for p in values:
            if not out or p >= out[-1] + step:
                out.append(p)
        return out

    return _fold(one, percents)
