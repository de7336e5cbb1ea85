"""Long spans that appear verbatim in more than one record, by super-k-mer partitioning.

Every window of `k` code points has a minimiser: the least of the hashes of its m-grams. Consecutive windows with one
minimiser travel as one packed string to the bucket of that minimiser, so equal windows always meet in one bucket, where
sorting finds the equal ones. Only strings whose minimiser occurs in two records travel at all; repeated strings travel
once. Buckets too large for one task are parted again by the minimisers of longer m-grams, at last by the windows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.session import forget, written

#: m-grams under the minimisers; a power of two.
M = 64
#: Windows hashed at a time, so that a text of any length fits in memory.
SLICE = 1 << 19
#: Code points of strings that one bucket may hold before it is parted by the minimisers of longer m-grams.
BUCKET = 6_000_000
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(codes: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of k codes, by doubling."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        level = _mix(codes.astype(np.uint64) + base)
        power, done, at, length, bits = base, None, 0, 1, k
        while bits:
            if bits & 1:
                part = level[at : at + n]
                done = part if done is None else done * power + part
                at += length
            bits >>= 1
            if bits:
                level = level[:-length] * power + level[length:] if length < len(level) else level[:0]
                length, power = length * 2, power * power
        return _mix(done)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    length = 1
    while length * 2 <= w:
        h = np.minimum(h[:-length], h[length:])
        length *= 2
    return h if length == w else np.minimum(h[: len(h) - (w - length)], h[w - length :])


def super_kmers(codes: np.ndarray, k: int, m: int = M, base: np.uint64 = _B1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each run of windows with one minimiser."""
    starts, counts, minis = [], [], []
    windows = len(codes) - k + 1
    for a in range(0, max(0, windows), SLICE):
        b = min(windows, a + SLICE)
        least = _least(window_hashes(codes[a : b + k - 1], m, base), k - m + 1)
        edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        starts.append(edge + a)
        counts.append(np.diff(np.append(edge, b - a)))
        minis.append(least[edge].view(np.int64))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(minis)


def _grouped(texts: list[str], k: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """super_kmers of many texts at once: (indices of texts, which text, start, ...) by slices of bounded size."""
    batch: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t is None or len(t) < k:
            continue
        if batch and size + len(t) > SLICE:
            yield batch
            batch, size = [], 0
        batch.append(i)
        size += len(t)
    if batch:
        yield batch


def scan(df: DataFrame, node: str, text: str, k: int) -> DataFrame:
    """(node, at, n, mini): the super-k-mers of every text."""
    kind = df.schema[node].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for own in _grouped(texts, k):
                codes = [codes_of(texts[i]) for i in own]
                sizes = np.array([len(c) for c in codes])
                if len(own) == 1:
                    at, n, mini = super_kmers(codes[0], k)
                    who = np.zeros(len(at), np.int64)
                else:
                    ends = np.cumsum(sizes)
                    whole = np.concatenate(codes)
                    least = _least(window_hashes(whole, M, _B1), k - M + 1)
                    where = np.arange(len(least))
                    doc = np.searchsorted(ends, where, side="right")
                    inside = where + k <= ends[doc]
                    where, doc, least = where[inside], doc[inside], least[inside]
                    edge = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
                    n = np.diff(np.append(edge, len(where)))
                    who = doc[edge]
                    at, mini = where[edge] - (ends - sizes)[who], least[edge].view(np.int64)
                index = pa.array(np.array(own, np.int64)[who])
                yield pa.RecordBatch.from_arrays([b.column(0).take(index), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(mini)], names=[node, "at", "n", "mini"])

    return df.select(node, text).mapInArrow(run, f"{node} {kind}, at int, n int, mini bigint")


def packed(df: DataFrame, node: str, text: str, k: int) -> DataFrame:
    """Rows (node, text, runs) to (node, at, mini, k1, k2, packed): k1 and k2 identify the string, which comes once per batch."""
    kind = df.schema[node].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for b in batches:
            who, at, minis, k1, k2, strings = [], [], [], [], [], []
            seen: set[bytes] = set()
            texts = b.column(1).to_pylist()
            for i, runs in enumerate(b.column(2).to_pylist()):
                t = texts[i]
                for r in runs:
                    s = t[r["at"] : r["at"] + r["n"] + k - 1]
                    key = blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    who.append(i)
                    at.append(r["at"])
                    minis.append(r["mini"])
                    k1.append(int.from_bytes(key[:8], "little", signed=True))
                    k2.append(int.from_bytes(key[8:], "little", signed=True))
                    strings.append(None if key in seen else s)
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int32())), pa.array(at, pa.int32()), pa.array(minis, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(strings, pa.string())], names=[node, "at", "mini", "k1", "k2", "packed"])

    return df.select(node, text, "runs").mapInArrow(run, f"{node} {kind}, at int, mini bigint, k1 bigint, k2 bigint, packed string")


def shared_windows(strings: list[str], low: np.ndarray, high: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Of each string the ranges (first window, window after the last) of windows found in two records.

    low and high are the least and greatest record that hold the string. Windows are sorted by hash; those of one hash are
    the same text, which is checked run by run; a false meeting is settled by the texts themselves.
    """
    codes = [codes_of(s) for s in strings]
    sizes = np.array([len(c) for c in codes])
    counts = sizes - k + 1
    owner = np.repeat(np.arange(len(strings)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(counts.sum()) - first[owner]
    whole = np.concatenate(codes)
    base = np.cumsum(sizes) - sizes
    key = window_hashes(whole, k, _B2)[base[owner] + place]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(order))))
    lo = np.minimum.reduceat(low[owner[order]], edge)
    hi = np.maximum.reduceat(high[owner[order]], edge)
    shared = np.empty(len(order), bool)
    shared[order] = (lo < hi)[group]
    head = np.empty(len(order), np.int64)
    head[order] = order[edge][group]
    out: list[list[tuple[int, int]]] = []
    for i in range(len(strings)):
        a, n = first[i], counts[i]
        if low[i] < high[i]:
            out.append([(0, int(n))])
            continue
        flags = shared[a : a + n]
        step = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
        ranges = [(int(x), int(y)) for x, y in step.reshape(-1, 2)]
        for x, y in ranges:
            h = head[a + x : a + y]
            cut = np.flatnonzero(np.diff(h) != 1) + 1
            for u, v in zip(np.concatenate([[0], cut]), np.concatenate([cut, [y - x]]), strict=True):
                j, p = owner[h[u]], place[h[u]]
                if strings[j][p : p + (v - u) + k - 1] != strings[i][x + u : x + v + k - 1]:
                    return _by_text(strings, low, high, k)
        out.append(ranges)
    return out


def _by_text(strings: list[str], low: np.ndarray, high: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """shared_windows without hashes."""
    seen: dict[str, tuple] = {}
    for s, lo, hi in zip(strings, low.tolist(), high.tolist(), strict=True):
        for p in range(len(s) - k + 1):
            a, b = seen.get(s[p : p + k], (lo, hi))
            seen[s[p : p + k]] = (min(a, lo), max(b, hi))
    out = []
    for s in strings:
        flags = [seen[s[p : p + k]][0] < seen[s[p : p + k]][1] for p in range(len(s) - k + 1)]
        step = np.flatnonzero(np.diff(np.concatenate([[0], np.array(flags, np.int8), [0]])))
        out.append([(int(x), int(y)) for x, y in step.reshape(-1, 2)])
    return out


_RANGES = "array<struct<a: int, b: int>>"


def _in_buckets(distinct: DataFrame, k: int) -> DataFrame:
    """(mini, k1, k2, ranges) of whole buckets, streamed in order of their minimiser."""

    def settle(rows: pd.DataFrame) -> pa.RecordBatch:
        found = shared_windows(rows["packed"].tolist(), rows["low"].to_numpy(), rows["high"].to_numpy(), k)
        keep = [i for i, r in enumerate(found) if r]
        ranges = pa.array([[{"a": a, "b": b} for a, b in found[i]] for i in keep], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(rows[c].to_numpy()[keep], pa.int64()) for c in ("mini", "k1", "k2")] + [ranges], names=["mini", "k1", "k2", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            rows = b.to_pandas()
            if not len(rows):
                continue
            rest.append(rows)
            size += int(rows["packed"].str.len().sum())
            if size > SLICE:
                rows = pd.concat(rest, ignore_index=True)
                last = rows["mini"].iloc[-1]
                done = rows[rows["mini"] != last]
                if len(done):
                    yield settle(done)
                rest = [rows[rows["mini"] == last]]
                size = int(rest[0]["packed"].str.len().sum())
        if rest:
            yield settle(pd.concat(rest, ignore_index=True))

    ready = distinct.select("mini", "k1", "k2", "low", "high", "packed").repartition("mini").sortWithinPartitions("mini")
    return ready.mapInArrow(run, f"mini bigint, k1 bigint, k2 bigint, ranges {_RANGES}")


def _finer(distinct: DataFrame, k: int, m: int) -> DataFrame:
    """The strings parted by the minimisers of m-grams: (mini, k1, k2, off, mini2, s1, s2, sub, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for b in batches:
            for i, s in enumerate(b.column(3).to_pylist()):
                at, n, mini = super_kmers(codes_of(s), k, m, _B2)
                for c in range(0, len(at), 20_000):
                    subs = [s[x : x + y + k - 1] for x, y in zip(at[c : c + 20_000].tolist(), n[c : c + 20_000].tolist(), strict=True)]
                    keys = np.frombuffer(b"".join(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in subs), dtype=np.int64).reshape(-1, 2)
                    own = pa.array(np.full(len(subs), i, np.int32))
                    columns = [b.column(x).take(own) for x in (0, 1, 2)] + [pa.array(at[c : c + 20_000].astype(np.int32)), pa.array(mini[c : c + 20_000]), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(subs, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns + [b.column(x).take(own) for x in (4, 5)], names=["mini", "k1", "k2", "off", "mini2", "s1", "s2", "sub", "low", "high"])

    return distinct.select("mini", "k1", "k2", "packed", "low", "high").mapInArrow(run, "mini bigint, k1 bigint, k2 bigint, off int, mini2 bigint, s1 bigint, s2 bigint, sub string, low bigint, high bigint")


def _settled(distinct: DataFrame, hot: DataFrame, k: int, bucket: int, finer: list[int]) -> DataFrame:
    """(mini, k1, k2, ranges): buckets are sorted whole, the hot ones (mini) after they are parted by longer m-grams.

    Minimisers of k-grams are the windows themselves, so the last parting leaves nothing large. Texts are compared at every level.
    """
    hot = written(hot.select("mini"), "hot")
    if not finer or not hot.limit(1).count():
        return _in_buckets(distinct, k)
    parts = written(_finer(distinct.join(hot, "mini", "left_semi"), k, finer[0]), "finer")
    subs = parts.groupBy(F.col("mini2").alias("mini"), F.col("s1").alias("k1"), F.col("s2").alias("k2")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("sub").alias("packed"))
    sizes = parts.groupBy(F.col("mini2").alias("mini")).agg(F.sum(F.length("sub")).alias("size")).where(f"size > {bucket}")
    found = _settled(subs, sizes, k, bucket, finer[1:]).select(F.col("mini").alias("mini2"), F.col("k1").alias("s1"), F.col("k2").alias("s2"), "ranges")
    moved = parts.select("mini", "k1", "k2", "off", "mini2", "s1", "s2").join(found, ["mini2", "s1", "s2"]).select("mini", "k1", "k2", "off", F.explode("ranges").alias("r"))
    back = moved.groupBy("mini", "k1", "k2").agg(F.collect_list(F.struct((F.col("off") + F.col("r.a")).alias("a"), (F.col("off") + F.col("r.b")).alias("b"))).cast(_RANGES).alias("ranges"))
    return _in_buckets(distinct.join(hot, "mini", "left_anti"), k).unionByName(back)


def shared_spans(df: DataFrame, node: str, text: str, k: int, bucket: int = BUCKET) -> DataFrame:
    """(node, shared): code points of each record in stretches of at least k that another record holds verbatim.

    `node` must be a bigint without repeats. Records without such a stretch, with NULL texts and texts shorter than k give
    no row. Repeats inside one record don't count. Other columns are not read.
    """
    if k <= M:
        raise ValueError(f"k must be more than {M}")
    own = df.select(F.col(node).alias("node"), F.col(text).alias("text")).where(f"node IS NOT NULL AND length(text) >= {k}")
    found = written(scan(own, "node", "text", k), "superkmers")
    both = found.groupBy("mini").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum(F.col("n") + k - 1).alias("size")).where("lo < hi").select("mini", "size")
    marked = found.join(both, "mini")
    runs = marked.groupBy("node").agg(F.collect_list(F.struct("at", "n", "mini")).alias("runs"))
    parts = written(packed(own.join(runs, "node"), "node", "text", k), "packed")
    hot = written(both.where(f"size > {bucket}"), "hot")
    forget(found)
    distinct = parts.groupBy("mini", "k1", "k2").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("packed").alias("packed"))
    done = _settled(distinct, hot, k, bucket, [(M + k) // 2, k])
    places = parts.select("node", "at", "mini", "k1", "k2").join(done, ["mini", "k1", "k2"]).select("node", "at", F.explode("ranges").alias("r"))
    spans = places.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b") + k - 1).alias("b")))).alias("spans"))
    merged = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("sum")), lambda s: s["sum"])
    return spans.select(F.col("node").alias(node), merged.cast("int").alias("shared"))
