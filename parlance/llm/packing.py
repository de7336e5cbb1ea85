"""Filling boxes of fixed capacity with items by exact-complement hashing.

Items are known by their sizes, so the plan is made on the histogram of sizes, which has at most `capacity` entries
however many items there are. Single sizes, pair sums and triple sums that are still to be had are indexed; each size, the
largest first, looks up the complement that fills its box exactly, and the combination is used as often as its sizes are
available. What finds no complement goes best-fit. Items get their places by their position among those of one size.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.ranking import positions
from parlance.session import written

#: What is in a box: (size, how many of it), the largest size first.
Content = tuple[tuple[int, int], ...]


class Sums:
    """Which sums of one, two and three sizes can be had: an index that is rebuilt when it has gone stale."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.build()

    def build(self) -> None:
        have = (self.left > 0).astype(float)
        n = 1 << (2 * len(have)).bit_length()
        f = np.fft.rfft(have, n)
        self.pairs = np.fft.irfft(f * f, n)[: len(have)] > 0.5
        g = np.fft.rfft(self.pairs.astype(float), n)
        self.triples = np.fft.irfft(f * g, n)[: len(have)] > 0.5
        self.fresh = True

    def _pair(self, gap: int, left: np.ndarray) -> tuple[int, ...] | None:
        x = np.arange((gap + 1) // 2, gap)
        fits = (left[x] > 0) & (left[gap - x] > np.where(2 * x == gap, 1, 0))
        at = int(fits.argmax()) if len(fits) else 0
        return (int(x[at]), gap - int(x[at])) if len(fits) and fits[at] else None

    def find(self, gap: int, without: int) -> tuple[int, ...] | None:
        """At most three sizes that add up to gap when one item of size `without` is taken; None if there are none."""
        left = self.left
        left[without] -= 1
        try:
            if left[gap] > 0:
                return (gap,)
            if self.pairs[gap] and (p := self._pair(gap, left)):
                return p
            while self.triples[gap]:
                x = np.arange(gap - 2, 0, -1)
                for a in x[(left[x] > 0) & self.pairs[gap - x]].tolist():
                    left[a] -= 1
                    p = self._pair(gap - a, left)
                    left[a] += 1
                    if p:
                        return (a, *p)
                if self.fresh:
                    return None
                self.build()
            return None
        finally:
            left[without] += 1


def _content(sizes: tuple[int, ...]) -> Content:
    return tuple((s, sizes.count(s)) for s in sorted(set(sizes), reverse=True))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Content, int]]:
    """(what is in a box, how many such boxes). Sizes run from 1 to capacity; every item is in exactly one box."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        left[size] = n
    out: list[tuple[Content, int]] = []
    if left[capacity]:
        out.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    sums = Sums(left)
    # large sizes are the hardest to place, so they choose their complements first
    for a in range(capacity - 1, 0, -1):
        while left[a] and (found := sums.find(capacity - a, a)):
            content = _content((a, *found))
            n = min(int(left[s]) // k for s, k in content)
            for s, k in content:
                left[s] -= k * n
            sums.fresh = False
            out.append((content, n))
    return out + _best_fit(left, capacity)


def _with(content: Content, size: int) -> Content:
    """The content with one more item of a size not larger than those in it."""
    return (*content[:-1], (size, content[-1][1] + 1)) if content and content[-1][0] == size else (*content, (size, 1))


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[Content, int]]:
    """Best-fit decreasing over sizes with counts: boxes of one content are handled together."""
    open_: list[tuple[int, Content]] = []
    boxes: dict[Content, int] = {}
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            k = bisect_right(open_, size - 1, key=lambda x: x[0])
            if k < len(open_):
                gap, content = open_.pop(k)
                count = boxes.pop(content)
                take = min(n, count)
                if count > take:
                    boxes[content] = count - take
                    insort(open_, (gap, content))
                grown, room = _with(content, size), gap - size
            else:
                # as many of this size as fit together
                each = max(1, min(capacity // size, n))
                take = n // each
                grown, room = ((size, each),), capacity - size * each
                n -= take * each
                boxes[grown] = boxes.get(grown, 0) + take
                if room and not any(c == grown for _, c in open_):
                    insort(open_, (room, grown))
                continue
            n -= take
            if grown in boxes:
                boxes[grown] += take
            else:
                boxes[grown] = take
                if room:
                    insort(open_, (room, grown))
    return list(boxes.items())


#: Most rows of a plan that are broadcast; a longer one is shuffled.
ROWS = 200_000


def _slots(spark: SparkSession, boxes: list[tuple[Content, int]]) -> DataFrame:
    """(size, from_, until, box, each): items of `size` at positions from_..until-1 go to boxes box, box+1, ... of the plan, `each` to a box."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for content, n in boxes:
        for s, each in content:
            at = used.get(s, 0)
            rows.append((s, at, at + n * each, first, each))
            used[s] = at + n * each
        first += n
    slots = spark.createDataFrame(rows, "size int, from_ bigint, until bigint, box bigint, each bigint")
    return F.broadcast(slots) if len(rows) <= ROWS else slots


def pack(items: DataFrame, node: str, size: str, capacity: int) -> DataFrame:
    """(node, part, size, box, whole): the box of every part of every item.

    An item within the capacity has one part, part 0. A larger one is divided: its parts of full capacity fill a box each
    and only its rest, if any, is packed. Boxes are numbered from 0. Items of size 0 or NULL need no box and get NULL;
    `node` must not repeat. Ties between equal sizes are settled by `node`. `whole` says that the item isn't divided.
    """
    spark = items.sparkSession
    own = items.select(F.col(node).alias("node"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("all")).withColumn("full", F.expr(f"all div {capacity}")).withColumn("rest", (F.col("all") % capacity).cast("int"))
    own = written(own, "items")
    # at most `capacity` rows
    histogram = {r["rest"]: r["n"] for r in own.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    boxes = plan(histogram, capacity)
    first = sum(n for _, n in boxes)
    placed = positions(own.where("rest > 0").select("node", "all", "full", "rest"), ["rest"], [F.col("node")], "nth")
    hit = placed.join(_slots(spark, boxes), (F.col("rest") == F.col("size")) & (F.col("nth") - 1 >= F.col("from_")) & (F.col("nth") - 1 < F.col("until")))
    rests = hit.select("node", F.col("full").cast("int").alias("part"), F.col("rest").alias("size"), (F.col("box") + F.floor((F.col("nth") - 1 - F.col("from_")) / F.col("each"))).alias("box"), (F.col("full") == 0).alias("whole"))
    large = positions(own.where("full > 0").select("node", "rest", "full").withColumn("one", F.lit(0)), ["one"], [F.col("node")], "through", weight=F.col("full"))
    fulls = large.select("node", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("part"), "through", "full", "rest").select("node", "part", F.lit(capacity).alias("size"), (F.lit(first) + F.col("through") - F.col("full") + F.col("part")).alias("box"), ((F.col("full") == 1) & (F.col("rest") == 0)).alias("whole"))
    none = own.where("all = 0").select("node", F.lit(0).alias("part"), F.lit(0).alias("size"), F.lit(None).cast("bigint").alias("box"), F.lit(True).alias("whole"))
    return rests.unionByName(fulls).unionByName(none).withColumnRenamed("node", node)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: boxes, tokens and the share of the boxes' room that is filled."""
    boxes = packed.where("box IS NOT NULL").groupBy("box").agg(F.sum("size").alias("used"))
    return boxes.agg(F.count("*").alias("boxes"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest")).withColumn("filled", F.col("tokens") / (F.col("boxes") * capacity))
