"""Conversations from message rows.

Rows are sessionized by channel: sorted, split where a gap of inactivity lies between neighbours, their roles read and, if
wanted, inferred, and conversations without reciprocal replies dropped, all in one path. A channel may hold any share of
all rows: counts are pre-aggregated, and positions come from `positions`, which spreads a channel over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.ranking import positions
from parlance.session import written


def role_of(c: Column) -> Column:
    """Lower case without outer white space; NULL stays NULL."""
    return F.lower(F.regexp_replace(c, "(?U)^\\s+|\\s+$", ""))


def conversations(rows: DataFrame, channel: str, node: str, role: str, order: list[str], usable: str, clock: str | None = None, seconds: float = float("inf"), infer: bool = False) -> DataFrame:
    """The turns of kept conversations: (channel, part, turn_no, node, role), turn_no from 1.

    Rows of role system are no turns. A channel is split where neighbours lie more than `seconds` apart by `clock`; part
    counts from 0 the gaps before. Without a clock, or where the gap is infinite, a channel is one conversation. A
    conversation is kept if all its turns are of role user or assistant and `usable` (boolean; NULL is false), strictly
    alternate from user to assistant and end with assistant. With `infer`, a turn without either role takes the one that
    answers its neighbour before, or else the one its neighbour after answers. Rows without a channel are dropped. Rows that
    tie in `order` are settled by `node`. NULLs in `order` come first.
    """
    names = {"__channel": F.col(channel), "__node": F.col(node), "__role": role_of(F.col(role)), "__usable": F.coalesce(F.col(usable), F.lit(False))} | {f"__k{i}": F.col(c) for i, c in enumerate(order)}
    split = clock is not None and seconds != float("inf")
    if split:
        names["__clock"] = F.col(clock)
    turns = rows.select(*[c.alias(n) for n, c in names.items()]).where("__channel IS NOT NULL AND NOT (__role <=> 'system')")
    by = [F.col(f"__k{i}") for i in range(len(order))] + [F.col("__node")]
    if not split and not infer:
        # what is dropped for its rows alone needs no place
        user, assistant = F.col("__role").eqNullSafe("user"), F.col("__role").eqNullSafe("assistant")
        counts = turns.groupBy("__channel").agg(F.count_if(user).alias("u"), F.count_if(assistant).alias("a"), F.count_if(~((user | assistant) & F.col("__usable"))).alias("bad"))
        turns = turns.join(counts.where("bad = 0 AND u = a").select("__channel"), "__channel", "left_semi")
    placed = written(positions(turns, ["__channel"], by, "__at").select("__channel", "__node", "__role", "__usable", "__at", *(["__clock"] if split else [])), "turns")
    if split or infer:
        placed = _with_neighbours(placed, split)
        if infer:
            known = F.col("__role").isin("user", "assistant")
            answer = F.when(F.col("__before") == "user", "assistant").when(F.col("__before") == "assistant", "user").when(F.col("__after") == "assistant", "user").when(F.col("__after") == "user", "assistant")
            placed = placed.withColumn("__role", F.when(known, F.col("__role")).otherwise(F.coalesce(answer, F.col("__role"))))
        new = F.coalesce(F.col("__gap") > seconds, F.lit(False)) if split else F.lit(False)
        placed = written(placed.select("__channel", "__node", "__role", "__usable", "__at", new.cast("long").alias("__new")), "flagged")
    if split:
        placed = written(positions(placed, ["__channel"], [F.col("__at")], "__part", weight=F.col("__new")).drop("__new"), "parts")
        first = placed.groupBy("__channel", "__part").agg(F.min("__at").alias("__first"))
        placed = placed.join(first, ["__channel", "__part"]).withColumn("__turn", F.col("__at") - F.col("__first") + 1)
    else:
        placed = placed.withColumn("__part", F.lit(0).cast("long")).withColumn("__turn", F.col("__at"))
    # an even number of turns that alternate from user on ends with assistant
    right = F.col("__role").eqNullSafe(F.when(F.col("__turn") % 2 == 1, "user").otherwise("assistant")) & F.col("__usable")
    wrong = placed.groupBy("__channel", "__part").agg(F.count_if(~right).alias("bad"), (F.max("__turn") % 2).alias("odd")).where("bad > 0 OR odd = 1").select("__channel", "__part")
    kept = placed.join(wrong, ["__channel", "__part"], "left_anti")
    return kept.select(F.col("__channel").alias(channel), F.col("__part").cast("int").alias("part"), F.col("__turn").cast("int").alias("turn_no"), F.col("__node").alias(node), F.col("__role").alias("role"))


def _with_neighbours(placed: DataFrame, clock: bool) -> DataFrame:
    """placed with __before, __after (roles of the neighbours) and, if there is a clock, __gap to the one before in seconds."""
    more = ["__clock"] if clock else []
    before = placed.select("__channel", (F.col("__at") + 1).alias("__at"), F.col("__role").alias("__before"), *[F.col(c).alias("__past") for c in more])
    after = placed.select("__channel", (F.col("__at") - 1).alias("__at"), F.col("__role").alias("__after"))
    both = placed.join(before, ["__channel", "__at"], "left").join(after, ["__channel", "__at"], "left")
    return both.withColumn("__gap", _seconds("__clock") - _seconds("__past")) if clock else both


def _seconds(clock: str) -> Column:
    return F.unix_seconds(F.col(clock).cast("timestamp"))


def gap_histogram(rows: DataFrame, channel: str, node: str, role: str, order: list[str], clock: str) -> DataFrame:
    """(bin, n, replies): gaps between neighbours of a channel in seconds by power of two, and how many of them lie between a
    user's turn and the assistant's that answers it; bin -1 for clocks that run back. All rows count but those of role system."""
    turns = rows.select(F.col(channel).alias("__channel"), F.col(node).alias("__node"), role_of(F.col(role)).alias("__role"), F.col(clock).alias("__clock"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(order)])
    turns = turns.where("__channel IS NOT NULL AND NOT (__role <=> 'system')")
    placed = written(positions(turns, ["__channel"], [*[F.col(f"__k{i}") for i in range(len(order))], F.col("__node")], "__at").select("__channel", "__role", "__at", "__clock"), "placed")
    before = placed.select("__channel", (F.col("__at") + 1).alias("__at"), F.col("__role").alias("__before"), F.col("__clock").alias("__past"))
    pairs = placed.join(before, ["__channel", "__at"]).select((_seconds("__clock") - _seconds("__past")).alias("gap"), ((F.col("__before") == "user") & (F.col("__role") == "assistant")).alias("reply")).where("gap IS NOT NULL")
    return pairs.groupBy(F.when(F.col("gap") < 0, -1).when(F.col("gap") == 0, 0).otherwise(F.floor(F.log2("gap")).cast("int") + 1).alias("bin")).agg(F.count("*").alias("n"), F.count_if("reply").alias("replies"))


#: Share of the replies that a gap may tear from what they answer.
TORN = 0.001


def calibrated_gap(histogram: DataFrame) -> float:
    """Seconds that separate pauses inside a conversation from those between two: the split of the log histogram with the
    largest variance between its sides, among those that tear at most TORN of the replies from what they answer. The
    histogram has at most 66 bins, so the driver reads it whole. Infinite if there is no such split."""
    bins = sorted((r["bin"], r["n"], r["replies"]) for r in histogram.where("bin > 0").collect())
    total, mean, replies = sum(n for _, n, _ in bins), sum(b * n for b, n, _ in bins), sum(r for *_, r in bins)
    best, cut, n0, s0, whole = -1.0, float("inf"), 0, 0, 0
    for b, n, r in bins[:-1]:
        n0, s0, whole = n0 + n, s0 + b * n, whole + r
        between = n0 * (total - n0) * (s0 / n0 - (mean - s0) / (total - n0)) ** 2
        if between > best and replies - whole <= TORN * replies:
            best, cut = between, float(2**b)
    return cut
