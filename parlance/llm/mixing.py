"""Mixing sources to target weights by systematic sampling.

Each record's expected copies are its source's rate. A prefix sum of the rates in each source, in an order fixed by hashes, and one
random offset give the copies: one for every integer boundary that the sum crosses, so that each record's chances are those of its
rate. A source of any size is summed by `positions` over many tasks.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ranking import positions

#: Most sources with a target; targets are read by the driver.
SOURCES = 10_000
UNIT = 2**40


def rates(totals: dict[str, float], targets: dict[str, tuple[float, int]]) -> tuple[dict[str, float], float]:
    """Rate of each source and the total size of the mix.

    The total is the largest at which every source with text can bear its share within its cap. Shares of sources without
    any text are shared out among the others in proportion. A rate is at most the cap.
    """
    usable = {s: (w, cap) for s, (w, cap) in targets.items() if w > 0 and cap > 0 and totals.get(s, 0) > 0}
    weight = sum(w for w, _ in usable.values())
    if not usable:
        return {}, 0.0
    total = min(cap * totals[s] * weight / w for s, (w, cap) in usable.items())
    return {s: min(float(cap), total * w / weight / totals[s]) for s, (w, cap) in usable.items()}, total


def mix(records: DataFrame, node: str, source: str, size: str, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(node, source, size, copies) of every record that is drawn.

    targets: (source, target_share, max_repeats). Records of sources without a target, of NULL source, or of no size are
    not drawn. copies never exceeds max_repeats.
    """
    spark = records.sparkSession
    rows = targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("cap")).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    wanted = {r["source"]: (float(r["w"]), int(r["cap"])) for r in rows}
    own = records.select(F.col(node).alias("node"), F.col(source).alias("source"), F.col(size).cast("long").alias("size")).where("size > 0")
    sums = own.where(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum("size").alias("t")).collect()
    rate, _ = rates({r["source"]: float(r["t"]) for r in sums}, wanted)
    draw = random.Random(seed)
    # rates and offsets in units of 2^-40, so that prefix sums are exact whatever the order of addition
    names = sorted(rate)
    scaled = {s: int(rate[s] * UNIT) for s in names}
    known = F.broadcast(spark.createDataFrame([(s, scaled[s], int(draw.random() * UNIT)) for s in names], "source string, rate bigint, offset bigint"))
    placed = positions(own.join(known, "source"), ["source"], [F.col("size"), F.xxhash64("node"), F.col("node")], "nth")
    rate_, unit = F.col("rate").cast("decimal(18,0)"), F.lit(UNIT).cast("decimal(18,0)")
    until = F.col("nth").cast("decimal(18,0)") * rate_ + F.col("offset").cast("decimal(18,0)")
    copies = F.floor(until / unit).cast("bigint") - F.floor((until - rate_) / unit).cast("bigint")
    drawn = placed.withColumn("copies", copies.cast("int")).where("copies > 0")
    return drawn.select(F.col("node").alias(node), F.col("source").alias(source), F.col("size").alias(size), "copies")


def shares(mixed: DataFrame, source: str, size: str, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, repeats): what each target source contributes; repeats is the most copies of one record."""
    got = mixed.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(size) * F.col("copies")).alias("tokens"), F.max("copies").alias("repeats"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    rows = targets.select("source", "target_share").where("source IS NOT NULL").join(got, "source", "left").crossJoin(F.broadcast(whole))
    return rows.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("whole")).alias("share"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
