"""Event streams folded into final messages.

Events are (stream_id, seq, type, content, tokens) of types chunk, usage, done and error. A stream that ends in error loses its
text; usage counts if it came, otherwise tokens are estimated from the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.functions.text import token_estimate
from parlance.operators.ranking import positions

OUTPUT = "stream_id string, status string, text string, tokens int"
_STATE = "body string, used bigint, status string"


def fold_batch(events: DataFrame) -> DataFrame:
    """(stream_id, status, text, tokens) of whole streams; events repeated by (stream_id, seq) count once."""
    once = events.dropDuplicates(["stream_id", "seq"])
    chunks = F.array_sort(F.collect_list(F.when(F.col("type") == "chunk", F.struct("seq", F.coalesce("content", F.lit("")).alias("c")))))
    folded = once.groupBy("stream_id").agg(
        F.array_join(F.transform(chunks, lambda x: x["c"]), "").alias("body"),
        F.coalesce(F.sum(F.when(F.col("type") == "usage", F.col("tokens"))), F.lit(0)).alias("used"),
        F.max_by("type", F.when(F.col("type").isin("done", "error"), F.col("seq"))).alias("end"),
    )
    text = F.when(F.col("end") == "error", "").otherwise(F.col("body"))
    status = F.when(F.col("end").isin("done", "error"), F.col("end")).otherwise("streaming")
    return folded.select(F.col("stream_id").cast("string").alias("stream_id"), status.alias("status"), text.alias("text"), F.when(F.col("used") > 0, F.col("used")).otherwise(token_estimate(text)).cast("int").alias("tokens"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    body, used, status = state.get if state.exists else ("", 0, "streaming")
    for pdf in batches:
        for e in pdf.sort_values("seq").itertuples():
            if status != "streaming":
                break
            if e.type == "chunk":
                body += e.content or ""
            elif e.type == "usage":
                used += int(e.tokens or 0)
            elif e.type in ("done", "error"):
                status = e.type
    state.update((body, used, status))
    text = "" if status == "error" else body
    size = len(text.encode("utf-8"))
    yield pd.DataFrame([{"stream_id": str(key[0]), "status": status, "text": text, "tokens": used or (max(1, size // 4) if size else 0)}])


def fold_stream(events: DataFrame) -> DataFrame:
    """The same over a streaming frame in update mode: the latest row of a stream is its state. Terminal events freeze it."""
    return events.groupBy("stream_id").applyInPandasWithState(_fold, OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame, job: str, order: str, total: str) -> DataFrame:
    """(job, done, percent) after each completion; a job may hold any share of the rows."""
    placed = positions(events.select(job, order, total), [job], [F.col(order)], "done")
    return placed.withColumn("percent", F.floor(F.col("done") * 100 / F.col(total)).cast("int"))


#: What ends a stream, by precedence where several come at once.
ENDS = ("cancel", "error", "done")


def retries(events: DataFrame) -> DataFrame:
    """(stream_id, again): whether a stream that fails may be tried again: only if no chunk was sent before its first error."""
    first = lambda kind: F.min(F.when(F.col("type") == kind, F.col("seq")))
    found = events.groupBy("stream_id").agg(first("error").alias("e"), first("chunk").alias("c"))
    return found.select("stream_id", (F.col("e").isNotNull() & (F.col("c").isNull() | (F.col("c") > F.col("e")))).alias("again"))


def states(events: DataFrame) -> DataFrame:
    """(stream_id, state, chunks, last_seq): idle, pending before the first chunk, streaming, or what the first end made of it.

    What comes after the first end doesn't count. Only counts and places are folded, so streams of any length are summed in parts.
    """
    ends = F.col("type").isin(*ENDS)
    rank = F.array_position(F.array(*[F.lit(x) for x in ENDS]), F.col("type"))
    first = events.where(ends).groupBy("stream_id").agg(F.min(F.struct("seq", rank.alias("rank"), F.col("type").alias("end"))).alias("x")).select("stream_id", F.col("x.seq").alias("until"), F.col("x.end").alias("end"))
    live = events.join(first, "stream_id", "left").where(F.col("until").isNull() | (F.col("seq") <= F.col("until")))
    found = live.groupBy("stream_id").agg(F.count_if(F.col("type") == "chunk").alias("chunks"), F.max("seq").alias("last_seq"), F.max("end").alias("end"))
    state = F.when(F.col("end") == "cancel", "cancelled").when(F.col("end") == "error", "error").when(F.col("end") == "done", "idle").when(F.col("chunks") > 0, "streaming").otherwise("pending")
    return found.select("stream_id", state.alias("state"), "chunks", "last_seq")


def coalesced(events: DataFrame, size: int) -> DataFrame:
    """(stream_id, flush, chunks, bytes): the chunks of a stream in flushes of at least `size` bytes: the flush of a chunk is
    the number of whole sizes sent before it. A stream may hold any share of the rows."""
    chunks = events.where("type = 'chunk'").select("stream_id", "seq", F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("bytes"))
    placed = positions(chunks, ["stream_id"], [F.col("seq")], "through", weight=F.col("bytes"))
    return placed.groupBy("stream_id", F.floor((F.col("through") - F.col("bytes")) / size).alias("flush")).agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"))


def upsert_sink(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch's latest rows replace those of their key in a parquet table of versions.

    Every batch writes the next version beside the last and is skipped if it is there already, so a repeated batch changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = lambda n: f"{folder}/version={n}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path(number)}/_SUCCESS")
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return
        rows = batch if number == 0 else spark.read.parquet(path(number - 1)).join(batch.select(key), key, "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(path(number))

    return write
