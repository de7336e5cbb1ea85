"""Latest version per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, payload: dict[str, Column], key: str = "id", version: str = "updated_at", keep: Column | None = None) -> DataFrame:
    """One row per `key` with `payload` of its latest `version`.

    `keep` marks rows of interest: other rows still take part in choosing the latest version, but travel without
    payload, so that wide text is shuffled for rows of interest only. Rows whose latest version isn't of interest are
    left out. Keys that are NULL are no identity and are left out. A NULL version is older than any other; versions
    that tie are settled by the largest payload, so that the result doesn't depend on arrival order.
    """
    body = F.struct(*[c.alias(n) for n, c in payload.items()])
    if keep is not None:
        body = F.when(keep, body)
    return (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("__key"), F.struct(F.col(version).alias("v"), body.alias("b")).alias("__row"))
        .groupBy("__key")
        .agg(F.max("__row").alias("__row"))
        .where(F.col("__row.b").isNotNull())
        .select(F.col("__key").alias(key), *[F.col(f"__row.b.{n}").alias(n) for n in payload])
    )
