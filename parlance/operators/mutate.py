"""Changes to keyed tables as copy-on-write transforms, and checks of their constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.operators.ranking import positions


def insert_or_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is unknown are added; of rows that repeat a key any one."""
    first = new.dropDuplicates(keys)
    return base.unionByName(first.join(base.select(*keys), keys, "left_anti"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Changed rows replace those of their key, others are added; of several changes the latest version counts."""
    if version:
        w = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last())
        changes = changes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def update_where(base: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return base.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_by_key(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with a change take its columns, also where they are NULL."""
    marked = changes.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = base.join(marked, key, "left")
    return joined.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*base.columns)


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    return base.where(~F.coalesce(condition, F.lit(False)))


def cascade(children: DataFrame, foreign: str, parents: DataFrame, key: str) -> DataFrame:
    """Children of parents that still exist, and those without a parent."""
    kept = parents.select(F.col(key).alias(foreign)).distinct()
    return children.where(F.col(foreign).isNull()).unionByName(children.join(kept, foreign, "left_semi").select(*children.columns))


def set_null(children: DataFrame, foreign: str, parents: DataFrame, key: str) -> DataFrame:
    kept = parents.select(F.col(key).alias(foreign)).distinct().withColumn("__have", F.lit(True))
    return children.join(kept, foreign, "left").withColumn(foreign, F.when(F.col("__have"), F.col(foreign))).select(*children.columns)


def check_violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, rule) for every row that breaks a rule; NULL breaks it too."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def insert_numbered(base: DataFrame, new: DataFrame, group: str, number: str, order: list[Column]) -> DataFrame:
    """new with `number` counting on from the greatest in its group; groups may hold any share of the rows. NULL groups are left out."""
    most = base.where(F.col(group).isNotNull()).groupBy(group).agg(F.max(number).alias("__most"))
    placed = positions(new.where(F.col(group).isNotNull()), [group], order, "__at")
    return placed.join(most, group, "left").withColumn(number, F.col("__at") + F.coalesce("__most", F.lit(0))).drop("__at", "__most")
