"""Publishing several tables at once, and reading whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Write all tables under a new version and then switch to it; readers see all of the old tables or all of the new.

    A failure before the switch leaves the old version in place. The marker is a file written beside its name and renamed.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    temporary, fs = _path(spark, f"{folder}/next-{version}")
    out = fs.create(temporary, True)
    out.write(version.encode())
    out.close()
    marker, _ = _path(spark, f"{folder}/current")
    if fs.exists(marker):
        fs.delete(marker, False)
    fs.rename(temporary, marker)
    return version


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the version published last."""
    version = spark.read.text(f"{folder}/current", wholetext=True).first()[0].strip()
    return spark.read.parquet(f"{folder}/{version}/{name}")


def whole_texts(spark: SparkSession, paths: str) -> DataFrame:
    """(path, text) of stored text files, one row per file."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
