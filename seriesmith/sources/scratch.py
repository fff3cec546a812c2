"""Cutting long lineages with tables written to the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode its warehouse where that is unset.

    A warehouse may be a folder of one machine, so a cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and continue from the files.

    Used where several branches of a query start from the same expensive table: the work
    behind it runs once, lost executors re-read files instead of recomputing, later scans
    prune columns, and the optimizer sees the true size before it decides on a broadcast.

    Tables lie under ``seriesmith/<application id>`` and can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/seriesmith/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
