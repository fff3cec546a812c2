"""Bar tables on disk: ``symbol=/tf=`` partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = (
    "timestamp timestamp, open double, high double, low double, close double, volume double, "
    "symbol string, tf string"
)


def write_bars(bars: DataFrame, path: str) -> None:
    """Long bar table (``symbol, tf, t, ..``) to partitioned Parquet, clustered by series."""
    out = bars.withColumn("timestamp", F.timestamp_seconds("t")).select(
        "timestamp", "open", "high", "low", "close", "volume", "symbol", "tf")
    out.repartition("symbol", "tf").sortWithinPartitions("symbol", "tf", "timestamp").write.partitionBy(
        "symbol", "tf").parquet(path)


def read_bars(spark: SparkSession, path: str, symbols=None, tfs=None, benchmark: str | None = None) -> DataFrame:
    """Bars of the wanted series (benchmark always included); absent series give no rows.

    The filters are on partition columns, so other series are not listed or read.
    """
    df = spark.read.schema(BAR_SCHEMA).parquet(path)
    if symbols is not None:
        wanted = sorted({*symbols, *([benchmark] if benchmark else [])})
        df = df.filter(F.col("symbol").isin(wanted))
    if tfs is not None:
        df = df.filter(F.col("tf").isin(list(tfs)))
    return df.withColumn("t", F.unix_seconds("timestamp"))


def from_exchange_rows(rows: DataFrame, keys=("symbol", "tf"), seq="ingest_seq") -> DataFrame:
    """Epoch-millisecond rows: timestamps, one row per bar (the first that arrived)."""
    from ..operators.bars import dedupe_first

    r = rows.withColumn("ts", F.timestamp_millis("epoch_ms"))
    return dedupe_first(r, [*keys, "ts"], seq)
