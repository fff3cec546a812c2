"""Building, cleaning and resampling bar tables.

A bar table has ``symbol, t, open, high, low, close, volume``; ``t`` is the open time of
the bar in epoch seconds (UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, div_floor, epoch

WIDTH = {"1h": 3600, "4h": 4 * 3600, "8h": 8 * 3600, "1d": 24 * 3600}
PRICES = ["open", "high", "low", "close", "volume"]


def bucket(t, width: int):
    return (div_floor(t, width) * width).cast("bigint")


def arrival(ts: str, seq: str):
    """Order of ticks as one number: microseconds, then ``seq`` (>= 0).

    Unlike a struct it has a fixed width, so first / last prices are hash aggregates and
    the ticks are not sorted before they are reduced.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(19,0)")
    return us * F.lit(str(10 ** 19)).cast("decimal(20,0)") + F.col(seq).cast("decimal(19,0)")


def ticks_to_bars(ticks: DataFrame, width=WIDTH["1h"], keys=("symbol",)) -> DataFrame:
    """Ticks ``(keys.., ts, seq, price)`` to bars; ties in time are broken by ``seq``."""
    at = arrival("ts", "seq")
    return (
        ticks.withColumn("t", bucket(epoch("ts"), width))
        .groupBy(*keys, "t")
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def resample(bars: DataFrame, width: int, keys=("symbol",)) -> DataFrame:
    """Slower bars from faster ones: first open, highest high, lowest low, last close."""
    return (
        bars.withColumn("__t", bucket("t", width))
        .groupBy(*keys, "__t")
        .agg(
            F.min_by("open", "t").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "t").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("__t", "t")
    )


def dedupe_first(rows: DataFrame, keys, seq: str) -> DataFrame:
    """One row per key, the one with the smallest ``seq``; a map-side aggregate, so a key
    with very many copies is reduced before the shuffle.  ``seq`` must differ within a key."""
    rest = [c for c in rows.columns if c not in keys]
    # one buffer of fixed width per column keeps this a hash aggregate; all move together
    best = rows.groupBy(*keys).agg(*[F.min_by(c, seq).alias(c) if c != seq else F.min(seq).alias(seq) for c in rest])
    return best.select(*keys, *rest)


def with_benchmark(bars: DataFrame, symbols, benchmark: str) -> DataFrame:
    """Requested symbols plus the benchmark, each once."""
    return bars.filter(F.col("symbol").isin(sorted({*symbols, benchmark})))


def lookback(bars: DataFrame, as_of, hours: int) -> DataFrame:
    """Bars not older than ``hours`` before an explicit moment (epoch seconds)."""
    return bars.filter(col("t") >= F.lit(as_of) - hours * 3600)


def lookback_from_latest(bars: DataFrame, hours: int) -> DataFrame:
    """``lookback`` anchored at the newest bar of the table (a one-row aggregate)."""
    newest = bars.agg(F.max("t")).scalar()
    return bars.filter(F.col("t") >= newest - hours * 3600)


def prefer_source(primary: DataFrame, secondary: DataFrame, keys=("symbol", "tf")) -> DataFrame:
    """Primary rows, plus secondary rows of the keys the primary source lacks."""
    have = primary.select(*keys).distinct()
    return primary.unionByName(secondary.join(have, list(keys), "left_anti"))


def stack_timeframes(bars: DataFrame, frames=("1h", "4h", "8h", "1d")) -> DataFrame:
    """One long table over several timeframes with a ``tf`` column."""
    out = None
    for tf in frames:
        part = bars if tf == "1h" else resample(bars, WIDTH[tf])
        part = part.select("symbol", F.lit(tf).alias("tf"), "t", *PRICES)
        out = part if out is None else out.unionByName(part)
    return out
