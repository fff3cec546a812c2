"""Report datasets over a trade table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, div


def month_matrix(trades: DataFrame, keys, year: Column, month: Column, start: float) -> DataFrame:
    """Year x month returns in percent with a year total; empty months are zero."""
    pct = F.sum("pnl_abs") / float(start) * 100
    rows = trades.groupBy(*keys, year.alias("year"), month.alias("__m")).agg(pct.alias("__p"))
    cells = [
        F.coalesce(F.sum(F.when(F.col("__m") == m, F.col("__p"))), F.lit(0.0)).alias(f"m{m:02d}")
        for m in range(1, 13)
    ]
    return rows.groupBy(*keys, "year").agg(*cells, F.sum("__p").alias("year_total"))


def side_stats(trades: DataFrame, keys) -> DataFrame:
    """Long against short: counts, win rate, profit, average, share of all trades."""
    per = trades.groupBy(*keys, "direction").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("pnl_abs") > 0) / F.count(F.lit(1)) * 100).alias("win_rate"),
        F.sum("pnl_abs").alias("pnl"),
        F.avg("pnl_abs").alias("avg_pnl"),
    )
    whole = Window.partitionBy(*keys)
    return per.withColumn("share", F.col("n") / F.sum("n").over(whole))


def contribution(trades: DataFrame, key: str) -> DataFrame:
    """Profit per key, signed and as percent of the sum of absolute profits."""
    per = trades.groupBy(key).agg(F.sum("pnl_abs").alias("pnl"))
    total = per.agg(F.sum(F.abs("pnl"))).scalar()
    return per.withColumn("__t", total).select(
        key, "pnl", F.coalesce(div(F.col("pnl"), F.col("__t")) * 100, F.lit(0.0)).alias("share_pct")
    )


def reason_counts(trades: DataFrame, keys) -> DataFrame:
    return trades.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def timing_grid(entries: DataFrame, weekday: Column, hour: Column) -> DataFrame:
    """Entries per weekday (Monday 0) and hour; all 168 cells are present."""
    seen = entries.groupBy(weekday.alias("weekday"), hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    cell = F.explode(F.sequence(F.lit(0), F.lit(167)))
    grid = entries.sparkSession.range(1).select(cell.alias("c")).select(
        F.floor(F.col("c") / 24).cast("int").alias("weekday"), (F.col("c") % 24).cast("int").alias("hour")
    )
    return grid.join(seen, ["weekday", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def histogram(rows: DataFrame, keys, value, width: float) -> DataFrame:
    """Counts per bin of explicit width; ``bin`` is the lower edge."""
    b = (F.floor(col(value) / width) * width).cast("double").alias("bin")
    return rows.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("n"))


def parameter_matrix(params: DataFrame, series: str, names, columns) -> DataFrame:
    """One row per parameter, one column per series."""
    long = params.select(series, *[F.col(n).cast("double").alias(n) for n in names])
    return long.unpivot(series, list(names), "param", "value").groupBy("param").pivot(
        series, list(columns)).agg(F.first("value"))
