"""Equity curves, drawdowns, streaks and daily series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, div
from .scan import Run, full_mean, full_std, rolling, running


def snap(c: Column) -> Column:
    """Remove summation noise: money is known to a hundredth, so six places are exact and
    an equity that returns to its peak equals it."""
    return F.rint(c * 1e6) / 1e6


def equity_curve(rows: DataFrame, keys, path, order, start: float, pnl="pnl_abs") -> DataFrame:
    """Add ``equity``, ``peak`` (start included) and ``drawdown`` (percent, <= 0).

    One window per block yields the prefix sum and its running maximum; block totals and
    block maxima are then scanned over the much smaller block table.
    """
    order = [col(o) for o in order]
    w = Window.partitionBy(*keys, *path).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__s", F.sum(pnl).over(w)).withColumn("__t", F.max("__s").over(w))
    blocks = local.groupBy(*keys, *path).agg(F.sum(pnl).alias("__sum"), F.max("__t").alias("__top"))
    up, last = path[:-1], [path[-1]]
    blocks = running(blocks, keys, up, last, {"__off": Run("sum", F.col("__sum"))}, exclusive=True)
    blocks = blocks.withColumn("__off", F.coalesce("__off", F.lit(0.0)))
    blocks = running(
        blocks, keys, up, last, {"__pk": Run("max", F.col("__off") + F.col("__top"))}, exclusive=True
    ).select(*keys, *path, "__off", "__pk")
    out = local.join(blocks, [*keys, *path]).withColumns({
        "equity": snap(F.lit(float(start)) + F.col("__off") + F.col("__s")),
        "peak": snap(F.lit(float(start)) + F.greatest(F.lit(0.0), F.col("__pk"), F.col("__off") + F.col("__t"))),
    })
    return out.withColumn("drawdown", div(F.col("equity") - F.col("peak"), "peak") * 100).drop(
        "__s", "__t", "__off", "__pk"
    )


def drawdown_summary(curve: DataFrame, keys) -> DataFrame:
    """Deepest drawdown and mean over the rows that are under water."""
    dd = F.col("drawdown")
    return curve.groupBy(*keys).agg(
        F.coalesce(F.min(dd), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.avg(F.when(dd < 0, dd)), F.lit(0.0)).alias("avg_drawdown"),
    )


def ratio_or_zero(mean: Column, std: Column, periods: float) -> Column:
    return F.coalesce(F.when(std > 1e-12, mean / std * math.sqrt(periods)), F.lit(0.0))


def sharpe_per_trade(curve: DataFrame, keys, pnl="pnl_abs", periods=252) -> DataFrame:
    """Mean over sample deviation of per-trade equity returns."""
    r = div(col(pnl), F.col("equity") - col(pnl))
    return curve.groupBy(*keys).agg(
        ratio_or_zero(F.avg(r), F.stddev_samp(r), periods).alias("sharpe_trade")
    )


def daily_equity(trades: DataFrame, keys, start: float, day="exit_day", pnl="pnl_abs") -> DataFrame:
    """Dense daily curve from the first to the last exit day of each key.

    Trades are reduced to one row per day before anything is ordered, so the windows below
    see at most one row per calendar day.
    """
    per_day = trades.groupBy(*keys, F.col(day).alias("day")).agg(
        F.sum(pnl).alias("pnl"), F.count(F.lit(1)).alias("n_trades")
    )
    span = per_day.groupBy(*keys).agg(F.min("day").alias("__lo"), F.max("day").alias("__hi"))
    grid = span.select(*keys, F.explode(F.sequence("__lo", "__hi")).alias("day"))
    full = grid.join(per_day, [*keys, "day"], "left").withColumns({
        "pnl": F.coalesce("pnl", F.lit(0.0)), "n_trades": F.coalesce("n_trades", F.lit(0)),
    })
    w = Window.partitionBy(*keys).orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("equity", snap(F.lit(float(start)) + F.sum("pnl").over(run)))
    return full.withColumns({
        "peak": F.greatest(F.lit(float(start)), F.max("equity").over(run)),
        "prev": F.lag("equity").over(w),
    }).withColumns({
        "drawdown": div(F.col("equity") - F.col("peak"), "peak") * 100,
        "ret": div(F.col("equity"), "prev") - 1,
    }).drop("prev")


def daily_ratios(daily: DataFrame, keys, backtest_days=None, periods=365, min_days=30) -> DataFrame:
    """Sharpe and Sortino of the dense daily curve."""
    r = F.col("ret")
    out = daily.groupBy(*keys).agg(
        ratio_or_zero(F.avg(r), F.stddev_samp(r), periods).alias("sharpe_daily"),
        ratio_or_zero(F.avg(r), F.stddev_samp(F.when(r < 0, r)), periods).alias("sortino_daily"),
        F.count(F.lit(1)).alias("n_days"),
    )
    days = F.col("n_days") if backtest_days is None else backtest_days
    return out.withColumns({
        c: F.when(days >= min_days, F.col(c)).otherwise(0.0) for c in ("sharpe_daily", "sortino_daily")
    })


def sparse_daily_ratios(trades: DataFrame, keys, start: float, day="exit_day", pnl="pnl_abs", periods=365) -> DataFrame:
    """``sharpe_daily, sortino_daily, n_days`` of the dense daily curve without building it.

    A day without a trade returns zero, so the moments over all days follow from the
    trading days and the length of the calendar.  The first day has no return.
    """
    per_day = trades.groupBy(*keys, F.col(day).alias("day")).agg(F.sum(pnl).alias("pnl"))
    w = Window.partitionBy(*keys).orderBy("day")
    eq = snap(F.lit(float(start)) + F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = per_day.withColumn("__e", eq).withColumn("__p", F.lag("__e").over(w))
    r = div(F.col("__e"), "__p") - 1
    n = F.col("n_days") - 1
    g = rows.withColumn("__r", r).groupBy(*keys).agg(
        F.sum("__r").alias("__s"), F.sum(F.col("__r") * F.col("__r")).alias("__q"),
        F.stddev_samp(F.when(F.col("__r") < 0, F.col("__r"))).alias("__down"),
        (F.max("day") - F.min("day") + 1).cast("bigint").alias("n_days"),
    )
    mean = div(F.coalesce("__s", F.lit(0.0)), n)
    std = F.sqrt(F.greatest(div(F.col("__q") - mean * mean * n, n - 1), F.lit(0.0)))
    return g.select(
        *keys, ratio_or_zero(mean, F.when(n > 1, std), periods).alias("sharpe_daily"),
        ratio_or_zero(mean, F.col("__down"), periods).alias("sortino_daily"), "n_days")


def yearly_ratios(trades: DataFrame, keys, start: float, day="exit_day", pnl="pnl_abs", periods=365) -> DataFrame:
    """``window`` (calendar year), ``sharpe`` of the days of each year in the dense daily curve, without building it.

    From the first to the last exit day of a key every year has a row.  A day without a trade returns zero,
    or nothing where the equity is zero, so a trading day stands for the idle days up to the next one; the
    moments of the trading days are merged with those zeros.  The first day has no return.
    """
    per_day = trades.filter(col(day).isNotNull()).groupBy(*keys, F.col(day).alias("day")).agg(
        F.coalesce(F.sum(pnl), F.lit(0.0)).alias("pnl"))
    w = Window.partitionBy(*keys).orderBy("day")
    eq = snap(F.lit(float(start)) + F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = per_day.withColumn("__e", eq).withColumns({
        "__p": F.lag("__e").over(w), "__last": F.coalesce(F.lead("day").over(w) - 1, F.col("day")),
    })
    own = F.year(F.date_from_unix_date("day"))
    rows = rows.withColumn("window", F.explode(F.sequence(own, F.year(F.date_from_unix_date("__last")))))
    first = F.unix_date(F.make_date("window", F.lit(1), F.lit(1)))
    last = F.unix_date(F.make_date("window", F.lit(12), F.lit(31)))
    idle = F.least(F.col("__last"), last) - F.greatest(F.col("day") + 1, first) + 1
    r = F.when(F.col("window") == own, div(F.col("__e"), "__p") - 1)
    g = rows.groupBy(*keys, "window").agg(
        F.count(r).alias("__k"), F.coalesce(F.avg(r), F.lit(0.0)).alias("__m"),
        F.coalesce(F.var_pop(r), F.lit(0.0)).alias("__v"),
        F.sum(F.when(F.col("__e") != 0, F.greatest(idle, F.lit(0))).otherwise(0)).alias("__z"),
    )
    n, k, m = F.col("__k") + F.col("__z"), F.col("__k"), F.col("__m")
    square = F.col("__v") * k + div(m * m * k * F.col("__z"), n)
    std = F.sqrt(div(square, n - 1))
    return g.select(*keys, "window", ratio_or_zero(div(m * k, n), F.when(n > 1, std), periods).alias("sharpe"))


def rolling_sharpe(series: DataFrame, keys, n: int, ret="ret", index="i", periods=8760) -> DataFrame:
    """Mean over population deviation of the last ``n`` returns, full windows only."""
    def build(f: DataFrame, s) -> DataFrame:
        m, d = full_mean(ret, n, s), full_std(ret, n, s)
        return f.withColumn("rolling_sharpe", F.when(m.isNotNull(), ratio_or_zero(m, d, periods)))

    return rolling(series, keys, n - 1, build, index=index)


def _streak_runs(trades: DataFrame, keys, path, order, sign: Column) -> DataFrame:
    """Length of every maximal run of equal ``sign`` (gaps and islands in one scan).

    Position minus position-within-sign is constant inside a run; both are running counts.
    """
    rows = trades.withColumn("__sg", sign)
    levels = {f"__n{v}": Run("sum", (F.col("__sg") == v).cast("bigint")) for v in (-1, 0, 1)}
    scanned = running(rows, keys, path, order, {"__n": Run("count"), **levels})
    own = (
        F.when(F.col("__sg") == 1, F.col("__n1")).when(F.col("__sg") == -1, F.col("__n-1"))
        .otherwise(F.col("__n0"))
    )
    return scanned.groupBy(*keys, F.col("__sg").alias("sign"), (F.col("__n") - own).alias("run")).agg(
        F.count(F.lit(1)).alias("length")
    )


def streak_max(trades: DataFrame, keys, path, order, pnl="pnl_abs") -> DataFrame:
    """Longest winning and losing streak; a zero result counts as a loss."""
    runs = _streak_runs(trades, keys, path, order, F.when(col(pnl) > 0, 1).otherwise(-1))
    return runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("sign") == 1, F.col("length"))), F.lit(0)).alias("max_win_streak"),
        F.coalesce(F.max(F.when(F.col("sign") == -1, F.col("length"))), F.lit(0)).alias("max_loss_streak"),
    )


def streak_distribution(trades: DataFrame, keys, path, order, pnl="pnl_abs") -> DataFrame:
    """How often each streak length occurs; a zero result ends both kinds of streak."""
    runs = _streak_runs(trades, keys, path, order, F.signum(col(pnl)).cast("int"))
    return (
        runs.filter(F.col("sign") != 0)
        .groupBy(*keys, F.when(F.col("sign") == 1, "win").otherwise("loss").alias("kind"), "length")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def drawdown_episodes(curve: DataFrame, keys, path, at, equity="equity") -> DataFrame:
    """One row per maximal stretch below the running maximum.

    ``peak_at`` is the first row that holds the maximum, ``trough_at`` the first minimum,
    ``recovered_at`` the first row back at the peak (NULL while open).
    """
    e, at = col(equity), col(at)
    before = running(curve, keys, path, [at], {"__pk": Run("max", e)}, exclusive=True)
    record = F.col("__pk").isNull() | (e > F.col("__pk"))
    rows = before.withColumns({
        "__dry": F.when(F.col("__pk").isNull() | (e >= F.col("__pk")), 1).otherwise(0),
        "__new": F.when(record, at),
        "__pk": F.greatest(F.col("__pk"), e),
    })
    # a group is one stretch of wet rows together with the dry row that ends it
    rows = running(rows, keys, path, [at], {
        "__g": Run("sum", F.col("__dry")), "__at": Run("last", F.col("__new")),
    }).withColumn("__g", F.col("__g") - F.col("__dry"))
    wet = F.col("__dry") == 0
    groups = rows.groupBy(*keys, "__g").agg(
        F.max(F.when(wet, F.col("__pk"))).alias("peak"),
        F.max(F.when(wet, F.col("__at"))).alias("peak_at"),
        F.min(F.when(wet, e)).alias("trough"),
        F.min_by(F.when(wet, at), F.when(wet, F.struct(e, at))).alias("trough_at"),
        F.max(F.when(~wet, at)).alias("recovered_at"),
        F.count_if(wet).alias("under_rows"),
    ).filter(F.col("under_rows") > 0)
    return groups.withColumn("depth", div(F.col("trough") - F.col("peak"), "peak") * 100).select(
        *keys, "peak", "peak_at", "trough", "trough_at", "recovered_at", "under_rows", "depth"
    )
