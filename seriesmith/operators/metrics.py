"""Trade-table metrics; every function takes the key columns as an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div
from .equity import equity_curve, ratio_or_zero, sparse_daily_ratios

NO_LOSS_FACTOR = 999.0


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def trade_summary(trades: DataFrame, keys, start: float, days: Column | float, short_hold=2) -> DataFrame:
    """Counts, win rate, averages, profit factor, expectancy and holding statistics.

    ``days`` is the tested time span in days (a number or a column of the keys).
    """
    p = F.col("pnl_abs")
    win, loss = p > 0, p <= 0
    agg = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(win).alias("winning_trades"),
        F.count_if(loss).alias("losing_trades"),
        zero(F.avg(F.when(win, p))).alias("avg_win"),
        F.abs(zero(F.avg(F.when(loss, p)))).alias("avg_loss"),
        zero(F.sum(F.when(win, p))).alias("gross_win"),
        F.abs(zero(F.sum(F.when(loss, p)))).alias("gross_loss"),
        zero(F.sum(p)).alias("total_pnl"),
        F.avg("hold_bars").alias("avg_hold_bars"),
        F.sum("hold_bars").alias("__hold"),
        F.count_if(F.col("hold_bars") <= short_hold).alias("__short"),
        F.max(days if isinstance(days, Column) else F.lit(float(days))).alias("days"),
    )
    rate = F.col("winning_trades") / F.col("trades")
    return agg.withColumns({
        "win_rate": rate * 100,
        "profit_factor": F.coalesce(div("gross_win", "gross_loss"), F.lit(NO_LOSS_FACTOR)),
        "expectancy": rate * F.col("avg_win") - (F.lit(1.0) - rate) * F.col("avg_loss"),
        "final_equity": F.lit(float(start)) + F.col("total_pnl"),
        "total_pnl_pct": F.col("total_pnl") / float(start) * 100,
        "short_hold_ratio": F.col("__short") / F.col("trades"),
        "profit_per_bar": zero(div("total_pnl", "__hold")),
        "time_in_market": F.least(F.lit(1.0), zero(div(F.col("__hold"), F.col("days") * 24))),
        "trades_per_year": F.when(F.col("days") >= 1, F.col("trades") / (F.col("days") / 365.25)).otherwise(0.0),
    }).drop("__hold", "__short")


def calmar(total_pct: Column, max_dd: Column, days: Column) -> Column:
    """Return over drawdown; the return is annualised only from one year on."""
    annual = F.when(days >= 365, total_pct / (days / 365.25)).otherwise(total_pct)
    return F.when(F.abs(max_dd) < 1e-12, 0.0).otherwise(annual / F.abs(max_dd))


def recovery(total: Column, max_dd: Column, start: float) -> Column:
    base = F.abs(max_dd) * float(start) / 100
    return F.when(base < 1e-12, 0.0).otherwise(total / base)


def full_metrics(trades: DataFrame, keys, path, order, start: float, days) -> DataFrame:
    """Summary, drawdown, trade / daily Sharpe, Sortino, Calmar and recovery per key."""
    keys = list(keys)
    curve = equity_curve(trades, keys, path, order, start)
    by_trade = curve.groupBy(*keys).agg(
        zero(F.min("drawdown")).alias("max_drawdown"),
        zero(F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown")))).alias("avg_drawdown"),
        ratio_or_zero(
            F.avg(div(F.col("pnl_abs"), F.col("equity") - F.col("pnl_abs"))),
            F.stddev_samp(div(F.col("pnl_abs"), F.col("equity") - F.col("pnl_abs"))), 252,
        ).alias("sharpe_trade"),
    )
    base = trade_summary(trades, keys, start, days)
    daily = sparse_daily_ratios(trades, keys, start)
    out = base.join(by_trade, keys).join(daily, keys)
    long_enough = F.col("days") >= 30
    return out.withColumns({
        "sharpe_daily": F.when(long_enough, F.col("sharpe_daily")).otherwise(0.0),
        "sortino_daily": F.when(long_enough, F.col("sortino_daily")).otherwise(0.0),
        "calmar": calmar(F.col("total_pnl_pct"), F.col("max_drawdown"), F.col("days")),
        "recovery_factor": recovery(F.col("total_pnl"), F.col("max_drawdown"), start),
    })


def hourly_sharpe(trades: DataFrame, bars: DataFrame, keys=("symbol",), min_hours=100, periods=8760) -> DataFrame:
    """Sharpe of bar returns while in position, idle bars counting as zero.

    ``trades`` has ``i, exit_i, side, entry_price`` per key, ``bars`` has ``i, close``.  A
    trade covers the bars from its entry to its exit; where two trades meet, the later one
    wins.  A trade covers at most its holding limit of bars.
    """
    keys = list(keys)
    covered = trades.filter(F.col("exit_i") > F.col("i")).select(
        *keys, F.col("i").alias("ei"), "side", "entry_price",
        F.explode(F.sequence("i", "exit_i")).alias("i"),
    )
    owner = covered.groupBy(*keys, "i").agg(
        F.max_by(F.struct("ei", "side", "entry_price"), F.col("ei")).alias("o")
    )
    price = bars.select(*keys, "i", "close")
    before = bars.select(*keys, (F.col("i") + 1).alias("i"), F.col("close").alias("prev"))
    rows = owner.join(price, [*keys, "i"]).join(before, [*keys, "i"], "left")
    base = F.when(F.col("i") == F.col("o.ei"), F.col("o.entry_price")).otherwise(F.col("prev"))
    r = F.col("o.side") * (F.col("close") - base) / base
    sums = rows.filter(base > 0).groupBy(*keys).agg(F.sum(r).alias("s"), F.sum(r * r).alias("q"))
    hours = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("hours"))
    both = hours.join(sums, keys)
    mean = F.col("s") / F.col("hours")
    std = F.sqrt(F.greatest(F.col("q") / F.col("hours") - mean * mean, F.lit(0.0)))
    return both.select(
        *keys, "hours",
        F.when(F.col("hours") >= min_hours, ratio_or_zero(mean, std, periods)).otherwise(0.0).alias("sharpe_hourly"),
    )


def monthly_pnl(trades: DataFrame, keys, month: Column, start: float) -> DataFrame:
    """Profit per month, absolute and in percent of the start equity."""
    return trades.groupBy(*keys, month.alias("month")).agg(F.sum("pnl_abs").alias("pnl")).withColumn(
        "pnl_pct", F.col("pnl") / float(start) * 100
    )


def profitable_months(monthly: DataFrame, keys) -> DataFrame:
    return monthly.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        (F.count_if(F.col("pnl") > 0) / F.count(F.lit(1))).alias("profitable_months_ratio"),
    )


def objective(raw_calmar: Column, sharpe: Column, suspect=3.0, decay=0.3) -> Column:
    """``ln(1 + calmar)``, damped when Sharpe is suspiciously high."""
    base = F.ln(F.lit(1.0) + raw_calmar)
    return F.when(sharpe > suspect, base / (F.lit(1.0) + F.lit(decay) * (sharpe - suspect))).otherwise(base)


def fold_score(m: DataFrame, dd_floor=0.05, min_test=5, test_days="days") -> Column:
    """Score of a test window; too few trades score zero."""
    annual = F.col("total_pnl_pct") / (F.col(test_days) / 365.25)
    dd = F.greatest(F.abs(F.col("max_drawdown") / 100), F.lit(dd_floor))
    raw = F.greatest(F.lit(0.0), annual / dd)
    score = objective(raw, F.greatest(F.lit(0.0), F.col("sharpe_daily")))
    return F.when(F.col("trades") >= min_test, score).otherwise(0.0)


def worst_series_calmar(trades: DataFrame, keys, path, order, start: float, years: float, n_series: int, dd_floor=0.05) -> DataFrame:
    """Smallest Calmar over the series of a portfolio, each on an equal share of ``start``.

    The share follows the ``n_series`` configured series, also those without trades.
    """
    share = float(start) / max(n_series, 1)
    curve = equity_curve(trades, keys, path, order, share)
    per = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pnl_abs").alias("pnl"), F.min("drawdown").alias("dd")
    ).filter(F.col("n") >= 2)
    annual = F.col("pnl") / share / years
    depth = F.greatest(F.abs(zero(F.col("dd"))) / 100, F.lit(dd_floor))
    return per.agg(zero(F.min(annual / depth)).alias("worst_calmar"), F.count(F.lit(1)).alias("n_series"))


def portfolio_calmar(curve: DataFrame, start: float, years: float, at: str, dd_floor=0.05) -> DataFrame:
    """Calmar of one equity curve with ``equity`` and ``drawdown`` columns."""
    g = curve.agg(F.max_by("equity", F.col(at)).alias("final"), F.min("drawdown").alias("dd"))
    annual = (F.col("final") / float(start) - 1) / years
    return g.select(
        F.col("final").alias("final_equity"),
        (annual / F.greatest(F.abs(zero(F.col("dd"))) / 100, F.lit(dd_floor))).alias("calmar"),
    )
