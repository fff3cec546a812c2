"""Rolling and exponential indicators over bar tables with a dense index ``i``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, col, div
from .scan import Recurrence, ema, full_mean, linear_recurrences, memory, recur, rolling

ATR_PERIOD = 14


def sma(bars: DataFrame, n: int, keys=("symbol",), column="close", name="sma") -> DataFrame:
    return rolling(bars, keys, n - 1, lambda f, s: f.withColumn(name, full_mean(column, n, s)))


def rsi_columns(f: DataFrame, s, periods) -> DataFrame:
    """``rsi_<n>`` on a chunk frame; needs ``max(periods)`` rows of history."""
    d = F.coalesce(F.col("close") - F.lag("close").over(s), F.lit(0.0))
    f = f.withColumn("__d", d)
    f = f.withColumns({"__g": F.greatest("__d", F.lit(0.0)), "__l": F.greatest(-F.col("__d"), F.lit(0.0))})
    return f.withColumns(
        {f"rsi_{n}": rsi_value(full_mean("__g", n, s), full_mean("__l", n, s)) for n in periods}
    ).drop("__d", "__g", "__l")


def rsi(bars: DataFrame, periods, keys=("symbol",)) -> DataFrame:
    """``rsi_<n>`` for each period, all periods in one pass.

    Gains and losses are simple means; the first difference counts as zero; warm-up rows
    and rows without any loss are 100.
    """
    return rolling(bars, keys, max(periods), lambda f, s: rsi_columns(f, s, periods))


def rsi_value(gain: Column, loss: Column) -> Column:
    return F.coalesce(
        F.when(loss > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / loss)), F.lit(100.0)
    )


def macd_recurrences(fast, slow, signal, spans=None, column="close"):
    """The two recurrence steps of MACD; ``spans`` bounds column-valued spans as
    ``(slowest mean, fastest mean, slowest signal, fastest signal)``."""
    hi, lo, shi, slo = spans or (None,) * 4
    means = {"__fast": ema(column, fast, column, hi, lo), "__slow": ema(column, slow, column, hi, lo)}
    line = {"macd_signal": ema("macd", signal, "macd", shi, slo)}
    return means, line


def macd_history(fast, slow, signal, spans=None) -> int:
    means, line = macd_recurrences(fast, slow, signal, spans)
    return memory(means.values())[2] + memory(line.values())[2]


def macd_columns(f: DataFrame, part, fast, slow, signal, spans=None, column="close", index="i") -> DataFrame:
    """``macd, macd_signal`` on a chunk frame that carries ``macd_history`` rows."""
    means, line = macd_recurrences(fast, slow, signal, spans, column)
    f = recur(f, part, means, index)
    f = f.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    return recur(f, part, line, index)


def macd(bars: DataFrame, fast: float, slow: float, signal: float, keys=("symbol",), column="close") -> DataFrame:
    """MACD line, signal line and histogram in one shuffle."""
    part = [*keys, "__chunk"]
    out = rolling(bars, keys, macd_history(fast, slow, signal),
                  lambda f, s: macd_columns(f, part, fast, slow, signal, None, column))
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def true_range(prev_close: Column) -> Column:
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - prev_close),
        F.abs(F.col("low") - prev_close),
    )


def atr_adx_columns(f: DataFrame, s, n: int = ATR_PERIOD) -> DataFrame:
    """``atr, plus_di, minus_di, adx`` on a chunk frame; needs ``2 n`` rows of history."""
    up = F.col("high") - F.lag("high").over(s)
    down = F.lag("low").over(s) - F.col("low")
    f = f.withColumns({
        "__tr": true_range(F.lag("close").over(s)),
        "__p": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "__m": F.when((down > up) & (down > 0), down).otherwise(0.0),
    })
    f = f.withColumns({
        "atr": full_mean("__tr", n, s),
        "__pm": full_mean("__p", n, s),
        "__mm": full_mean("__m", n, s),
    })
    f = f.withColumns({
        "plus_di": div(F.lit(100.0) * F.col("__pm"), "atr"),
        "minus_di": div(F.lit(100.0) * F.col("__mm"), "atr"),
    })
    f = f.withColumn(
        "__dx",
        div(F.lit(100.0) * F.abs(F.col("plus_di") - F.col("minus_di")),
            F.col("plus_di") + F.col("minus_di")),
    )
    f = f.withColumn("adx", full_mean("__dx", n, s))
    return f.drop("__tr", "__p", "__m", "__pm", "__mm", "__dx")


def atr_adx(bars: DataFrame, n: int = ATR_PERIOD, keys=("symbol",)) -> DataFrame:
    """ATR, +DI, -DI and ADX on simple means, one shuffle for the whole stack."""
    return rolling(bars, keys, 2 * n, lambda f, s: atr_adx_columns(f, s, n))


def returns(bars: DataFrame, keys=("symbol",), column="close") -> DataFrame:
    """Simple and log return against the previous row."""
    def build(f: DataFrame, s) -> DataFrame:
        prev = F.lag(column).over(s)
        return f.withColumns({
            "ret": div(col(column), prev) - 1,
            "log_ret": F.when((prev > 0) & (col(column) > 0), F.ln(col(column) / prev)),
        })

    return rolling(bars, keys, 1, build)


def conditional_variance(bars: DataFrame, omega: float, alpha: float, beta: float, warmup: int,
                         keys=("symbol",), lo=0.5, hi=2.0) -> DataFrame:
    """Variance recursion ``v = omega + alpha * r^2 + beta * v_prev`` on percent log returns.

    Rows before ``warmup`` are neutral (ratio 1), row ``warmup`` holds the long-term
    variance, the recursion starts behind it.  ``ratio`` is long-term over conditional
    deviation, clipped.
    """
    long_run = omega / (1.0 - alpha - beta)
    r = returns(bars, keys).withColumn("__pct", F.col("log_ret") * 100)
    tail = r.filter(F.col("i") >= warmup).withColumn("__j", F.col("i") - warmup)
    x = F.when(F.col("__j") == 0, F.lit(long_run)).otherwise(
        F.lit(omega) + F.lit(alpha) * F.col("__pct") * F.col("__pct")
    )
    tail = linear_recurrences(
        tail, keys, {"cond_var": Recurrence(x, beta, F.lit(0.0))}, index="__j"
    ).drop("__j")
    head = r.filter(F.col("i") < warmup).withColumn("cond_var", F.lit(None).cast("double"))
    out = tail.unionByName(head).drop("__pct", "ret")
    return out.withColumns({
        "cond_vol": F.sqrt(F.greatest(F.col("cond_var"), F.when(F.col("cond_var").isNotNull(), F.lit(1e-10)))),
        "long_vol": F.when(F.col("cond_var").isNotNull(), F.lit(float(max(long_run, 1e-10)) ** 0.5)),
    }).withColumn("vol_ratio", F.coalesce(clip(F.col("long_vol") / F.col("cond_vol"), lo, hi), F.lit(1.0)))
