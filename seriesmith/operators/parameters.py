"""Signals, exits and scores for parameter sets that are a table.

A row of ``sets`` is a parameter set: ``param_id``, the periods ``fast, slow, signal`` and
``rsi_period, rsi_lookback``, the timeframe ``trend_tf``, the thresholds ``rsi_lower, rsi_upper,
adx_min`` and the exit fields ``hard_stop, trail, max_hold``.  Nothing of it becomes a list in the plan:

* each distinct combination of periods meets the bars once, dealt over ``LANES`` parts;
* a bar's zones are kept as the extremes of RSI over the memory, for each pair of period and memory
  that occurs, so sets of any number meet them by equality and compare their own thresholds;
* only bars where a combination crosses meet the sets of that combination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from . import exits as E
from .indicators import ATR_PERIOD, atr_adx_columns, macd_columns, macd_history, rsi_columns
from .scan import rolling
from .signals import align_trend, stacked, strength

MACD = ["fast", "slow", "signal"]
ZONE = ["rsi_period", "rsi_lookback"]
#: Parts in which every row of one table meets every row of another.
LANES = 64


def each_with(left: DataFrame, right: DataFrame, right_id: Column) -> DataFrame:
    """Every row of ``left`` next to every row of ``right``, where the result itself is that
    product (bars by periods, folds by sets): ``right`` is dealt over lanes, ``left`` is in all."""
    lanes = left.withColumn("__lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    dealt = right.withColumn("__lane", F.pmod(F.xxhash64(right_id), F.lit(LANES)).cast("int"))
    return lanes.join(dealt, "__lane").drop("__lane")


def macd_of_sets(bars: DataFrame, combos: DataFrame, keys) -> DataFrame:
    """``macd, macd_signal, cross`` of every bar for every row ``fast, slow, signal`` of ``combos``."""
    r = combos.agg(F.max(F.greatest("fast", "slow")).alias("a"), F.min(F.least("fast", "slow")).alias("b"),
                   F.max("signal").alias("c"), F.min("signal").alias("d")).first()
    periods = (F.col("fast"), F.col("slow"), F.col("signal"), (r["a"], r["b"], r["c"], r["d"]))
    key = [*keys, *MACD]

    def build(f: DataFrame, s) -> DataFrame:
        f = macd_columns(f, [*key, "__chunk"], *periods)
        pm, ps = F.lag("macd").over(s), F.lag("macd_signal").over(s)
        m, g = F.col("macd"), F.col("macd_signal")
        return f.withColumn("cross", F.when((pm <= ps) & (m > g), 1).when((pm >= ps) & (m < g), -1).otherwise(0))

    return rolling(each_with(bars, combos, F.struct(*MACD)), key, macd_history(*periods) + 1, build)


def features_of_sets(bars: DataFrame, sets: DataFrame, keys=("symbol",)) -> tuple[DataFrame, DataFrame]:
    """(bars with ATR and ADX, ``rsi, rsi_min, rsi_max`` for each bar, period and memory).

    Periods and memories are small whole numbers; their distinct pairs become columns of one pass."""
    pairs = sorted((int(r[0]), int(r[1])) for r in sets.select(*ZONE).distinct().collect())
    periods = sorted({p for p, _ in pairs})
    depth = max(2 * ATR_PERIOD, max(periods) + max(m for _, m in pairs))

    def build(f: DataFrame, s) -> DataFrame:
        f = rsi_columns(atr_adx_columns(f, s), s, periods)
        zone = [F.struct(
            F.lit(p).alias("rsi_period"), F.lit(m).alias("rsi_lookback"), F.col(f"rsi_{p}").alias("rsi"),
            F.min(f"rsi_{p}").over(s.rowsBetween(-m, 0)).alias("rsi_min"),
            F.max(f"rsi_{p}").over(s.rowsBetween(-m, 0)).alias("rsi_max")) for p, m in pairs]
        return f.withColumn("zones", F.array(*zone))

    wide = settle(rolling(bars, keys, depth, build))
    zones = wide.select(*keys, "i", F.explode("zones").alias("z")).select(*keys, "i", "z.*")
    return wide.drop("zones"), zones


def signals_of_sets(bars: DataFrame, sets: DataFrame, align="closed", base="1h",
                    features: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``symbol, param_id, i, t, fired, strength, high, low, close`` where a set fires (1 or -1)."""
    feats, zones = features or features_of_sets(bars, sets)
    combos = settle(sets.select(*MACD).distinct())
    tfs = sorted(r[0] for r in sets.select("trend_tf").distinct().collect())  # timeframes that exist, a handful
    table = macd_of_sets(stacked(bars, tfs, base), combos, ("symbol", "tf"))
    table = settle(table.filter((F.col("tf") != base) | (F.col("cross") != 0)))
    hits = table.filter(F.col("tf") == base).select("symbol", "i", "t", "macd", "macd_signal", "cross", *MACD)
    hits = hits.join(sets.select("param_id", *MACD, *ZONE, "trend_tf", "rsi_lower", "rsi_upper", "adx_min"), MACD)
    states = table.filter(F.col("tf") != base).select(
        "symbol", F.col("tf").alias("trend_tf"), *MACD, "t", (F.col("macd") > F.col("macd_signal")).alias("bull"), "tf_width")
    # thresholds first: most crossing bars of most sets end here
    up = F.col("cross") == 1
    rows = hits.join(zones, ["symbol", "i", *ZONE]).filter(
        F.when(up, F.col("rsi_min") < F.col("rsi_lower")).otherwise(F.col("rsi_max") > F.col("rsi_upper")))
    rows = rows.join(feats.select("symbol", "i", "adx", "atr", "high", "low", "close"), ["symbol", "i"]) \
        .filter(F.col("adx") >= F.col("adx_min"))
    rows = align_trend(rows, states, ["symbol", "trend_tf", *MACD], align).filter(F.col("bull") == up)
    return rows.select(
        "symbol", "param_id", "i", "t", F.col("cross").alias("fired"),
        strength(F.col("macd"), F.col("macd_signal"), F.col("atr"), F.col("rsi")).alias("strength"), "high", "low", "close")


def resolved_of_sets(bars: DataFrame, sets: DataFrame, slippage: Column, align="closed") -> tuple[DataFrame, int]:
    """(candidates with their first exits, the longest holding limit) of all sets."""
    feats = features_of_sets(bars, sets)
    sig = settle(signals_of_sets(bars, sets, align, features=feats))
    return settle(E.resolve(sig, feats[0], sets, slippage)), E.longest_hold(sets)
