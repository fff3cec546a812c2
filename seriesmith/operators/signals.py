"""Layered entry signals for one or many parameter sets.

A parameter set is a dict with ``param_id, fast, slow, signal, rsi_period, rsi_lower,
rsi_upper, rsi_lookback, trend_tf, adx_min`` (and the exit fields of ``exits.py``).
Indicators are computed once per *distinct* period, and only bars where MACD crosses (a
small share) are ever multiplied by parameter sets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div_floor
from ..sources.scratch import settle
from .asof import asof_join
from .bars import WIDTH
from .indicators import ATR_PERIOD, atr_adx_columns, macd_columns, macd_history, rsi_columns
from .scan import bar_index, rolling


@dataclass(frozen=True)
class Benchmark:
    """Regime gate of one leading series, exempt from its own gate."""

    symbol: str
    tf: str = "4h"
    fast: float = 10.5
    slow: int = 27
    signal: int = 9


def _distinct(params, names):
    return sorted({tuple(p[n] for n in names) for p in params})


def _fan_out(df: DataFrame, combos) -> DataFrame:
    """Copy rows once per distinct MACD period combination (a literal array, no join)."""
    items = [
        F.struct(F.lit(k).alias("macd_id"), F.lit(float(f)).alias("fast"),
                 F.lit(float(s)).alias("slow"), F.lit(float(g)).alias("signal"))
        for k, (f, s, g) in enumerate(combos)
    ]
    return df.withColumn("__m", F.explode(F.array(*items))).select("*", "__m.*").drop("__m")


def macd_many(bars: DataFrame, combos, keys=("symbol",), crosses=False) -> DataFrame:
    """MACD of every period combination in one job; ``macd_id`` joins the key.

    ``crosses=True`` adds ``cross``: 1 where the line crosses its signal upwards, -1 where
    it crosses downwards, else 0.
    """
    means, sigs = [x for c in combos for x in c[:2]], [c[2] for c in combos]
    spans = (max(means), min(means), max(sigs), min(sigs))
    periods = (F.col("fast"), F.col("slow"), F.col("signal"), spans)
    key = [*keys, "macd_id"]

    def build(f: DataFrame, s) -> DataFrame:
        f = macd_columns(f, [*key, "__chunk"], *periods)
        if not crosses:
            return f
        pm, ps = F.lag("macd").over(s), F.lag("macd_signal").over(s)
        m, g = F.col("macd"), F.col("macd_signal")
        return f.withColumn(
            "cross", F.when((pm <= ps) & (m > g), 1).when((pm >= ps) & (m < g), -1).otherwise(0))

    return rolling(_fan_out(bars, combos), key, macd_history(*periods) + 1, build)


def zone_columns(f: DataFrame, s, zones) -> DataFrame:
    """``low_<k>`` and ``high_<k>`` for each (period, lower, upper, memory) on a chunk frame.

    A zone holds when RSI was below / above the bound on the row or one of the ``memory``
    rows before it.  Warm-up RSI is 100 and therefore counts as overbought.
    """
    out = {}
    for k, (n, lo, hi, memory) in enumerate(zones):
        w = s.rowsBetween(-memory, 0)
        out[f"low_{k}"] = F.max(F.col(f"rsi_{n}") < lo).over(w)
        out[f"high_{k}"] = F.max(F.col(f"rsi_{n}") > hi).over(w)
    return f.withColumns(out)


def rsi_zones(bars: DataFrame, zones, keys=("symbol",)) -> DataFrame:
    periods = sorted({z[0] for z in zones})
    depth = max(periods) + max(z[3] for z in zones)
    return rolling(bars, keys, depth, lambda f, s: zone_columns(rsi_columns(f, s, periods), s, zones))


def stacked(bars: DataFrame, tfs, base: str | None = None) -> DataFrame:
    """Bars of several timeframes in one table, keyed (symbol, tf), with their index."""
    wide = bars.withColumn("__tf", F.explode(F.array(*[
        F.struct(F.lit(tf).alias("tf"), F.lit(WIDTH[tf]).alias("tf_width")) for tf in tfs])))
    slow = wide.withColumn("__g", div_floor("t", F.col("__tf.tf_width")) * F.col("__tf.tf_width"))
    slow = slow.groupBy("symbol", F.col("__tf.tf").alias("tf"), F.col("__g").alias("t")).agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume"),
        F.first("__tf.tf_width").alias("tf_width"))
    slow = bar_index(slow, ["symbol", "tf"])
    if base is None:
        return slow
    own = bars.withColumns({"tf": F.lit(base), "tf_width": F.lit(WIDTH[base])})
    return slow.unionByName(own)


def _states(macd_table: DataFrame) -> DataFrame:
    return macd_table.select(
        "symbol", F.col("tf").alias("trend_tf"), "macd_id", "t",
        (F.col("macd") > F.col("macd_signal")).alias("bull"), "tf_width")


def trend_states(bars: DataFrame, tfs, combos) -> DataFrame:
    """``bull`` per (symbol, tf, macd_id, slow bar); all timeframes in one job."""
    return _states(macd_many(stacked(bars, tfs), combos, ("symbol", "tf")))


def align_trend(base: DataFrame, states: DataFrame, keys, align="closed", value="bull") -> DataFrame:
    """Attach the slower state to base rows.

    ``align='open'`` uses the slow bar that has opened (it is still forming, so it contains
    later prices, and rows before the first slow bar take that bar's state);
    ``align='closed'`` uses the last slow bar that has ended.
    """
    if align == "open":
        return asof_join(base, states, keys, [value], before_first="clip")
    ended = states.withColumn("__end", F.col("t") + F.col("tf_width")).drop("t")
    # a base row at t is decided at its own close, one base width later
    return asof_join(base, ended, keys, [value], slow_ts="__end")


def regime(bars: DataFrame, bench: Benchmark, align="closed", states: DataFrame | None = None) -> DataFrame:
    """Benchmark direction at every moment some series has a bar: 1, -1 or NULL."""
    if states is None:
        lead = bars.filter(F.col("symbol") == bench.symbol)
        states = trend_states(lead, [bench.tf], [(bench.fast, bench.slow, bench.signal)])
    states = states.select("t", "bull", "tf_width", F.lit(1).alias("__one"))
    moments = bars.select("t").distinct().withColumn("__one", F.lit(1))
    at = align_trend(moments, states, ["__one"], align)
    return at.select("t", F.when(F.col("bull"), 1).when(~F.col("bull"), -1).alias("regime"))


def features(bars: DataFrame, zones, keys=("symbol",)) -> DataFrame:
    """Parameter-independent columns of every bar (ATR, ADX, RSI zones) in one shuffle."""
    periods = sorted({z[0] for z in zones})
    depth = max(2 * ATR_PERIOD, max(periods) + max(z[3] for z in zones))

    def build(f: DataFrame, s) -> DataFrame:
        return zone_columns(rsi_columns(atr_adx_columns(f, s), s, periods), s, zones)

    return rolling(bars, keys, depth, build)


def strength(macd: Column, macd_signal: Column, atr: Column, rsi: Column) -> Column:
    safe = F.coalesce(F.when(atr > 0, atr), F.lit(1e-8))
    return F.abs(macd - macd_signal) / safe + F.abs(rsi - 50.0) / 50.0


def signal_rows(bars: DataFrame, params, bench: Benchmark | None = None, align="closed",
                feats: DataFrame | None = None) -> DataFrame:
    """All layer flags at every MACD cross of every parameter set.

    Columns: ``symbol, param_id, i, t, cross, rsi_ok, trend_ok, regime_ok, adx_ok, fired,
    strength, atr, open, high, low, close``; ``fired`` is 1 (long), -1 (short) or 0.
    """
    macd_names = ["fast", "slow", "signal"]
    zone_names = ["rsi_period", "rsi_lower", "rsi_upper", "rsi_lookback"]
    combos, zones = _distinct(params, macd_names), _distinct(params, zone_names)
    tfs = sorted({p["trend_tf"] for p in params if p.get("trend_tf")})
    feats = features(bars, zones) if feats is None else feats

    own = "1h"
    table = macd_many(stacked(bars, tfs, own) if tfs else bars.withColumn("tf", F.lit(own)), combos,
                      ("symbol", "tf"), crosses=True)
    # crossing base bars and all slow bars: small, and both sides below start from it
    table = settle(table.filter((F.col("tf") != own) | (F.col("cross") != 0)))
    hits = table.filter(F.col("tf") == own).select("symbol", "macd_id", "i", "t", "macd", "macd_signal", "cross")
    lead_states = None
    if tfs:
        states = _states(table.filter(F.col("tf") != own))
        key = (bench.fast, bench.slow, bench.signal) if bench else None
        if bench and bench.tf in tfs and key in combos:
            lead_states = states.filter((F.col("symbol") == bench.symbol) & (F.col("trend_tf") == bench.tf)
                                        & (F.col("macd_id") == combos.index(key)))
        wanted = F.explode(F.array(*[F.lit(tf) for tf in tfs]))
        hits = align_trend(
            hits.withColumn("trend_tf", wanted), states, ["symbol", "trend_tf", "macd_id"], align
        )
    else:
        hits = hits.withColumn("trend_tf", F.lit("")).withColumn("bull", F.lit(None).cast("boolean"))

    sets = [
        F.struct(
            F.lit(p["param_id"]).cast("int").alias("param_id"),
            F.lit(combos.index(tuple(p[n] for n in macd_names))).alias("macd_id"),
            F.lit(zones.index(tuple(p[n] for n in zone_names))).alias("zone_id"),
            F.lit(p.get("trend_tf") or "").alias("trend_tf"),
            F.lit(float(p["adx_min"])).alias("adx_min"),
        )
        for p in params
    ]
    table = (
        bars.sparkSession.range(1).select(F.explode(F.array(*sets)).alias("p")).select("p.*")
    )
    on = ["macd_id", "trend_tf"] if tfs else ["macd_id"]
    chosen = hits.join(F.broadcast(table), on) if tfs else hits.drop("trend_tf").join(F.broadcast(table), on)
    rows = chosen.join(feats.drop("t"), ["symbol", "i"])

    def pick(prefix, ids):
        out = None
        for k, name in ids:
            c = F.col(f"{prefix}_{name}")
            out = F.when(F.col("zone_id") == k, c) if out is None else out.when(F.col("zone_id") == k, c)
        return out

    up = F.col("cross") == 1
    rsi_now = pick("rsi", [(k, z[0]) for k, z in enumerate(zones)])
    low = pick("low", [(k, k) for k in range(len(zones))])
    high = pick("high", [(k, k) for k in range(len(zones))])
    free = F.col("trend_tf") == "" if tfs else F.lit(True)
    rows = rows.withColumns({
        "rsi_ok": F.when(up, low).otherwise(high),
        "trend_ok": free | F.coalesce(F.col("bull") == up, F.lit(False)),
        "adx_ok": F.coalesce(F.col("adx") >= F.col("adx_min"), F.lit(False)),
        "strength": strength(F.col("macd"), F.col("macd_signal"), F.col("atr"), rsi_now),
    })
    if bench is None:
        rows = rows.withColumn("regime_ok", F.lit(True))
    else:
        rows = rows.join(regime(bars, bench, align, lead_states), "t", "left").withColumn(
            "regime_ok",
            (F.col("symbol") == bench.symbol)
            | F.coalesce(F.col("regime") == F.col("cross"), F.lit(False)),
        )
    every = F.col("rsi_ok") & F.col("trend_ok") & F.col("regime_ok") & F.col("adx_ok")
    return rows.withColumn("fired", F.when(every, F.col("cross")).otherwise(0)).select(
        "symbol", "param_id", "i", "t", "cross", "rsi_ok", "trend_ok", "regime_ok", "adx_ok",
        "fired", "strength", "atr", "open", "high", "low", "close",
    )


def calm_only(signals: DataFrame, ratio: Column, threshold: float = 2.5) -> DataFrame:
    """Clear signals where conditional over long-term volatility exceeds the threshold."""
    wild = F.coalesce(ratio > threshold, F.lit(False))
    return signals.withColumn("fired", F.when(wild, F.lit(0)).otherwise(F.col("fired")))

