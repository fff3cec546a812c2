"""Position sizing and exposure counts for portfolios of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, div_floor
from .asof import asof_join
from .correlation import mirrored
from .intervals import forward_join, open_timeline
from .scan import BLOCK_BARS, Run, running

HAIRCUT, OI_LIMIT, OI_FACTOR = 0.90, 0.06, 0.70
MIN_PCT, MAX_PCT = 0.05, 0.20


def inverse_vol_weight(feats: DataFrame, at="t") -> DataFrame:
    """Weight ``1/v`` over the sum at that moment, ``v = atr/close`` (0.01 when undefined)."""
    v = F.coalesce(F.when((F.col("close") > 0) & (F.col("atr") > 0), F.col("atr") / F.col("close")), F.lit(0.01))
    rows = feats.withColumn("vol", v)
    inv = F.lit(1.0) / F.col("vol")
    total = rows.groupBy(at).agg(F.sum(inv).alias("__all"))
    return rows.join(total, at).withColumn("weight", inv / F.col("__all")).drop("__all")


def position_pct(weight: Column, correlated: Column, vol_ratio: Column, sensitivity: Column, oi: Column, tier: Column) -> Column:
    """Share of equity: haircut per correlated position, volatility, danger penalty, clip, tier."""
    w = weight * F.pow(F.lit(HAIRCUT), F.coalesce(correlated, F.lit(0)).cast("double"))
    w = w * vol_ratio * sensitivity
    w = w * F.when(oi > OI_LIMIT, OI_FACTOR).otherwise(1.0)
    return clip(w, MIN_PCT, MAX_PCT) * tier


def _open_at(wanted: DataFrame, timeline: DataFrame, keys, name: str) -> DataFrame:
    """Positions open at a row's moment: entered before it and not ended by it."""
    got = asof_join(wanted, timeline, keys, ["before", "after"], base_ts="entry_t", slow_ts="at")
    n = F.when(F.col("asof_t") == F.col("entry_t"), F.col("before")).otherwise(F.col("after"))
    return got.withColumn(name, F.coalesce(n, F.lit(0)).cast("bigint")).drop("before", "after", "asof_t")


def _path(width=3600):
    return {"__tb": div_floor("at", width * BLOCK_BARS)}


def open_in_cluster(cands: DataFrame, trades: DataFrame) -> DataFrame:
    """``cluster_open``: open positions of the candidate's cluster at its entry."""
    return _open_at(cands, open_timeline(trades, ["cluster"], _path()), ["cluster"], "cluster_open")


def open_correlated(cands: DataFrame, trades: DataFrame, edges: DataFrame, gate: float) -> DataFrame:
    """``correlated_open``: open positions of series correlated beyond the gate.

    Each candidate asks every related series for its open count (counts, not pairs of
    intervals); a candidate without related series gets zero.
    """
    near = mirrored(edges).filter(F.abs("corr") > gate).select(F.col("a").alias("symbol"), F.col("b").alias("other"))
    timeline = open_timeline(trades, ["symbol"], _path()).withColumnRenamed("symbol", "other")
    asked = cands.select("symbol", "entry_t").distinct().join(near, "symbol")
    counted = _open_at(asked, timeline, ["other"], "__n")
    total = counted.groupBy("symbol", "entry_t").agg(F.sum("__n").alias("correlated_open"))
    return cands.join(total, ["symbol", "entry_t"], "left").withColumn(
        "correlated_open", F.coalesce("correlated_open", F.lit(0)))


def open_positions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """``units, cost, n_open`` of every bar: the open trades of a series are worth units * close - cost.

    A trade adds side * notional / entry_price units and side * notional of cost at its entry and takes
    them back at its exit, so both are running sums over bars and two events a trade; how long
    trades are held does not matter.  A trade is open from its entry up to the bar before its exit."""
    held = trades.filter(F.col("exit_i") > F.col("i"))
    cost = F.col("side") * F.col("notional")
    opened = held.select("symbol", "i", (cost / F.col("entry_price")).alias("u"), cost.alias("c"), F.lit(1).alias("k"))
    closed = held.select("symbol", F.col("exit_i").alias("i"), (-cost / F.col("entry_price")).alias("u"), (-cost).alias("c"), F.lit(-1).alias("k"))
    events = opened.unionByName(closed).groupBy("symbol", "i").agg(*[F.sum(c).alias(c) for c in ("u", "c", "k")])
    rows = bars.select("symbol", "i", "t", "close").join(events, ["symbol", "i"], "left").fillna(0, ["u", "c", "k"])
    rows = rows.withColumn("__b", div_floor("i", BLOCK_BARS))
    sums = {"units": Run("sum", F.col("u")), "cost": Run("sum", F.col("c")), "n_open": Run("sum", F.col("k"))}
    return running(rows, ["symbol"], ["__b"], ["i"], sums).drop("__b", "u", "c", "k")


def marked_equity(trades: DataFrame, bars: DataFrame, start: float, width=3600) -> DataFrame:
    """Start + realised + unrealised at every moment; ``notional`` and ``ret`` per trade."""
    mark = F.when(F.col("n_open") > 0, F.col("units") * F.col("close") - F.col("cost"))
    unreal = open_positions(trades, bars).groupBy("t").agg(F.sum(mark).alias("u"), F.sum("n_open").alias("n_open"))
    real = trades.groupBy(F.col("exit_t").alias("t")).agg(F.sum(F.col("notional") * F.col("ret")).alias("r"))
    grid = bars.select("t").distinct()
    rows = grid.join(unreal, "t", "left").join(real, "t", "left").withColumns({
        "u": F.coalesce("u", F.lit(0.0)), "r": F.coalesce("r", F.lit(0.0)),
        "n_open": F.coalesce("n_open", F.lit(0)), "__b": div_floor("t", width * BLOCK_BARS),
    })
    rows = running(rows, [], ["__b"], ["t"], {"realised": Run("sum", F.col("r"))})
    rows = rows.withColumn("equity", F.lit(float(start)) + F.col("realised") + F.col("u"))
    rows = running(rows, [], ["__b"], ["t"], {"peak": Run("max", F.col("equity"))})
    peak = F.greatest(F.col("peak"), F.lit(float(start)))
    return rows.withColumn("peak", peak).withColumn(
        "drawdown", (F.col("equity") - F.col("peak")) / F.col("peak") * 100
    ).select("t", "realised", F.col("u").alias("unrealised"), "n_open", "equity", "peak", "drawdown")


def heat_breaches(curve: DataFrame, trades: DataFrame, bars: DataFrame, heat: float) -> DataFrame:
    """Moments whose drawdown exceeds ``heat`` and the worst open trade there."""
    hot = curve.filter(F.col("drawdown") < -100 * heat).select("t", "equity", "drawdown")
    mark = F.col("notional") * F.col("side") * (F.col("close") / F.col("entry_price") - 1)
    # only breaching bars meet the trades that are open there
    at = bars.select("symbol", F.col("i").alias("at_i"), "t", "close").join(hot.select("t"), "t", "left_semi")
    held = trades.filter(F.col("exit_i") > F.col("i")).select("symbol", "i", "exit_i", "side", "notional", "entry_price")
    reach = held.agg(F.coalesce(F.max(F.col("exit_i") - F.col("i")), F.lit(1))).first()[0]
    rows = forward_join(held, at, ["symbol"], "i", "at_i", int(reach), first=0).filter(F.col("at_i") < F.col("exit_i"))
    worst = rows.select("t", "symbol", F.col("i").alias("entry_i"), mark.alias("mark")).groupBy("t").agg(
        F.min_by(F.struct("symbol", "mark"), F.struct("mark", "symbol", "entry_i")).alias("w"))
    return hot.join(worst, "t", "left").select(
        "t", "equity", "drawdown", F.col("w.symbol").alias("worst_symbol"), F.col("w.mark").alias("worst_mark"))
