"""From signals to trades: first barrier, non-overlap, costs, compounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, div_floor
from ..sources.scratch import settle
from .intervals import forward_join
from .scan import BLOCK_BARS, Run, running

MIN_HOLD = 2
ACTIVATION_ATR = 1.5
FEE = 0.0006
ENTRY = ["symbol", "param_id", "i"]


def exit_params(spark, params) -> DataFrame:
    """Exit fields of the parameter sets, a table or a list, as a table."""
    if isinstance(params, DataFrame):
        return params.select("param_id", "hard_stop", "trail", F.col("max_hold").cast("int").alias("max_hold"))
    rows = [
        F.struct(
            F.lit(p["param_id"]).cast("int").alias("param_id"),
            F.lit(float(p["hard_stop"])).alias("hard_stop"),
            F.lit(float(p["trail"])).alias("trail"),
            F.lit(int(p["max_hold"])).alias("max_hold"),
        )
        for p in params
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def longest_hold(params) -> int:
    if isinstance(params, DataFrame):
        return int(params.agg(F.max("max_hold")).first()[0])
    return max(int(p["max_hold"]) for p in params)


def candidates(signals: DataFrame, params: DataFrame, slippage: Column, long_only=False) -> DataFrame:
    """One candidate entry per fired signal, filled at the close plus / minus slippage."""
    side = F.col("fired")
    wanted = side == 1 if long_only else side != 0
    return signals.filter(wanted).join(params, "param_id").select(
        *ENTRY, F.col("t").alias("entry_t"), side.alias("side"), "strength",
        slippage.alias("slippage"),
        (F.col("close") * (F.lit(1.0) + side * slippage)).alias("entry_price"),
        F.col("high").alias("entry_high"), F.col("low").alias("entry_low"),
        "hard_stop", "trail", "max_hold",
    )


def first_opposing(entries: DataFrame, signals: DataFrame, reach: int) -> DataFrame:
    """Add ``opp_i``: the first opposite signal at least MIN_HOLD bars after the entry."""
    flips = signals.filter(F.col("fired") != 0).select(
        "symbol", "param_id", F.col("i").alias("sig_i"), F.col("fired").alias("sig")
    )
    found = (
        forward_join(entries.select(*ENTRY, "side"), flips, ["symbol", "param_id"], "i", "sig_i",
                     reach, first=MIN_HOLD)
        .filter(F.col("sig") == -F.col("side"))
        .groupBy(*ENTRY).agg(F.min("sig_i").alias("opp_i"))
    )
    return entries.join(found, ENTRY, "left")


def walk(entries: DataFrame, bars: DataFrame, reach: int, adaptive: Column | None = None,
         activation: float = ACTIVATION_ATR) -> DataFrame:
    """Every candidate with the bars after it and its barrier tests.

    ``bars`` has ``symbol, i, t, high, low, close, atr``; the path extremes and the sticky
    trailing activation are running windows over one candidate (at most ``reach`` rows).
    """
    path = bars.select("symbol", F.col("i").alias("x"), F.col("t").alias("x_t"),
                       "high", "low", "close", "atr", *(["stop_factor"] if adaptive is not None else []))
    rows = forward_join(entries, path, ["symbol"], "i", "x", reach).filter(
        F.col("x") - F.col("i") <= F.col("max_hold")
    )
    w = Window.partitionBy(*ENTRY).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    is_long = F.col("side") == 1
    atr = F.coalesce(F.when(F.col("atr") > 0, F.col("atr")), F.lit(1e-8))
    if adaptive is not None:
        atr = atr * adaptive
    rows = rows.withColumn("__a", atr).withColumns({
        "best": F.when(is_long, F.greatest("entry_high", F.max("high").over(w)))
                 .otherwise(F.least("entry_low", F.min("low").over(w))),
        "active": F.max(
            F.when(is_long, F.col("high") - F.col("entry_price"))
            .otherwise(F.col("entry_price") - F.col("low")) >= F.lit(activation) * F.col("__a")
        ).over(w),
        "hard_level": F.col("entry_price") - F.col("side") * F.col("hard_stop") * F.col("__a"),
    })
    rows = rows.withColumn("trail_level", F.col("best") - F.col("side") * F.col("trail") * F.col("__a"))

    def touched(level):
        return F.when(is_long, F.col("low") <= F.col(level)).otherwise(F.col("high") >= F.col(level))

    reason = (
        F.when(touched("hard_level"), "hard_stop")
        .when(F.col("active") & touched("trail_level"), "trailing_stop")
        .when(F.col("x") - F.col("i") >= F.col("max_hold"), "time_exit")
        .when(F.col("x") == F.col("opp_i"), "opposing_signal")
    )
    level = (
        F.when(F.col("reason") == "hard_stop", F.col("hard_level"))
        .when(F.col("reason") == "trailing_stop", F.col("trail_level"))
        .otherwise(F.col("close"))
    )
    return rows.withColumn("reason", reason).withColumn(
        "exit_price", level * (F.lit(1.0) - F.col("side") * F.col("slippage"))
    ).drop("__a")


def first_exit(walked: DataFrame) -> DataFrame:
    """The earliest triggered barrier per candidate."""
    hit = F.struct("x", "x_t", "reason", "exit_price")
    return walked.filter(F.col("reason").isNotNull()).groupBy(*ENTRY).agg(
        F.min_by(hit, F.col("x")).alias("__h")
    ).select(
        *ENTRY, F.col("__h.x").alias("exit_i"), F.col("__h.x_t").alias("exit_t"),
        F.col("__h.reason").alias("reason"), F.col("__h.exit_price").alias("exit_price"),
    )


def resolve(signals: DataFrame, bars: DataFrame, params: list[dict] | DataFrame, slippage: Column,
            long_only=False, adaptive: Column | None = None) -> DataFrame:
    """Every candidate entry with its first exit (NULL where the data ends first)."""
    reach = longest_hold(params)
    entries = candidates(signals, exit_params(bars.sparkSession, params), slippage, long_only)
    entries = first_opposing(entries, signals, reach)
    hits = first_exit(walk(entries, bars, reach, adaptive))
    return entries.join(hits, ENTRY, "left").drop("entry_high", "entry_low", "opp_i")


def whole_range(bars: DataFrame) -> DataFrame:
    """One fold per symbol that covers all its bars."""
    return bars.groupBy("symbol").agg(
        F.lit(0).alias("fold"), F.lit(0).cast("bigint").alias("start_i"), (F.max("i") + 1).alias("end_i")
    )


def cut_to_folds(resolved: DataFrame, folds: DataFrame, bars: DataFrame) -> DataFrame:
    """Restrict candidates to folds ``[start_i, end_i)``; what is still open at the end of
    a fold is closed at its last bar.  Barriers do not depend on the fold, so they are
    searched once and only truncated here."""
    last = bars.select("symbol", F.col("i").alias("last_i"), F.col("t").alias("last_t"),
                       F.col("close").alias("last_close"))
    ends = folds.withColumn("last_i", F.col("end_i") - 1).join(last, ["symbol", "last_i"])
    rows = resolved.join(ends, "symbol").filter(
        (F.col("i") >= F.col("start_i")) & (F.col("i") < F.col("end_i"))
    )
    done = F.col("exit_i").isNotNull() & (F.col("exit_i") < F.col("end_i"))
    forced = F.col("last_close") * (F.lit(1.0) - F.col("side") * F.col("slippage"))
    rows = rows.withColumns({
        "exit_price": F.when(done, F.col("exit_price")).otherwise(forced),
        "exit_t": F.when(done, F.col("exit_t")).otherwise(F.col("last_t")),
        "reason": F.when(done, F.col("reason")).otherwise("force_close"),
        "exit_i": F.when(done, F.col("exit_i")).otherwise(F.col("last_i")),
    })
    return rows.drop("last_i", "last_t", "last_close").withColumn(
        "free_i", F.when(F.col("reason") == "opposing_signal", F.col("exit_i")).otherwise(F.col("exit_i") + 1)
    )


_CHAIN = """
aggregate({array}, named_struct('free', {free}, 'n', cast(0 as bigint)),
  (s, e) -> if(e.i >= s.free, named_struct('free', e.free_i, 'n', s.n + 1), s), s -> s.free)
"""


#: Blocks, or functions of a level, that are composed together.
FAN = 64
# position that is free after a node for one that is free before it: the outcome of the first door at
# or behind it, or itself
_AFTER = "coalesce(greatest({x}, get(filter({doors}, d -> d.i >= {x}), 0).out), {x})"


def _entries(nodes: DataFrame, keys, fan: int) -> DataFrame:
    """``node, free``: the position that is free before each node, from the nodes' step functions.

    ``doors`` are a node's steps and ``edge`` the largest position it can be entered with.  Functions
    of ``fan`` neighbours compose to the function of a node one level up: the steps of the first keep
    their places, their outcomes go through the others, and where no step of it lies at the edge or
    behind, the first step of a later one does.  Levels are walked up until a series is one
    node, and down again with the entries; no group holds more than one node's children."""
    top = nodes.agg(F.max("node")).first()[0]
    up = div_floor("node", fan)
    children = F.array_sort(F.collect_list(F.struct("node", "edge", "doors"))).alias("cs")
    groups = nodes.withColumn("up", up).groupBy(*keys, "up").agg(children)
    if top is None or top < fan:
        groups = groups.withColumn("free", F.lit(-1).cast("bigint"))
    else:
        groups = settle(groups)
        through = _AFTER.format(x="e.out", doors="c.doors")
        composed = groups.withColumn("edge", F.expr("cs[0].edge")).withColumn("doors", F.expr(f"""
            aggregate(slice(cs, 2, size(cs)), cs[0].doors, (f, c) -> concat(
              transform(f, e -> named_struct('i', e.i, 'out', {through})),
              if(size(f) = 0 or element_at(f, -1).i < edge, slice(c.doors, 1, 1), slice(c.doors, 1, 0))))"""))
        above = _entries(composed.select(*keys, F.col("up").alias("node"), "edge", "doors"), keys, fan)
        groups = groups.join(above.withColumnRenamed("node", "up"), [*keys, "up"])
    after = _AFTER.format(x="s.free", doors="c.doors")
    return groups.withColumn("seen", F.expr(f"""
        aggregate(cs, named_struct('free', free, 'seen', cast(array() as array<struct<node:bigint,free:bigint>>)),
          (s, c) -> named_struct('free', {after}, 'seen', concat(s.seen, array(named_struct('node', c.node, 'free', s.free)))),
          s -> s.seen)""")).select(*keys, F.explode("seen").alias("e")).select(*keys, "e.node", "e.free")


def non_overlapping(cand: DataFrame, keys, reach: int, block: int = BLOCK_BARS, fan: int = FAN) -> DataFrame:
    """Greedy selection: an entry is taken when ``i >= free_i`` of the last taken one.

    A series is cut into blocks of at least ``reach`` positions, so a taken trade can delay
    entries of the next block only.  Each block is summarised as a function "first allowed
    position -> position that is free after the block"; it changes value only at the
    entries of the block's first ``reach`` positions.  The functions are composed along the
    series as a tree (``_entries``), then every block selects its own trades.  No task holds more
    than one block of a series or the functions of ``fan`` neighbours.
    """
    keys = list(keys)
    size = max(block, reach + 1)
    rows = cand.withColumn("__b", div_floor("i", size))
    ordered = F.array_sort(F.collect_list(F.struct("i", "free_i")))
    edge = f"(__b * {size} + {reach} + 1)"
    # doors: entries a carried position can be waiting for, each with its outcome
    blocks = rows.groupBy(*keys, "__b").agg(ordered.alias("es")).withColumn("edge", F.expr(edge)).withColumn("doors", F.expr(
        f"transform(filter(es, (e, k) -> e.i < {edge} or k = 0 or es[k - 1].i < {edge}), d -> "
        f"named_struct('i', d.i, 'out', "
        + _CHAIN.format(array="filter(es, e -> e.i >= d.i)", free="d.i") + "))"
    ))
    states = _entries(blocks.select(*keys, F.col("__b").alias("node"), "edge", "doors"), keys, fan)
    states = states.withColumnsRenamed({"node": "__b", "free": "__free"})
    taken = blocks.join(states, [*keys, "__b"]).select(
        *keys, "__b",
        F.explode(F.expr("""
          aggregate(es, named_struct('free', __free, 'out', cast(array() as array<bigint>)),
            (s, e) -> if(e.i >= s.free,
                         named_struct('free', e.free_i, 'out', concat(s.out, array(e.i))), s),
            s -> s.out)
        """)).alias("i"),
    )
    return rows.join(taken, [*keys, "__b", "i"], "left_semi").drop("__b")


def price_return(fee: float = FEE) -> Column:
    """Return per unit of capital after fees on both fills."""
    e, x = F.col("entry_price"), F.col("exit_price")
    long_ret = x * (1.0 - fee) / (e * (1.0 + fee)) - 1.0
    short_ret = (e * (1.0 - fee) - x * (1.0 + fee)) / (e * (1.0 + fee))
    return F.when(F.col("side") == 1, long_ret).otherwise(short_ret)


def compounded(trades: DataFrame, keys, start: float, weight: Column, fee: float = FEE,
               block: int = BLOCK_BARS, order=None) -> DataFrame:
    """Capital path of sequential trades: ``cash_n = start * prod(1 + w * ret)``.

    The product is a running sum of logarithms over index blocks.  A factor of zero or
    less is ruin: that trade is kept and later ones are dropped.
    """
    order = order or ["i"]
    rows = trades.withColumns({"ret": price_return(fee), "weight": weight})
    factor = F.lit(1.0) + F.col("weight") * F.col("ret")
    rows = rows.withColumns({
        "__log": F.when(factor > 0, F.ln(factor)).otherwise(F.lit(0.0)),
        "__ruin": F.when(factor <= 0, 1).otherwise(0),
        "__b": div_floor(order[-1], block),
    })
    path = [*order[:-1], "__b"]
    rows = running(
        rows, keys, path, [*order], {
            "__g": Run("sum", F.col("__log")), "__dead": Run("sum", F.col("__ruin")),
        },
    )
    rows = rows.filter(F.col("__dead") - F.col("__ruin") == 0)
    before = F.lit(float(start)) * F.exp(F.col("__g") - F.col("__log"))
    capital = before * F.col("weight")
    return rows.withColumns({
        "cash_before": before,
        "capital_at_entry": F.round(capital, 2),
        "size": F.round(capital / (F.col("entry_price") * (1.0 + fee)), 8),
        "pnl_abs": F.round(capital * F.col("ret"), 2),
    }).drop("__log", "__ruin", "__b", "__g", "__dead")


def bet_size(pct: float, vol_ratio=None, sensitivity: float = 1.0) -> Column:
    ratio = F.lit(1.0) if vol_ratio is None else vol_ratio
    return clip(F.lit(float(pct)) * ratio * F.lit(float(sensitivity)), 0.05, 0.30)


def stop_factor(vol_ratio: Column) -> Column:
    """Adaptive stop width: inverse volatility ratio, clipped."""
    return clip(F.lit(1.0) / vol_ratio, 0.7, 1.5)
