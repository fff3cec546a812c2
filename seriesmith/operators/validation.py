"""Overfitting checks: combinatorial ranks, shuffled trade order, volatility grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, div_floor, hash_uniform
from ..sources.scratch import settle
from .equity import equity_curve, ratio_or_zero
from .scan import BLOCK_BARS, Recurrence, linear_recurrences, rolling, with_index

MIN_MC_TRADES = 10


def pbo(scores: DataFrame, keys, param="param_id", combo="combo") -> DataFrame:
    """Probability that the best set in sample is below the median out of sample.

    ``scores`` has one row per (keys, combo, param) with ``train_score, test_score``.  The
    ranks order all parameter sets of one combination; ties prefer the smaller id, and
    scores are compared at 9 places so that equal results tie whatever the summation order.
    """
    keys = list(keys)

    def rank(c):
        w = Window.partitionBy(*keys, combo).orderBy(F.round(c, 9).desc(), F.col(param))
        return F.row_number().over(w)

    ranked = scores.withColumns({"__is": rank("train_score"), "oos_rank": rank("test_score")})
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, combo))
    best = ranked.withColumn("n_sets", size).filter(F.col("__is") == 1)
    out = best.groupBy(*keys).agg(
        F.avg(F.when(F.col("oos_rank") >= F.floor(F.col("n_sets") / 2), 1.0).otherwise(0.0)).alias("pbo"),
        F.count(F.lit(1)).alias("n_combos"), F.max("n_sets").alias("n_sets"),
        F.array_sort(F.collect_list("oos_rank")).alias("ranks"),
    )
    p = F.least(F.greatest("pbo", F.lit(1e-6)), F.lit(1 - 1e-6))
    return out.withColumn("logit", F.ln(p / (F.lit(1.0) - p)))


def shuffles(trades: DataFrame, keys, n_sims: int, seed: int, trade_id, block: int = 4096,
             position: Column | None = None) -> DataFrame:
    """Every trade once per simulation with a position in [0, 1); ``slot`` cuts the positions of a
    series in as many pieces as it has blocks of trades.

    The position (by default a hash) depends only on (seed, sim, trade), so a lost task repeats it
    exactly.  Only the profit travels with it."""
    pieces = trades.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias("__slots"))
    out = trades.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
    out = out.withColumn("pos", hash_uniform(seed, "sim", *trade_id) if position is None else position)
    out = out.join(pieces, list(keys)).withColumn("slot", F.floor(F.col("pos") * F.col("__slots")).cast("int"))
    return out.select(*keys, "sim", *[c for c in trade_id if c not in keys], "pnl_abs", "pos", "slot")


def shuffle_paths(shuffled: DataFrame, keys, order, start: float, days: float) -> DataFrame:
    """Drawdown and Sharpe of every simulated trade order."""
    key = [*keys, "sim"]
    curve = equity_curve(shuffled, key, ["slot"], order, start)
    r = F.col("pnl_abs") / (F.col("equity") - F.col("pnl_abs"))
    g = curve.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_dd"),
        F.avg(r).alias("__m"), F.stddev_pop(r).alias("__s"),
        (F.count_if(F.col("pnl_abs") > 0) / F.count(F.lit(1)) * 100).alias("win_rate"),
    )
    per_year = F.sqrt(F.col("n") * 365 / F.lit(float(max(days, 1))))
    sharpe = F.when((F.col("n") > 1) & (F.col("__s") > 1e-12), F.col("__m") / F.col("__s") * per_year)
    return g.withColumn("sharpe", F.coalesce(sharpe, F.lit(0.0))).drop("__m", "__s")


def shuffle_summary(paths: DataFrame, keys) -> DataFrame:
    """Means, deviations and 95% bounds over the simulations, with robustness label."""
    def q(c, p):
        return F.percentile(c, F.lit(p))

    s = paths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sims"), F.max("n").alias("n_trades"),
        F.avg("sharpe").alias("sharpe_mean"), F.stddev_pop("sharpe").alias("sharpe_std"),
        q("sharpe", 0.025).alias("sharpe_low"), q("sharpe", 0.975).alias("sharpe_high"),
        F.avg("max_dd").alias("dd_mean"), F.stddev_pop("max_dd").alias("dd_std"),
        q("max_dd", 0.025).alias("dd_low"), q("max_dd", 0.975).alias("dd_high"),
        F.max("win_rate").alias("win_rate"),
    )
    return robustness(s)


def _steps(c: Column, steps, rest: float, below=True) -> Column:
    out = None
    for limit, score in steps:
        test = c < limit if below else c > limit
        out = (F if out is None else out).when(test, score)
    return out.otherwise(rest)


def robustness(s: DataFrame) -> DataFrame:
    """Mean of four step functions and HIGH / MEDIUM / LOW (step tables are fixed values).

    Below ten trades all figures are zero and the label is LOW.
    """
    low = F.col("sharpe_low")
    parts = [
        _steps(F.col("sharpe_high") - low, [(0.3, 1.0), (0.6, 0.7), (1.0, 0.4)], 0.2),
        _steps(low, [(0.5, 1.0), (0.0, 0.7), (-0.5, 0.4)], 0.1, below=False),
        _steps(F.abs(F.col("dd_high") - F.col("dd_low")), [(5, 1.0), (10, 0.7), (15, 0.4)], 0.2),
        F.when(F.col("n_trades") >= 100, 1.0).when(F.col("n_trades") >= 50, 0.8)
        .when(F.col("n_trades") >= 30, 0.6).otherwise(0.3),
    ]
    enough = F.col("n_trades") >= MIN_MC_TRADES
    s = s.withColumn("robustness", F.when(enough, (parts[0] + parts[1] + parts[2] + parts[3]) / 4).otherwise(0.0))
    r = F.col("robustness")
    label = (
        F.when(~enough, "LOW").when((r >= 0.7) & (low > 0), "HIGH")
        .when((r >= 0.5) & (low > -0.3), "MEDIUM").otherwise("LOW")
    )
    figures = ["sharpe_mean", "sharpe_std", "sharpe_low", "sharpe_high", "dd_mean", "dd_std", "dd_low", "dd_high", "win_rate"]
    return s.withColumn("label", label).withColumns(
        {c: F.when(enough, F.col(c)).otherwise(0.0) for c in figures}
    )


def merge_robustness(rows: DataFrame, keys) -> DataFrame:
    """Conservative merge of several summaries: worst bounds, weakest label."""
    order = F.when(F.col("label") == "LOW", 0).when(F.col("label") == "MEDIUM", 1).when(
        F.col("label") == "HIGH", 2).otherwise(-1)
    return rows.groupBy(*keys).agg(
        F.avg("sharpe_mean").alias("sharpe_mean"), F.avg("sharpe_std").alias("sharpe_std"),
        F.min("sharpe_low").alias("sharpe_low"), F.max("sharpe_high").alias("sharpe_high"),
        F.avg("dd_mean").alias("dd_mean"), F.min("dd_low").alias("dd_low"), F.min("dd_high").alias("dd_high"),
        F.min("robustness").alias("robustness"), F.min_by("label", order).alias("label"),
    )


def window_aggregate(scores: DataFrame, keys, value="sharpe", base="s1_sharpe", order="window") -> DataFrame:
    """Median, deviation and worst of the out-of-sample windows; retention against ``base``."""
    g = scores.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.5)).alias("median_sharpe"),
        F.stddev_pop(value).alias("std_sharpe"), F.min(value).alias("worst_sharpe"),
        F.count(F.lit(1)).alias("n_windows"), F.max(base).alias("base_sharpe"),
        F.array_sort(F.collect_list(F.struct(order, value))).alias("__w"),
    )
    keep = F.when(F.col("base_sharpe") > 0, F.col("median_sharpe") / F.col("base_sharpe")).otherwise(0.0)
    return g.withColumns({
        "retention": keep, "window_sharpes": F.transform("__w", lambda e: e[value]),
    }).drop("__w")


def volatility_grid(returns: DataFrame, keys, window: int, every: int, alphas, betas,
                    index="i", pct="pct") -> DataFrame:
    """Best (alpha, beta) per refit point by Gaussian likelihood on a grid.

    A refit point every ``every`` rows looks back ``window`` rows; ``omega`` follows from variance
    targeting, and the recursion starts at the window's variance.  The result is a grid point, not an
    unrestricted maximum.

    A step of the recursion is an affine map of the variance before it, so j steps from the window's first
    row are one map: beta^j of the start, omega times the sum of the powers before it, and alpha times
    the decayed squares.  The decayed squares of any window are a difference of one scan over the whole
    series, so there is one scan for each beta, none for windows, alphas or start values."""
    keys, betas = list(keys), sorted(betas)
    r = returns.filter(col(pct).isNotNull()).withColumn("__b", div_floor(index, BLOCK_BARS))
    r = with_index(r.select(*keys, index, pct, "__b"), keys, ["__b"], [index], "__pos").drop("__b")
    square = F.col(pct) * F.col(pct)
    scans = {f"__g{k}": Recurrence(square, float(b), F.lit(0.0)) for k, b in enumerate(betas)}
    r = linear_recurrences(r, keys, scans, "__pos")
    # decayed squares in front of a row
    r = rolling(r, keys, 1, lambda f, s: f.withColumn(
        "__before", F.array(*[F.coalesce(F.lag(g).over(s), F.lit(0.0)) for g in scans])), "__pos").drop(*scans)
    # a row at index i serves the refit points p with p - window < i <= p
    first = F.greatest(F.ceil(F.col(index) / every), F.ceil(F.lit(window) / every)).cast("bigint")
    last = F.floor((F.col(index) + window - 1) / every).cast("bigint")
    spread = settle(r.filter(last >= first).withColumn("refit", F.explode(F.sequence(first, last))))
    ends = spread.groupBy(*keys, "refit").agg(
        F.var_pop(pct).alias("var"), F.count(F.lit(1)).alias("rows"), F.min("__pos").alias("__p0"),
        F.min_by("__before", "__pos").alias("__base"), F.max(index).alias("__hi"))
    ends = ends.filter((F.col("rows") >= window - 1) & (F.col("__hi") == F.col("refit") * every))
    points = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"), F.lit(k).alias("k"))
                       for a in alphas for k, b in enumerate(betas) if 0 < a + b < 1])
    rows = spread.join(ends, [*keys, "refit"]).withColumn("g", F.explode(points)).select("*", "g.*").drop("g")
    a, b = F.col("alpha"), F.col("beta")
    power = F.pow(b, (F.col("__pos") - F.col("__p0")).cast("double"))
    squares = F.get("__before", F.col("k")) - power * F.get("__base", F.col("k"))
    v = F.col("var") * (power + (1 - a - b) * (1 - power) / (1 - b)) + a * squares
    cell = [*keys, "refit", "alpha", "beta"]
    fit = rows.groupBy(*cell).agg(F.sum(F.ln(v) + square / v).alias("nll"), F.max("var").alias("var"))
    best = fit.groupBy(*keys, "refit").agg(
        F.min_by(F.struct("alpha", "beta", "nll", "var"), F.struct("nll", "alpha", "beta")).alias("b"))
    b = F.col("b")
    return best.select(
        *keys, (F.col("refit") * every).alias("refit_i"), b["alpha"].alias("alpha"), b["beta"].alias("beta"),
        (b["var"] * (F.lit(1.0) - b["alpha"] - b["beta"])).alias("omega"), b["nll"].alias("nll"),
    )
