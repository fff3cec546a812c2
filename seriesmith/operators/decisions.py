"""Tiers, gates and verdicts as column rules (thresholds are fixed values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case_map, col

TIER_SHARPE = {"A": 1.5, "B": 0.5, "C": 0.0}
TIER_MULTIPLIER = {"A": 1.0, "B": 0.6, "C": 0.25, "X": 0.0}
RETENTION = {"A": 0.5, "B": 0.3, "C": 0.10}
WORST_WINDOW = {"A": 0.5, "B": -0.2, "C": -1.0}
STEADY_STD = 1.5
CALMAR_FLOOR = 0.5
PBO_EXCLUDE, PBO_DEMOTE = 0.50, 0.30
MIN_TRADES_YEAR = 60


def tier_simple(sharpe) -> Column:
    s = F.coalesce(col(sharpe), F.lit(0.0))
    return (F.when(s >= TIER_SHARPE["A"], "A").when(s >= TIER_SHARPE["B"], "B")
            .when(s >= TIER_SHARPE["C"], "C").otherwise("X"))


def tier_three_signal(median, retention, std, worst) -> Column:
    m, r, s, w = col(median), col(retention), col(std), col(worst)

    def passes(t):
        return (m >= TIER_SHARPE[t]) & (r >= RETENTION[t]) & (w >= WORST_WINDOW[t])

    return (F.when(passes("A") & (s < STEADY_STD), "A").when(passes("B"), "B")
            .when(passes("C"), "C").otherwise("X"))


def multiplier(tier) -> Column:
    return case_map(tier, TIER_MULTIPLIER, 0.0)


def after_pbo(tier, pbo) -> Column:
    lower = case_map(tier, {"A": "B", "B": "C", "C": "X"}, "X")
    return F.when(col(pbo) > PBO_EXCLUDE, "X").when(col(pbo) > PBO_DEMOTE, lower).otherwise(col(tier))


def after_evaluation(tier, sharpe, calmar) -> Column:
    """Negative Sharpe excludes; then a low Calmar caps A and B at C."""
    first = F.when(col(sharpe) < 0, "X").otherwise(col(tier))
    return F.when((col(calmar) < CALMAR_FLOOR) & first.isin("A", "B"), "C").otherwise(first)


def normalise(metrics: DataFrame, names: dict[str, tuple[str, ...]], keys) -> DataFrame:
    """First present spelling of each metric, else zero; drawdown as a positive number."""
    have = set(metrics.columns)

    def value(options):
        found = [F.col(o).cast("double") for o in options if o in have]
        return F.coalesce(*found, F.lit(0.0))

    cols = {n: F.abs(value(o)) if n == "max_dd" else value(o) for n, o in names.items()}
    return metrics.select(*keys, *[c.alias(n) for n, c in cols.items()])


METRIC_NAMES = {
    "trades_per_year": ("trades_per_year",),
    "sharpe": ("sharpe_ratio_equity_based", "sharpe_equity"),
    "calmar": ("calmar_ratio", "calmar"),
    "max_dd": ("max_drawdown", "max_drawdown_pct"),
    "win_rate": ("win_rate",),
    "sortino": ("sortino_ratio",),
    "profit_factor": ("profit_factor",),
    "total_pnl_pct": ("total_pnl_pct",),
    "trades": ("trades",),
    "expectancy": ("expectancy",),
    "max_win_streak": ("max_win_streak",),
    "max_loss_streak": ("max_loss_streak",),
    "time_in_market": ("time_in_market",),
}


def _present(*flags: Column) -> Column:
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def series_verdict(m: DataFrame) -> DataFrame:
    """PASS / WARN / FAIL per series with reason codes; a high Sharpe only adds a warning.

    F1 few trades a year, F2 low Sharpe; W1 Sharpe out of the ordinary, W2 low Calmar, W3 deep
    drawdown."""
    few, weak = F.col("trades_per_year") < MIN_TRADES_YEAR, F.col("sharpe") < 0.5
    odd = ~weak & (F.col("sharpe") > 3.0)
    low, deep = F.col("calmar") < 0.5, F.col("max_dd") > 15
    return m.withColumns({
        "verdict": F.when(few | weak, "FAIL").when(low | deep, "WARN").otherwise("PASS"),
        "failures": _present(F.when(few, "F1"), F.when(weak, "F2")),
        "warnings": _present(
            F.when(odd, "W1"), F.when(low, "W2"), F.when(deep, "W3")),
    })


def portfolio_verdict(verdicts: DataFrame, keys, calmar: Column, worst: Column) -> DataFrame:
    """One verdict per portfolio from its series verdicts and two headline figures."""
    g = verdicts.groupBy(*keys).agg(
        F.count_if(F.col("verdict") == "FAIL").alias("failed"), F.count(F.lit(1)).alias("n"),
        calmar.alias("portfolio_calmar"), worst.alias("worst_calmar"),
    )
    fail = (F.col("portfolio_calmar") < 0.5) | (F.col("failed") > F.floor(F.col("n") / 2))
    return g.withColumn(
        "verdict", F.when(fail, "FAIL").when(F.col("worst_calmar") < 0.2, "WARN").otherwise("PASS"))


def train_gate(score: Column, train_trades_year: Column, test_trades: Column, min_year=MIN_TRADES_YEAR, min_test=5) -> Column:
    """Hard constraints of a fold: otherwise its score is zero."""
    ok = (F.coalesce(train_trades_year, F.lit(0.0)) >= min_year) & (F.coalesce(test_trades, F.lit(0)) >= min_test)
    return F.when(ok, score).otherwise(0.0)


def overfit_penalty(max_concurrent: Column, gate: Column, n_trades: Column) -> Column:
    return (F.when(max_concurrent <= 1, 0.5).otherwise(0.0) + F.when(gate < 0.55, 0.2).otherwise(0.0)
            + F.when(n_trades == 0, 1.0).otherwise(0.0))
