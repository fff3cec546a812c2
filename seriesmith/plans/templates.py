"""SQL templates for the checks: equity curves, daily curves, metrics of a trade table."""

from .registry import cte, r6

START = "10000000.0::DOUBLE"


def ratio(mean, std, periods):
    return f"coalesce(CASE WHEN {std} > 1e-12 THEN {mean} / {std} * sqrt({periods}) END, 0)"


def curve(name, src, keys, order, start=START):
    part = f"PARTITION BY {keys} " if keys else ""
    cte(f"{name}_sum", f"SELECT *, round({start} + sum(pnl_abs) OVER ({part}ORDER BY {order} ROWS UNBOUNDED PRECEDING), 6) AS equity FROM {src}")
    cte(f"{name}_peak", f"SELECT *, greatest({start}, max(equity) OVER ({part}ORDER BY {order} ROWS UNBOUNDED PRECEDING)) AS peak FROM {name}_sum")
    cte(name, f"SELECT *, (equity - peak) / peak * 100 AS drawdown FROM {name}_peak")


def daily(name, src, keys, start=START, day="exit_day"):
    cte(f"{name}_sum", f"SELECT {keys}, {day} AS day, sum(pnl_abs) AS pnl, count(*) AS n_trades FROM {src} GROUP BY {keys}, {day}")
    cte(f"{name}_grid", f"SELECT {keys}, unnest(range(min(day), max(day) + 1)) AS day FROM {name}_sum GROUP BY {keys}")
    cte(f"{name}_eq", f"""SELECT *, round({start} + sum(pnl) OVER w, 6) AS equity FROM (
      SELECT g.*, coalesce(s.pnl, 0) AS pnl, coalesce(s.n_trades, 0)::BIGINT AS n_trades FROM {name}_grid g LEFT JOIN {name}_sum s USING ({keys}, day))
      WINDOW w AS (PARTITION BY {keys} ORDER BY day ROWS UNBOUNDED PRECEDING)""")
    cte(name, f"""SELECT *, (equity - peak) / peak * 100 AS drawdown FROM (SELECT *, greatest({start}, max(equity) OVER (
      PARTITION BY {keys} ORDER BY day ROWS UNBOUNDED PRECEDING)) AS peak, equity / lag(equity) OVER (PARTITION BY {keys} ORDER BY day) - 1 AS ret FROM {name}_eq)""")


def metrics(name, src, keys, order, days, start=START):
    """Metric row per key; ``days`` is an expression over the source (constant per key)."""
    curve(f"{name}_c", src, keys, order, start)
    daily(f"{name}_d", src, keys, start)
    cte(f"{name}_t", f"""SELECT {keys}, count(*) AS trades, count_if(pnl_abs > 0)::BIGINT AS winning_trades, count_if(pnl_abs <= 0)::BIGINT AS losing_trades,
      coalesce(avg(CASE WHEN pnl_abs > 0 THEN pnl_abs END), 0) AS avg_win, abs(coalesce(avg(CASE WHEN pnl_abs <= 0 THEN pnl_abs END), 0)) AS avg_loss,
      coalesce(sum(CASE WHEN pnl_abs > 0 THEN pnl_abs END), 0) AS gross_win, abs(coalesce(sum(CASE WHEN pnl_abs <= 0 THEN pnl_abs END), 0)) AS gross_loss,
      sum(pnl_abs) AS total_pnl, avg(hold_bars) AS avg_hold_bars, sum(hold_bars)::DOUBLE AS hold,
      count_if(hold_bars <= 2) / count(*) AS short_hold_ratio, max({days})::DOUBLE AS days FROM {src} GROUP BY {keys}""")
    cte(f"{name}_b", f"""SELECT {keys}, coalesce(min(drawdown), 0) AS max_drawdown, coalesce(avg(CASE WHEN drawdown < 0 THEN drawdown END), 0) AS avg_drawdown,
      {ratio('avg(pnl_abs / (equity - pnl_abs))', 'stddev_samp(pnl_abs / (equity - pnl_abs))', 252)} AS sharpe_trade FROM {name}_c GROUP BY {keys}""")
    cte(f"{name}_r", f"""SELECT {keys}, {ratio('avg(ret)', 'stddev_samp(ret)', 365)} AS sharpe_daily,
      {ratio('avg(ret)', 'stddev_samp(CASE WHEN ret < 0 THEN ret END)', 365)} AS sortino_daily, count(*) AS n_days FROM {name}_d GROUP BY {keys}""")
    cte(f"{name}_w", f"""SELECT * EXCLUDE (sharpe_daily, sortino_daily), winning_trades / trades * 100 AS win_rate,
      CASE WHEN gross_loss <> 0 THEN gross_win / gross_loss ELSE 999.0::DOUBLE END AS profit_factor,
      winning_trades / trades * avg_win - (1 - winning_trades / trades) * avg_loss AS expectancy,
      {start} + total_pnl AS final_equity, total_pnl / {start} * 100 AS total_pnl_pct,
      coalesce(total_pnl / nullif(hold, 0), 0) AS profit_per_bar, least(1.0::DOUBLE, coalesce(hold / nullif(days * 24, 0), 0)) AS time_in_market,
      CASE WHEN days >= 1 THEN trades / (days / 365.25::DOUBLE) ELSE 0 END AS trades_per_year,
      CASE WHEN days >= 30 THEN sharpe_daily ELSE 0 END AS sharpe_daily, CASE WHEN days >= 30 THEN sortino_daily ELSE 0 END AS sortino_daily
      FROM {name}_t JOIN {name}_b USING ({keys}) JOIN {name}_r USING ({keys})""")
    cte(name, f"""SELECT *, CASE WHEN abs(max_drawdown) < 1e-12 THEN 0 ELSE (CASE WHEN days >= 365 THEN total_pnl_pct / (days / 365.25::DOUBLE) ELSE total_pnl_pct END) / abs(max_drawdown) END AS calmar,
      CASE WHEN abs(max_drawdown) * {start} / 100 < 1e-12 THEN 0 ELSE total_pnl / (abs(max_drawdown) * {start} / 100) END AS recovery_factor FROM {name}_w""")


def score(min_test):
    """Fold score over a metric row."""
    raw = "greatest(0, total_pnl_pct / (days / 365.25::DOUBLE) / greatest(abs(max_drawdown / 100), 0.05::DOUBLE))"
    return f"""CASE WHEN trades >= {min_test} THEN ln(1 + {raw}) / CASE WHEN sharpe_daily > 3 THEN 1 + 0.3::DOUBLE * (sharpe_daily - 3) ELSE 1 END ELSE 0 END"""


def out(*cols, digits=6, nine=()):
    return ", ".join(r6(c, digits=9 if c in nine else digits) for c in cols)
