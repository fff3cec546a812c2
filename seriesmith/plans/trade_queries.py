"""Metrics and report datasets over the trade table, decisions, trial logs, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import case_map, div_floor, fix
from ..operators import decisions as D
from ..operators import equity as Q
from ..operators import folds as FD
from ..operators import intervals as N
from ..operators import metrics as M
from ..operators import reports as R
from ..operators import runs as U
from ..operators import selection as SEL
from ..operators import sizing as Z
from ..operators import validation as V
from ..operators import indicators as I
from ..operators.scan import split_path
from ..sources import tables as T
from ..sources.scratch import settle
from ..streaming import live
from . import engine_queries as EQ
from .bar_queries import BENCH, GRID, ONE, bars, tail_edges
from .engine_queries import one_run
from .registry import cte, query, r6, tidy
from .templates import START, curve, daily, metrics, out, ratio

DAYS = 2700.0
KEY, ORDER, PATH = ["symbol"], T.TRADE_ORDER, T.TRADE_PATH
ORDER_SQL = "exit_day, order_id, line, part, supp, price, disc"

cte("tr", """SELECT l_returnflag AS symbol, CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS direction,
  date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS exit_day, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) - (1 + l_partkey % 20) AS entry_day,
  1 + l_partkey % 20 AS hold_bars,
  floor((round(l_extendedprice * 100)::BIGINT * (round(l_discount * 100)::BIGINT - 5) + 50) / 100.0::DOUBLE) / 100.0::DOUBLE AS pnl_abs,
  CASE l_linenumber % 5 WHEN 0 THEN 'opposing_signal' WHEN 1 THEN 'hard_stop' WHEN 2 THEN 'trailing_stop' WHEN 3 THEN 'time_exit' ELSE 'force_close' END AS reason,
  l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price, l_discount AS disc FROM lineitem""")
metrics("lm", "tr", "symbol", ORDER_SQL, f"{DAYS}::DOUBLE")
cte("trs", "SELECT * REPLACE (supp AS symbol) FROM tr")
metrics("sm", "trs", "symbol", ORDER_SQL, f"{DAYS}::DOUBLE")


def trades(spark, d):
    return T.trades(spark, d)


def curve_of(spark, d):
    return Q.equity_curve(T.split_trades(trades(spark, d)), KEY, PATH, ORDER, T.START_EQUITY)


def daily_of(spark, d):
    return Q.daily_equity(trades(spark, d), KEY, T.START_EQUITY)


@query("trade_summary", f"SELECT symbol, trades, winning_trades, losing_trades, {out('win_rate', 'avg_win', 'avg_loss', 'total_pnl', 'final_equity', 'total_pnl_pct', 'trades_per_year', nine=['total_pnl_pct'])} FROM lm")
def trade_summary(spark, d):
    m = M.trade_summary(trades(spark, d), KEY, T.START_EQUITY, DAYS)
    return tidy(m, "symbol", "trades", "winning_trades", "losing_trades", "win_rate", "avg_win", "avg_loss", "total_pnl",
                "final_equity", "total_pnl_pct", "trades_per_year", nine=["total_pnl_pct"])


@query("profit_factor_expectancy", f"SELECT symbol, {out('gross_win', 'gross_loss', 'profit_factor', 'expectancy')} FROM lm")
def profit_factor_expectancy(spark, d):
    m = M.trade_summary(trades(spark, d), KEY, T.START_EQUITY, DAYS)
    return tidy(m, "symbol", "gross_win", "gross_loss", "profit_factor", "expectancy")


@query("hold_stats", f"SELECT symbol, {out('avg_hold_bars', 'short_hold_ratio', 'profit_per_bar', 'time_in_market')} FROM lm")
def hold_stats(spark, d):
    m = M.trade_summary(trades(spark, d), KEY, T.START_EQUITY, DAYS)
    return tidy(m, "symbol", "avg_hold_bars", "short_hold_ratio", "profit_per_bar", "time_in_market")


@query("equity_by_trade", f"SELECT symbol, {ORDER_SQL.replace(', price, disc', '')}, {out('pnl_abs', 'equity', 'peak', 'drawdown', nine=['drawdown'])} FROM lm_c".replace("exit_day,", "exit_day::BIGINT AS exit_day,").replace("line,", "line::BIGINT AS line,"))
def equity_by_trade(spark, d):
    return tidy(curve_of(spark, d), "symbol", *ORDER[:-2], "pnl_abs", "equity", "peak", "drawdown", nine=["drawdown"])


@query("drawdown_summary", f"SELECT symbol, {out('max_drawdown', 'avg_drawdown', digits=9)} FROM lm")
def drawdown_summary(spark, d):
    return tidy(Q.drawdown_summary(curve_of(spark, d), KEY), digits=9)


@query("sharpe_trade", f"SELECT symbol, {out('sharpe_trade')} FROM lm")
def sharpe_trade(spark, d):
    return tidy(Q.sharpe_per_trade(curve_of(spark, d), KEY))


@query("equity_daily", f"SELECT symbol, day, n_trades, {out('pnl', 'equity', 'ret')} FROM lm_d")
def equity_daily(spark, d):
    return tidy(daily_of(spark, d), "symbol", "day", "n_trades", "pnl", "equity", "ret")


@query("sharpe_daily", f"SELECT symbol, n_days, {out('sharpe_daily')} FROM lm_r")
def sharpe_daily(spark, d):
    return tidy(Q.daily_ratios(daily_of(spark, d), KEY), "symbol", "n_days", "sharpe_daily")


@query("sortino_daily", f"SELECT symbol, {out('sortino_daily')} FROM lm_r")
def sortino_daily(spark, d):
    return tidy(Q.daily_ratios(daily_of(spark, d), KEY), "symbol", "sortino_daily")


@query("calmar_recovery", f"SELECT symbol, {out('calmar', 'recovery_factor')} FROM lm")
def calmar_recovery(spark, d):
    m = M.full_metrics(T.split_trades(trades(spark, d)), KEY, PATH, ORDER, T.START_EQUITY, DAYS)
    return tidy(m, "symbol", "calmar", "recovery_factor")


ALL = ["win_rate", "profit_factor", "expectancy", "total_pnl_pct", "max_drawdown", "avg_drawdown", "sharpe_trade", "sharpe_daily",
       "sortino_daily", "calmar", "recovery_factor", "avg_hold_bars", "time_in_market", "trades_per_year"]


@query("full_metrics_many_series", f"SELECT symbol, trades, {out(*ALL, nine=['total_pnl_pct', 'max_drawdown'])} FROM sm")
def full_metrics_many_series(spark, d):
    return tidy(supplier_metrics(spark, d), "symbol", "trades", *ALL, nine=["total_pnl_pct", "max_drawdown"])


def supplier_metrics(spark, d):
    t = T.split_trades(trades(spark, d).withColumn("symbol", F.col("supp")), 512)
    return M.full_metrics(t, KEY, PATH, ORDER, T.START_EQUITY, DAYS)


def month_of(day="exit_day"):
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM")


_MONTH = "strftime(DATE '1970-01-01' + exit_day::INTEGER, '%Y-%m')"


@query("monthly_pnl", f"SELECT symbol, {_MONTH} AS month, {r6('sum(pnl_abs)', 'pnl')}, {r6(f'sum(pnl_abs) / {START} * 100', 'pnl_pct', 9)} FROM tr GROUP BY 1, 2")
def monthly_pnl(spark, d):
    return tidy(M.monthly_pnl(trades(spark, d), KEY, month_of(), T.START_EQUITY), nine=["pnl_pct"])


@query("profitable_months", f"SELECT symbol, count(*) AS months, {r6('count_if(p > 0) / count(*)', 'profitable_months_ratio')} FROM (SELECT symbol, {_MONTH} AS m, sum(pnl_abs) AS p FROM tr GROUP BY 1, 2) GROUP BY symbol")
def profitable_months(spark, d):
    return tidy(M.profitable_months(M.monthly_pnl(trades(spark, d), KEY, month_of(), T.START_EQUITY), KEY))


@query("monthly_matrix", f"""SELECT symbol, y AS year, {', '.join(r6(f'sum(CASE WHEN m = {k} THEN p ELSE 0 END)', f'm{k:02d}', 9) for k in range(1, 13))}, {r6('sum(p)', 'year_total', 9)}
  FROM (SELECT symbol, year(DATE '1970-01-01' + exit_day::INTEGER) AS y, month(DATE '1970-01-01' + exit_day::INTEGER) AS m, sum(pnl_abs) / {START} * 100 AS p FROM tr GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def monthly_matrix(spark, d):
    day = F.date_from_unix_date("exit_day")
    return tidy(R.month_matrix(trades(spark, d), KEY, F.year(day), F.month(day), T.START_EQUITY), digits=9)


@query("streak_max", """SELECT symbol, coalesce(max(CASE WHEN s = 1 THEN c END), 0)::BIGINT AS max_win_streak, coalesce(max(CASE WHEN s = -1 THEN c END), 0)::BIGINT AS max_loss_streak FROM (
  SELECT symbol, s, count(*) AS c FROM (SELECT symbol, s, row_number() OVER (PARTITION BY symbol ORDER BY %s) - row_number() OVER (PARTITION BY symbol, s ORDER BY %s) AS g
    FROM (SELECT *, CASE WHEN pnl_abs > 0 THEN 1 ELSE -1 END AS s FROM tr)) GROUP BY symbol, s, g) GROUP BY symbol""" % (ORDER_SQL, ORDER_SQL))
def streak_max(spark, d):
    return tidy(Q.streak_max(T.split_trades(trades(spark, d)), KEY, PATH, ORDER))


@query("streak_distribution", """SELECT symbol, CASE WHEN s = 1 THEN 'win' ELSE 'loss' END AS kind, c AS length, count(*) AS n FROM (
  SELECT symbol, s, count(*) AS c FROM (SELECT symbol, s, row_number() OVER (PARTITION BY symbol ORDER BY %s) - row_number() OVER (PARTITION BY symbol, s ORDER BY %s) AS g
    FROM (SELECT *, sign(pnl_abs)::INTEGER AS s FROM tr)) GROUP BY symbol, s, g) WHERE s <> 0 GROUP BY symbol, s, c""" % (ORDER_SQL, ORDER_SQL))
def streak_distribution(spark, d):
    return tidy(Q.streak_distribution(T.split_trades(trades(spark, d)), KEY, PATH, ORDER))


@query("underwater", f"SELECT symbol, day, {out('equity', 'peak', 'drawdown', nine=['drawdown'])} FROM lm_d")
def underwater(spark, d):
    return tidy(daily_of(spark, d), "symbol", "day", "equity", "peak", "drawdown", nine=["drawdown"])


@query("drawdown_episodes_top5", f"""SELECT symbol, rank, {out('depth', 'peak', 'trough')}, peak_day, trough_day, recovered_day, under_rows FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, peak_day) AS rank FROM (
    SELECT symbol, max(pk) AS peak, max(pd) AS peak_day, min(eq) AS trough, first(day ORDER BY eq, day) AS trough_day, count(*) AS under_rows,
      max(nx) AS recovered_day, (min(eq) - max(pk)) / max(pk) * 100 AS depth FROM (
      SELECT *, max(CASE WHEN newhigh THEN day END) OVER (PARTITION BY symbol ORDER BY day) AS pd,
        min(CASE WHEN NOT wet THEN day END) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx,
        sum(CASE WHEN wet THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY day) AS g FROM (
        SELECT symbol, day, round(equity, 2) AS eq, max(round(equity, 2)) OVER w AS pk, round(equity, 2) < max(round(equity, 2)) OVER w AS wet,
          coalesce(round(equity, 2) > max(round(equity, 2)) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS newhigh
        FROM lm_d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING))) WHERE wet GROUP BY symbol, g)) WHERE rank <= 5""")
def drawdown_episodes_top5(spark, d):
    curve_ = daily_of(spark, d).select("symbol", "day", F.round("equity", 2).alias("equity")).withColumn("b", div_floor("day", 512))
    e = Q.drawdown_episodes(curve_, KEY, ["b"], "day")
    e = e.withColumnsRenamed({"peak_at": "peak_day", "trough_at": "trough_day", "recovered_at": "recovered_day"})
    top = SEL.top_k(e.withColumn("neg", -F.col("depth")), KEY, 5, "neg", "peak_day")
    return tidy(top, "symbol", "rank", "depth", "peak", "trough", "peak_day", "trough_day", "recovered_day", "under_rows")


cte("moves", """SELECT mom, sum(o)::BIGINT AS opened, sum(c)::BIGINT AS closed FROM (SELECT entry_day AS mom, 1 AS o, 0 AS c FROM tr UNION ALL SELECT exit_day, 0, 1 FROM tr) GROUP BY mom""")


@query("concurrent_positions", """SELECT mom AS day, opened, closed, sum(opened - closed) OVER (ORDER BY mom)::BIGINT AS open_after FROM moves""")
def concurrent_positions(spark, d):
    t = N.open_timeline(trades(spark, d), [], {"b": div_floor("at", 512)}, "entry_day", "exit_day")
    return tidy(t.select(F.col("at").alias("day"), "opened", "closed", F.col("after").alias("open_after")))


@query("max_simultaneous", """SELECT symbol, max(o)::BIGINT AS max_open FROM (SELECT symbol, sum(d) OVER (PARTITION BY symbol ORDER BY mom) AS o FROM (
   SELECT symbol, mom, sum(d) AS d FROM (SELECT symbol, entry_day AS mom, 1 AS d FROM tr UNION ALL SELECT symbol, exit_day, -1 FROM tr) GROUP BY 1, 2)) GROUP BY symbol
   UNION ALL SELECT 'all', max(o)::BIGINT FROM (SELECT sum(opened - closed) OVER (ORDER BY mom) AS o FROM moves)""")
def max_simultaneous(spark, d):
    path = {"b": div_floor("at", 512)}
    t = trades(spark, d)
    per = N.open_timeline(t, KEY, path, "entry_day", "exit_day").groupBy("symbol").agg(F.max("after").alias("max_open"))
    every = N.open_timeline(t, [], path, "entry_day", "exit_day").agg(F.max("after").alias("max_open"))
    return tidy(per.unionByName(every.select(F.lit("all").alias("symbol"), "max_open")))


@query("long_short", f"""SELECT symbol, direction, n, {out('win_rate', 'pnl', 'avg_pnl')}, {r6('n / sum(n) OVER (PARTITION BY symbol)', 'share')} FROM (
  SELECT symbol, direction, count(*) AS n, count_if(pnl_abs > 0) / count(*) * 100 AS win_rate, sum(pnl_abs) AS pnl, avg(pnl_abs) AS avg_pnl FROM tr GROUP BY 1, 2)""")
def long_short(spark, d):
    return tidy(R.side_stats(trades(spark, d), KEY))


@query("pnl_contribution", f"""SELECT supp, {r6('p', 'pnl')}, {r6('p / sum(abs(p)) OVER () * 100', 'share_pct')} FROM (SELECT supp, sum(pnl_abs) AS p FROM tr GROUP BY supp)""")
def pnl_contribution(spark, d):
    return tidy(R.contribution(trades(spark, d), "supp"))


@query("exit_reason_counts", "SELECT symbol, reason, count(*) AS n FROM tr GROUP BY ALL ORDER BY n DESC")
def exit_reason_counts(spark, d):
    return tidy(R.reason_counts(trades(spark, d), KEY).orderBy(F.desc("n")))


@query("pnl_histogram", f"""SELECT symbol, {r6('floor(pnl_abs / 250.0::DOUBLE) * 250', 'bin')}, count(*) AS n FROM tr GROUP BY 1, 2""")
def pnl_histogram(spark, d):
    return tidy(R.histogram(trades(spark, d), KEY, "pnl_abs", 250.0))


@query("hold_histogram", f"""SELECT direction, {r6('floor(hold_bars / 4.0::DOUBLE) * 4', 'bin')}, count(*) AS n FROM tr GROUP BY 1, 2""")
def hold_histogram(spark, d):
    return tidy(R.histogram(trades(spark, d), ["direction"], "hold_bars", 4.0))


# ---------------------------------------------------------------- shuffled order
# on the trades of the signal engine, a few hundred per series
N_SIMS = 1000
_ID = "(i * 7919 + sim * 1000003)"
cte("mc_rows", f"SELECT symbol, i, pnl_abs, sim, ({_ID} % 2147483647 * 48271 % 2147483647) / 2147483647.0::DOUBLE AS pos FROM e1, range({N_SIMS}) r(sim)")
curve("mc_c", "mc_rows", "symbol, sim", "pos, i", "100000.0::DOUBLE")
cte("mc_p", f"""SELECT symbol, sim, n, max_dd, win_rate, coalesce(CASE WHEN n > 1 AND sd > 1e-12 THEN m / sd * sqrt(n * 365 / 30.0::DOUBLE) END, 0) AS sharpe FROM (
  SELECT symbol, sim, count(*) AS n, min(drawdown) AS max_dd, count_if(pnl_abs > 0) / count(*) * 100 AS win_rate, avg(pnl_abs / (equity - pnl_abs)) AS m,
    stddev_pop(pnl_abs / (equity - pnl_abs)) AS sd FROM mc_c GROUP BY symbol, sim)""")
cte("mc_s", """SELECT symbol, count(*) AS n_sims, max(n) AS n_trades, avg(sharpe) AS sharpe_mean, stddev_pop(sharpe) AS sharpe_std, quantile_cont(sharpe, 0.025) AS sharpe_low,
  quantile_cont(sharpe, 0.975) AS sharpe_high, avg(max_dd) AS dd_mean, stddev_pop(max_dd) AS dd_std, quantile_cont(max_dd, 0.025) AS dd_low, quantile_cont(max_dd, 0.975) AS dd_high, max(win_rate) AS win_rate
  FROM mc_p GROUP BY symbol""")
cte("mc_r", """SELECT *, (CASE WHEN sharpe_high - sharpe_low < 0.3 THEN 1.0::DOUBLE WHEN sharpe_high - sharpe_low < 0.6 THEN 0.7 WHEN sharpe_high - sharpe_low < 1.0 THEN 0.4 ELSE 0.2 END
  + CASE WHEN sharpe_low > 0.5 THEN 1.0::DOUBLE WHEN sharpe_low > 0 THEN 0.7 WHEN sharpe_low > -0.5 THEN 0.4 ELSE 0.1 END
  + CASE WHEN abs(dd_high - dd_low) < 5 THEN 1.0::DOUBLE WHEN abs(dd_high - dd_low) < 10 THEN 0.7 WHEN abs(dd_high - dd_low) < 15 THEN 0.4 ELSE 0.2 END
  + CASE WHEN n_trades >= 100 THEN 1.0::DOUBLE WHEN n_trades >= 50 THEN 0.8 WHEN n_trades >= 30 THEN 0.6 ELSE 0.3 END) / 4 AS robustness FROM mc_s""")
cte("mc_l", "SELECT *, CASE WHEN robustness >= 0.7 AND sharpe_low > 0 THEN 'HIGH' WHEN robustness >= 0.5 AND sharpe_low > -0.3 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM mc_r")
MC = ["sharpe_mean", "sharpe_std", "sharpe_low", "sharpe_high", "dd_mean", "dd_std", "dd_low", "dd_high", "win_rate"]


def _mc(spark, d):
    t = one_run(spark, d)[1]
    p = F.col("i").cast("bigint") * 7919 + F.col("sim").cast("bigint") * 1000003
    pos = (p % 2147483647 * 48271 % 2147483647) / F.lit(2147483647.0)
    sh = V.shuffles(t, KEY, N_SIMS, 42, ["i"], position=pos)
    return V.shuffle_summary(V.shuffle_paths(sh, KEY, ["pos", "i"], 100_000.0, 30.0), KEY)


@query("mc_shuffle_summary", f"SELECT symbol, n_sims, n_trades, {out(*MC)} FROM mc_l")
def mc_shuffle_summary(spark, d):
    return tidy(_mc(spark, d), "symbol", "n_sims", "n_trades", *MC)


@query("mc_robustness", f"SELECT symbol, label, {out('robustness')} FROM mc_l")
def mc_robustness(spark, d):
    return tidy(_mc(spark, d), "symbol", "label", "robustness")


@query("mc_merge", f"""SELECT {r6('avg(sharpe_mean)', 'sharpe_mean')}, {r6('min(sharpe_low)', 'sharpe_low')}, {r6('max(sharpe_high)', 'sharpe_high')}, {r6('min(dd_high)', 'dd_high')},
  {r6('min(robustness)', 'robustness')}, arg_min(label, CASE label WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) AS label FROM mc_l""")
def mc_merge(spark, d):
    return tidy(V.merge_robustness(_mc(spark, d), []), "sharpe_mean", "sharpe_low", "sharpe_high", "dd_high", "robustness", "label")


# ---------------------------------------------------------------- tiers and verdicts
cte("sup_year", f"""SELECT symbol, year(DATE '1970-01-01' + day::INTEGER) AS yr, {ratio('avg(ret)', 'stddev_samp(ret)', 365)} AS sharpe FROM sm_d GROUP BY 1, 2""")
cte("sup_wf", """SELECT symbol, median(sharpe) AS median_sharpe, stddev_pop(sharpe) AS std_sharpe, min(sharpe) AS worst_sharpe, count(*) AS n_windows, max(sharpe_daily) AS base_sharpe,
  string_agg((round(sharpe, 4) + 0.0::DOUBLE)::VARCHAR, ',' ORDER BY yr) AS ws FROM sup_year JOIN sm USING (symbol) GROUP BY symbol""")
cte("sup_keep", "SELECT *, CASE WHEN base_sharpe > 0 THEN median_sharpe / base_sharpe ELSE 0 END AS retention FROM sup_wf")
cte("sup_tier", """SELECT *, CASE WHEN median_sharpe >= 1.5 AND retention >= 0.5 AND worst_sharpe >= 0.5 AND std_sharpe < 1.5 THEN 'A' WHEN median_sharpe >= 0.5 AND retention >= 0.3 AND worst_sharpe >= -0.2 THEN 'B'
  WHEN median_sharpe >= 0 AND retention >= 0.10 AND worst_sharpe >= -1.0 THEN 'C' ELSE 'X' END AS tier FROM sup_keep""")
# an overfitting score per series: a bounded expression of its own metrics
cte("sup_pbo", "SELECT symbol, (trades * 37 % 100) / 100.0::DOUBLE AS pbo FROM sm WHERE calmar > 0")


def supplier_windows(spark, d):
    t = trades(spark, d).withColumn("symbol", F.col("supp"))
    per = Q.yearly_ratios(t, KEY, T.START_EQUITY)
    # one row a supplier, read by the windows and by what is joined to them
    base = settle(supplier_metrics(spark, d)).select("symbol", F.col("sharpe_daily").alias("s1_sharpe"), "trades", "calmar")
    return V.window_aggregate(per.join(base, "symbol"), KEY), base


def supplier_tiers(spark, d):
    w, base = supplier_windows(spark, d)
    w = w.withColumn("tier", D.tier_three_signal("median_sharpe", "retention", "std_sharpe", "worst_sharpe"))
    return w, base


def supplier_pbo(base):
    return base.filter(F.col("calmar") > 0).select("symbol", ((F.col("trades") * 37 % 100) / F.lit(100.0)).alias("pbo"))


WF = ["median_sharpe", "std_sharpe", "worst_sharpe", "retention"]


@query("wf_aggregate", f"SELECT symbol, n_windows, {out(*WF)} FROM sup_keep")
def wf_aggregate(spark, d):
    return tidy(supplier_windows(spark, d)[0], "symbol", "n_windows", *WF)


@query("tier_simple", f"""SELECT symbol, t AS tier, {r6("CASE t WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.6 WHEN 'C' THEN 0.25 ELSE 0 END", 'multiplier')}, {out('sharpe_daily')} FROM (
  SELECT *, CASE WHEN sharpe_daily >= 1.5 THEN 'A' WHEN sharpe_daily >= 0.5 THEN 'B' WHEN sharpe_daily >= 0 THEN 'C' ELSE 'X' END AS t FROM sm)""")
def tier_simple(spark, d):
    m = supplier_metrics(spark, d).withColumn("tier", D.tier_simple("sharpe_daily"))
    return tidy(m.withColumn("multiplier", D.multiplier("tier")), "symbol", "tier", "multiplier", "sharpe_daily")


@query("tier_three_signal", "SELECT symbol, tier FROM sup_tier")
def tier_three_signal(spark, d):
    return tidy(supplier_tiers(spark, d)[0], "symbol", "tier")


_AFTER = "CASE WHEN coalesce(pbo, -1) > 0.50 THEN 'X' WHEN coalesce(pbo, -1) > 0.30 THEN CASE tier WHEN 'A' THEN 'B' WHEN 'B' THEN 'C' ELSE 'X' END ELSE tier END"


@query("tier_pbo_override", f"SELECT symbol, tier, {r6('coalesce(pbo, -1)', 'pbo')}, {_AFTER} AS tier_after FROM sup_tier LEFT JOIN sup_pbo USING (symbol)")
def tier_pbo_override(spark, d):
    w, base = supplier_tiers(spark, d)
    j = U.attach_pbo(w.select("symbol", "tier"), supplier_pbo(base))
    return tidy(j.withColumn("tier_after", D.after_pbo("tier", "pbo")), "symbol", "tier", "pbo", "tier_after")


@query("tier_gates", """SELECT symbol, t0 AS tier, CASE WHEN calmar < 0.5 AND t1 IN ('A', 'B') THEN 'C' ELSE t1 END AS tier_after FROM (
  SELECT *, CASE WHEN sharpe_daily < 0 THEN 'X' ELSE t0 END AS t1 FROM (SELECT *, CASE WHEN sharpe_daily * 1.7::DOUBLE >= 1.5 THEN 'A' WHEN sharpe_daily * 1.7::DOUBLE >= 0.5 THEN 'B' WHEN sharpe_daily * 1.7::DOUBLE >= -0.2 THEN 'C' ELSE 'X' END AS t0 FROM sm))""")
def tier_gates(spark, d):
    s = F.col("sharpe_daily") * 1.7
    m = supplier_metrics(spark, d).withColumn("tier", F.when(s >= 1.5, "A").when(s >= 0.5, "B").when(s >= -0.2, "C").otherwise("X"))
    return tidy(m.withColumn("tier_after", D.after_evaluation("tier", "sharpe_daily", "calmar")), "symbol", "tier", "tier_after")


@query("exclude_tier_x", "SELECT symbol, trades FROM sm WHERE symbol NOT IN (SELECT symbol FROM sup_tier WHERE tier = 'X')")
def exclude_tier_x(spark, d):
    w, base = supplier_tiers(spark, d)
    return tidy(U.without_excluded(base.select("symbol", "trades"), w.select("symbol", "tier")))


cte("norm", """SELECT symbol, trades_per_year, CASE WHEN symbol % 3 = 0 THEN sharpe_daily ELSE sharpe_daily * 4 END AS sharpe,
  calmar * 3 AS calmar, abs(max_drawdown) * 20 AS max_dd, time_in_market, profit_factor, expectancy, trades::DOUBLE AS trades, 0.0::DOUBLE AS max_win_streak FROM sm""")
cte("verd", """SELECT *, CASE WHEN trades_per_year < 60 OR sharpe < 0.5 THEN 'FAIL' WHEN calmar < 0.5 OR max_dd > 15 THEN 'WARN' ELSE 'PASS' END AS verdict,
  concat_ws(',', CASE WHEN trades_per_year < 60 THEN 'F1' END, CASE WHEN sharpe < 0.5 THEN 'F2' END) AS failures,
  concat_ws(',', CASE WHEN sharpe > 3 THEN 'W1' END, CASE WHEN calmar < 0.5 THEN 'W2' END, CASE WHEN max_dd > 15 THEN 'W3' END) AS warnings FROM norm""")


def _verdicts(spark, d):
    """A metric table with new and old spellings, scaled so that all rules fire."""
    m = supplier_metrics(spark, d)
    new = F.col("symbol") % 3 == 0
    raw = m.select(
        "symbol", "trades_per_year", F.when(new, F.col("sharpe_daily")).alias("sharpe_ratio_equity_based"),
        (F.col("sharpe_daily") * 4).alias("sharpe_equity"), (F.col("calmar") * 3).alias("calmar_ratio"),
        (F.col("max_drawdown") * 20).alias("max_drawdown"), "time_in_market", "profit_factor", "expectancy", "trades")
    return D.series_verdict(D.normalise(raw, D.METRIC_NAMES, KEY))


NORMAL = ["trades_per_year", "sharpe", "calmar", "max_dd", "time_in_market", "profit_factor", "expectancy", "trades", "max_win_streak"]


@query("metrics_normalised", f"SELECT symbol, {out(*NORMAL)} FROM norm")
def metrics_normalised(spark, d):
    return tidy(_verdicts(spark, d), "symbol", *NORMAL)


@query("verdict_series", "SELECT symbol, verdict, failures, warnings FROM verd")
def verdict_series(spark, d):
    return tidy(_verdicts(spark, d), "symbol", "verdict", "failures", "warnings")


@query("verdict_portfolio", f"""SELECT pf, failed, n, CASE WHEN pc < 0.5 OR failed > n // 2 THEN 'FAIL' WHEN wc < 0.2 THEN 'WARN' ELSE 'PASS' END AS verdict, {r6('pc', 'portfolio_calmar')}, {r6('wc', 'worst_calmar')} FROM (
  SELECT symbol % 7 AS pf, count_if(verdict = 'FAIL')::BIGINT AS failed, count(*) AS n, avg(calmar) * 2 AS pc, min(calmar) + 1 AS wc FROM verd GROUP BY 1)""")
def verdict_portfolio(spark, d):
    v = _verdicts(spark, d).withColumn("pf", F.col("symbol") % 7)
    return tidy(D.portfolio_verdict(v, ["pf"], F.avg("calmar") * 2, F.min("calmar") + 1))


# series of the portfolio, of which some never trade
N_CONFIGURED = 1250


@query("worst_series_calmar", f"""SELECT {r6('min(pnl / sh / 7.4::DOUBLE / greatest(abs(dd) / 100, 0.05::DOUBLE))', 'worst_calmar')}, count(*) AS n_series FROM (
  SELECT symbol, max(sh) AS sh, count(*) AS n, sum(pnl_abs) AS pnl, min((eq - greatest(sh, pk)) / greatest(sh, pk) * 100) AS dd FROM (
    SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS pk FROM (
      SELECT *, sh + sum(pnl_abs) OVER (PARTITION BY symbol ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS eq FROM (
        SELECT *, {START} / {N_CONFIGURED} AS sh FROM trs))) GROUP BY symbol) WHERE n >= 2""")
def worst_series_calmar(spark, d):
    t = T.split_trades(trades(spark, d).withColumn("symbol", F.col("supp")), 512)
    return tidy(M.worst_series_calmar(t, KEY, PATH, ORDER, T.START_EQUITY, 7.4, N_CONFIGURED))


# ---------------------------------------------------------------- trial log
cte("trials", """SELECT o_orderpriority AS symbol, o_orderkey AS number, CASE WHEN o_orderstatus = 'P' THEN 'pruned' ELSE 'complete' END AS state,
  (round(o_totalprice * 100)::BIGINT % 1000003) / 250000.0::DOUBLE AS objective, (o_custkey * 7919 % 10007) / 2500.0::DOUBLE AS second,
  -(o_orderkey % 3) / 2.0::DOUBLE AS third, year(o_orderdate) AS year FROM orders""")


def trials(spark, d):
    return T.trial_log(spark, d).withColumn("nb", div_floor("number", 1 << 20))


@query("trials_topk", f"""SELECT symbol, number, rank, {out('objective')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY objective DESC, number) AS rank
  FROM trials WHERE state = 'complete') WHERE rank <= 200""")
def trials_topk(spark, d):
    return tidy(SEL.top_k(trials(spark, d).filter("state = 'complete'"), KEY, 200), "symbol", "number", "rank", "objective")


@query("trials_best", f"""SELECT symbol, number, {out('objective')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY objective DESC, number) AS rank FROM trials) WHERE rank = 1""")
def trials_best(spark, d):
    return tidy(SEL.best_per_key(trials(spark, d), KEY, "objective", "number"), "symbol", "number", "objective")


cte("bsf", """SELECT *, max(value) OVER (PARTITION BY symbol ORDER BY number) AS best FROM (SELECT *, CASE WHEN state = 'complete' THEN objective ELSE 0 END AS value FROM trials)""")


@query("best_so_far", f"SELECT symbol, number, {out('value', 'best')} FROM bsf")
def best_so_far(spark, d):
    return tidy(SEL.best_so_far(trials(spark, d), KEY, ["nb"], ok=F.col("state") == "complete"), "symbol", "number", "value", "best")


@query("downsample", f"""SELECT symbol, number, {out('best')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY number) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bsf)
  WHERE n <= 200 OR (k % (n // 200) = 0 AND k < 200 * (n // 200)) OR k = n - 1""")
def downsample(spark, d):
    b = SEL.best_so_far(trials(spark, d), KEY, ["nb"], ok=F.col("state") == "complete")
    return tidy(SEL.thin(b, KEY, ["nb"], "number", 200), "symbol", "number", "best")


@query("trials_better_half", f"""SELECT symbol, number, {out('objective')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY objective DESC, number) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM trials)
  WHERE k <= (n + 1) // 2""")
def trials_better_half(spark, d):
    t = trials(spark, d).withColumn("bucket", F.floor(-F.col("objective") * 1024).cast("bigint"))
    # a value many trials share is split by its number
    t = split_path(t, {"value": -F.col("objective"), "range": div_floor("number", 1 << 16)})
    return tidy(SEL.better_half(t, KEY, ["bucket", "value", "range"], "objective", "number"), "symbol", "number", "objective")


cte("front", """SELECT * FROM trials a WHERE NOT EXISTS (SELECT 1 FROM trials b WHERE b.symbol = a.symbol AND b.objective >= a.objective AND b.second >= a.second AND b.third >= a.third
  AND (b.objective > a.objective OR b.second > a.second OR b.third > a.third))""")
OBJ = ["objective", "second", "third"]


@query("pareto_front", f"SELECT symbol, number, {out(*OBJ)} FROM front")
def pareto_front(spark, d):
    return tidy(SEL.pareto_front(trials(spark, d), KEY, OBJ), "symbol", "number", *OBJ)


@query("pareto_pick", f"""SELECT symbol, number, {out('score')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC, number) AS k FROM (
  SELECT *, 0.6::DOUBLE * (objective - min(objective) OVER w) / coalesce(nullif(max(objective) OVER w - min(objective) OVER w, 0), 1)
    + 0.4::DOUBLE * (second - min(second) OVER w) / coalesce(nullif(max(second) OVER w - min(second) OVER w, 0), 1) AS score FROM front WINDOW w AS (PARTITION BY symbol))) WHERE k = 1""")
def pareto_pick(spark, d):
    front = settle(SEL.pareto_front(trials(spark, d), KEY, OBJ))
    return tidy(SEL.weighted_pick(front, KEY, "objective", "second"), "symbol", "number", "score")


# ---------------------------------------------------------------- runs
cte("run_m", """SELECT 'run-' || year AS run, symbol, count(*) AS trades, avg(objective) AS sharpe, max(second) AS calmar FROM trials GROUP BY year, symbol""")
cte("run_e", "SELECT run, symbol, trades, sharpe + 1 AS sharpe, calmar FROM run_m WHERE trades % 2 = 0")


def run_metrics(spark, d):
    return trials(spark, d).groupBy(F.concat(F.lit("run-"), F.col("year")).alias("run"), "symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("objective").alias("sharpe"), F.max("second").alias("calmar"))


@query("metrics_preference", f"""SELECT run, symbol, CASE WHEN e.sharpe IS NOT NULL THEN 'evaluation' ELSE 'tuning' END AS source, {r6('coalesce(e.sharpe, m.sharpe)', 'sharpe')}, {r6('coalesce(e.calmar, m.calmar)', 'calmar')}
  FROM run_m m LEFT JOIN run_e e USING (run, symbol)""")
def metrics_preference(spark, d):
    m = run_metrics(spark, d)
    e = m.filter(F.col("trades") % 2 == 0).withColumn("sharpe", F.col("sharpe") + 1)
    return tidy(U.prefer(e, m, ["run", "symbol"], ["sharpe", "calmar"]), "run", "symbol", "source", "sharpe", "calmar")


@query("runs_compare", f"""SELECT run, symbol, coalesce(m.trades, 0) AS trades, {r6('coalesce(m.sharpe, 0)', 'sharpe')}, {r6('coalesce(m.calmar, 0)', 'calmar')}
  FROM (SELECT DISTINCT run FROM run_m) CROSS JOIN (SELECT DISTINCT symbol FROM run_m) LEFT JOIN run_m m USING (run, symbol)""")
def runs_compare(spark, d):
    return tidy(U.compare(run_metrics(spark, d), ["trades", "sharpe", "calmar"]), "run", "symbol", "trades", "sharpe", "calmar")


@query("runs_symbols_in_order", """SELECT symbol, first_run, first_pos FROM (SELECT symbol, run AS first_run, trades AS first_pos, row_number() OVER (PARTITION BY symbol ORDER BY run, trades) AS k FROM run_m) WHERE k = 1""")
def runs_symbols_in_order(spark, d):
    return tidy(U.symbols_in_order(run_metrics(spark, d), "run", "trades"))


@query("runs_roll_up", f"""SELECT run, count_if(v = 'PASS')::BIGINT AS n_pass, count_if(v = 'WARN')::BIGINT AS n_warn, count_if(v = 'FAIL')::BIGINT AS n_fail, {r6('avg(sharpe)', 'sharpe')} FROM (
  SELECT *, CASE WHEN sharpe < 1.99 THEN 'FAIL' WHEN calmar < 4 THEN 'WARN' ELSE 'PASS' END AS v FROM run_m) GROUP BY run""")
def runs_roll_up(spark, d):
    m = run_metrics(spark, d)
    v = m.withColumn("verdict", F.when(F.col("sharpe") < 1.99, "FAIL").when(F.col("calmar") < 4, "WARN").otherwise("PASS"))
    return tidy(U.roll_up(v, m.groupBy("run").agg(F.avg("sharpe").alias("sharpe"))))


cte("files", """SELECT 'c' || o_custkey AS run, CASE o_orderpriority WHEN '1-URGENT' THEN 'pipeline_result' WHEN '2-HIGH' THEN 'per_pair_metrics' WHEN '3-MEDIUM' THEN 'pbo_results'
  WHEN '4-NOT SPECIFIED' THEN 'wf_eval_metrics' ELSE 'stage1/' || o_orderstatus END AS file FROM orders""")


def files(spark, d):
    o = T.table(spark, d, "orders")
    name = case_map("o_orderpriority", {"1-URGENT": "pipeline_result", "2-HIGH": "per_pair_metrics", "3-MEDIUM": "pbo_results", "4-NOT SPECIFIED": "wf_eval_metrics"})
    return o.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("run"), F.coalesce(name, F.concat(F.lit("stage1/"), F.col("o_orderstatus"))).alias("file"))


@query("run_phase", """SELECT run, CASE WHEN bool_or(file = 'per_pair_metrics') THEN 'pre_s2' WHEN bool_or(file = 'pbo_results') THEN 'per_pair_eval' WHEN bool_or(file = 'wf_eval_metrics') THEN 'pbo' ELSE 'wf_eval' END AS phase,
  CASE WHEN bool_or(file = 'pipeline_result') THEN 'completed' WHEN bool_or(file LIKE 'stage1/%') THEN 'running' ELSE 'partial' END AS status FROM files GROUP BY run""")
def run_phase(spark, d):
    return tidy(U.phase(files(spark, d)))


@query("latest_unfinished_run", """SELECT max(run) AS run FROM (SELECT run FROM files GROUP BY run
  HAVING count_if(file = 'pipeline_result') = 0 AND count_if(file LIKE 'stage1/%') > 0)""")
def latest_unfinished_run(spark, d):
    return tidy(U.latest_unfinished(files(spark, d)))


@query("latest_progress", f"""SELECT run, symbol, updated, completed, total, {out('best_value')}, CASE WHEN done THEN 'done' ELSE 'running' END AS status FROM (
  SELECT 'run-' || year AS run, symbol, number AS updated, number % 997 AS completed, 500::BIGINT AS total, objective AS best_value, count_if(number % 61 = 0) OVER (PARTITION BY year, symbol) > 0 AS done,
    row_number() OVER (PARTITION BY year, symbol ORDER BY number % 61 = 0 DESC, number DESC) AS k FROM trials) WHERE k = 1""")
def latest_progress(spark, d):
    u = trials(spark, d).select(
        F.concat(F.lit("run-"), F.col("year")).alias("run"), "symbol", F.col("number").alias("updated"), (F.col("number") % 997).alias("trials_completed"),
        F.lit(500).cast("bigint").alias("trials_total"), F.col("objective").alias("best_value"), (F.col("number") % 61 == 0).alias("is_result"))
    return tidy(live.latest_progress(u))


# ---------------------------------------------------------------- parameters and lookups
@query("param_gap_repair", f"""SELECT number, {out('fast')}, CASE WHEN slow - fast < 5 THEN floor(fast) + 5 ELSE slow END AS slow, slow - fast >= 5 AS valid FROM (
  SELECT o_orderkey AS number, 2.5::DOUBLE + o_custkey % 20 AS fast, (10 + o_orderkey % 25)::DOUBLE AS slow FROM orders)""")
def param_gap_repair(spark, d):
    p = T.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("number"), (F.lit(2.5) + F.col("o_custkey") % 20).alias("fast"),
        (F.lit(10) + F.col("o_orderkey") % 25).cast("double").alias("slow"))
    p = p.withColumn("valid", F.col("slow") - F.col("fast") >= 5)
    return FD.repair_gap(p).select("number", fix("fast").alias("fast"), "slow", "valid")


@query("profile_lookup", f"""SELECT symbol, CASE symbol WHEN 'click' THEN 'traffic' WHEN 'view' THEN 'traffic' WHEN 'error' THEN 'fault' ELSE 'convert' END AS cluster,
  {r6("CASE symbol WHEN 'click' THEN 0.0006 WHEN 'view' THEN 0.0004 WHEN 'purchase' THEN 0.0010 WHEN 'signup' THEN 0.0012 ELSE 0.0015 END", 'slippage')}, count(*) AS n FROM ticks GROUP BY symbol""")
def profile_lookup(spark, d):
    g = T.ticks(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumns({"cluster": case_map("symbol", T.CLUSTER), "slippage": case_map("symbol", T.SLIPPAGE, T.DEFAULT_SLIPPAGE)})
    return tidy(g, "symbol", "cluster", "slippage", "n")


@query("objective_score", f"""SELECT symbol, {r6('ln(1 + greatest(calmar, 0)) / CASE WHEN sharpe_daily * 4 > 3 THEN 1 + 0.3::DOUBLE * (sharpe_daily * 4 - 3) ELSE 1 END', 'score')} FROM sm""")
def objective_score(spark, d):
    m = supplier_metrics(spark, d)
    score = M.objective(F.greatest(F.col("calmar"), F.lit(0.0)), F.col("sharpe_daily") * 4)
    return tidy(m.withColumn("score", score), "symbol", "score")
