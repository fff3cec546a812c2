"""Exits, trades of the signal engine, sweeps and combinatorial validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import case_map, fix, text_uniform
from ..operators import bars as B
from ..operators import equity as Q
from ..operators import exits as E
from ..operators import folds as FD
from ..operators import metrics as M
from ..operators import parameters as P
from ..operators import reports as R
from ..operators import selection as SEL
from ..operators import signals as S
from ..operators import sizing as Z
from ..operators import sweep as SW
from ..operators import validation as V
from ..operators import indicators as I
from ..operators.scan import bar_index
from ..sources import tables as T
from ..sources.scratch import settle
from .bar_queries import GRID, ONE, bars, rsi_sql, tail_edges
from .registry import cte, fork, query, r6, tidy
from .templates import metrics, out, score

def slip():
    return case_map("symbol", T.SLIPPAGE, T.DEFAULT_SLIPPAGE)


ACCT = SW.Account()
REACH = max(p["max_hold"] for p in GRID)
RULES = FD.FoldRules(minimum=100, medium=5000, long=10000)

cte("dims", "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', {T.SLIPPAGE.get(s, T.DEFAULT_SLIPPAGE)}::DOUBLE, '{T.CLUSTER[s]}', {T.OI_RATIO[s]}::DOUBLE, '{T.TIER[s]}')"
    for s in T.SYMBOLS) + ") v(symbol, slippage, cluster, oi, tier)")
cte("ents", """SELECT s.symbol, s.param_id, s.i, s.t AS entry_t, s.fired AS side, s.strength, dims.slippage,
    s.close * (1 + s.fired * dims.slippage) AS entry_price, s.high AS entry_high, s.low AS entry_low, p.hard_stop, p.trail, p.max_hold
  FROM sig_free s JOIN params p USING (param_id) JOIN dims ON dims.symbol = s.symbol WHERE s.fired <> 0""")
cte("opps", """SELECT e.symbol, e.param_id, e.i, min(s.i) AS opp_i FROM ents e JOIN sig_free s ON s.symbol = e.symbol AND s.param_id = e.param_id
  AND s.i BETWEEN e.i + 2 AND e.i + e.max_hold AND s.fired = -e.side GROUP BY ALL""")
cte("walked", """SELECT e.*, f.i AS x, f.t AS x_t, f.high, f.low, f.close, CASE WHEN f.atr > 0 THEN f.atr ELSE 1e-8::DOUBLE END AS a, o.opp_i
  FROM ents e LEFT JOIN opps o USING (symbol, param_id, i) JOIN feats f ON f.symbol = e.symbol AND f.i > e.i AND f.i <= e.i + e.max_hold""")
cte("levels", """SELECT *, entry_price - side * hard_stop * a AS hard_level, best - side * trail * a AS trail_level FROM (
  SELECT *, CASE WHEN side = 1 THEN greatest(entry_high, max(high) OVER w) ELSE least(entry_low, min(low) OVER w) END AS best,
    bool_or(CASE WHEN side = 1 THEN high - entry_price ELSE entry_price - low END >= 1.5::DOUBLE * a) OVER w AS active
  FROM walked WINDOW w AS (PARTITION BY symbol, param_id, i ORDER BY x))""")
cte("barriers", """SELECT *, CASE WHEN CASE WHEN side = 1 THEN low <= hard_level ELSE high >= hard_level END THEN 'hard_stop'
    WHEN active AND CASE WHEN side = 1 THEN low <= trail_level ELSE high >= trail_level END THEN 'trailing_stop'
    WHEN x - i >= max_hold THEN 'time_exit' WHEN x = opp_i THEN 'opposing_signal' END AS reason FROM levels""")
cte("exits0", """SELECT symbol, param_id, i, x AS exit_i, x_t AS exit_t, reason, CASE reason WHEN 'hard_stop' THEN hard_level
    WHEN 'trailing_stop' THEN trail_level ELSE close END * (1 - side * slippage) AS exit_price
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, param_id, i ORDER BY x) AS k FROM barriers WHERE reason IS NOT NULL) WHERE k = 1""")
cte("resolved", "SELECT e.*, x.exit_i, x.exit_t, x.reason, x.exit_price FROM ents e LEFT JOIN exits0 x USING (symbol, param_id, i)")
cte("lens", "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol")
cte("f_whole", "SELECT symbol, 0 AS fold, 0 AS start_i, n AS end_i FROM lens")
cte("wf", """SELECT l.symbol, fold, (floor(n::DOUBLE * train_end))::BIGINT AS train_end_i, (floor(n::DOUBLE * (train_end + 50.0::DOUBLE / n)))::BIGINT AS test_start_i,
    (floor(n::DOUBLE * test_end))::BIGINT AS test_end_i FROM lens l, (VALUES (0, 0.70::DOUBLE, 0.85::DOUBLE), (1, 0.85::DOUBLE, 1.00::DOUBLE)) v(fold, train_end, test_end) WHERE n >= 100""")
cte("f_wf", """SELECT symbol, fold * 2 AS fold, 0 AS start_i, train_end_i AS end_i FROM wf
  UNION ALL SELECT symbol, fold * 2 + 1, test_start_i, test_end_i FROM wf""")


def engine(name, folds, source="resolved"):
    """Trades of one fold set: truncation, greedy chain, returns, compounding."""
    cte(f"{name}_cut", f"""SELECT r.symbol, r.param_id, f.fold, r.i, r.entry_t, r.side, r.strength, r.entry_price, f.start_i, f.end_i,
      CASE WHEN d THEN r.exit_i ELSE f.end_i - 1 END AS exit_i, CASE WHEN d THEN r.exit_t ELSE b.t END AS exit_t,
      CASE WHEN d THEN r.reason ELSE 'force_close' END AS reason, CASE WHEN d THEN r.exit_price ELSE b.close * (1 - r.side * r.slippage) END AS exit_price
      FROM (SELECT *, 1 AS one FROM {source}) r JOIN {folds} f ON f.symbol = r.symbol AND r.i >= f.start_i AND r.i < f.end_i
      JOIN bars b ON b.symbol = f.symbol AND b.i = f.end_i - 1, LATERAL (SELECT coalesce(r.exit_i < f.end_i, false) AS d)""")
    cte(f"{name}_seq", f"""SELECT *, CASE WHEN reason = 'opposing_signal' THEN exit_i ELSE exit_i + 1 END AS free_i,
      row_number() OVER (PARTITION BY symbol, param_id, fold ORDER BY i) AS k FROM {name}_cut""")
    cte(f"{name}_chain", f"""SELECT DISTINCT symbol, param_id, fold, 0::BIGINT, -1::BIGINT, false FROM {name}_seq
      UNION ALL SELECT s.symbol, s.param_id, s.fold, s.k, CASE WHEN s.i >= c.free THEN s.free_i ELSE c.free END, s.i >= c.free
      FROM {name}_chain c JOIN {name}_seq s ON s.symbol = c.symbol AND s.param_id = c.param_id AND s.fold = c.fold AND s.k = c.k + 1""",
        "(symbol, param_id, fold, k, free, taken)")
    cte(f"{name}_ret", f"""SELECT s.*, (s.exit_i - s.i) AS hold_bars, (s.exit_t // 86400) AS exit_day, (s.end_i - s.start_i) / 24.0::DOUBLE AS days,
      CASE WHEN side = 1 THEN exit_price * (1 - 0.0006::DOUBLE) / (entry_price * (1 + 0.0006::DOUBLE)) - 1
        ELSE (entry_price * (1 - 0.0006::DOUBLE) - exit_price * (1 + 0.0006::DOUBLE)) / (entry_price * (1 + 0.0006::DOUBLE)) END AS ret
      FROM {name}_seq s JOIN {name}_chain c USING (symbol, param_id, fold, k) WHERE c.taken""")
    compound(name, f"{name}_ret", "symbol, param_id, fold")


def compound(name, src, keys):
    cte(f"{name}_cash", f"""SELECT *, 100000.0::DOUBLE * exp(coalesce(sum(ln(1 + 0.2::DOUBLE * ret)) OVER (
      PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cash_before FROM {src}""")
    cte(name, f"""SELECT *, round(cash_before * 0.2::DOUBLE, 2) AS capital_at_entry, round(cash_before * 0.2::DOUBLE * ret, 2) AS pnl_abs,
      round(cash_before * 0.2::DOUBLE / (entry_price * (1 + 0.0006::DOUBLE)), 8) AS size FROM {name}_cash""")


engine("ew", "f_whole")
engine("ef", "f_wf")
metrics("ef_m", "ef", "symbol, param_id, fold", "i", "days", "100000.0::DOUBLE")
metrics("ew_m", "ew", "symbol, param_id", "i", "days", "100000.0::DOUBLE")
cte("e1", "SELECT * FROM ew WHERE param_id = 1")


def resolved(spark, d, params, b=None):
    b = bars(spark, d) if b is None else b
    return b, SW.resolved_candidates(b, params, slip())


def one_run(spark, d, params=ONE):
    """Trades of the whole range for one parameter set."""
    b, res = resolved(spark, d, params)
    reach = max(p["max_hold"] for p in params)
    return b, settle(SW.fold_trades(res, E.whole_range(b), b, reach, ACCT))


@query("exit_candidates", f"""SELECT symbol, i::BIGINT AS i, side::BIGINT AS side, {out('entry_price', digits=6)} FROM ents WHERE param_id = 1""")
def exit_candidates(spark, d):
    sig = S.signal_rows(bars(spark, d), ONE)
    return tidy(E.candidates(sig, E.exit_params(spark, ONE), slip()), "symbol", "i", "side", "entry_price", digits=6)


@query("exit_path_extremes", f"""SELECT symbol, i::BIGINT AS i, x::BIGINT AS x, active, {out('best', 'hard_level', 'trail_level', digits=6)}
  FROM levels WHERE param_id = 1""")
def exit_path_extremes(spark, d):
    b = bars(spark, d)
    feats = settle(S.features(b, [(7, 60, 40, 3)]))
    sig = settle(S.signal_rows(b, ONE, feats=feats))
    ents = E.first_opposing(E.candidates(sig, E.exit_params(spark, ONE), slip()), sig, ONE[0]["max_hold"])
    return tidy(E.walk(ents, feats, ONE[0]["max_hold"]), "symbol", "i", "x", "active", "best", "hard_level", "trail_level", digits=6)


@query("exit_first_barrier", f"""SELECT symbol, param_id::BIGINT AS param_id, i::BIGINT AS i, exit_i::BIGINT AS exit_i, reason, {out('exit_price', digits=6)} FROM resolved""")
def exit_first_barrier(spark, d):
    return tidy(resolved(spark, d, GRID)[1], "symbol", "param_id", "i", "exit_i", "reason", "exit_price", digits=6)


@query("trades_nonoverlap", """SELECT symbol, param_id::BIGINT AS param_id, i::BIGINT AS i, exit_i::BIGINT AS exit_i, side::BIGINT AS side, reason FROM ew""")
def trades_nonoverlap(spark, d):
    b, res = resolved(spark, d, GRID)
    cut = E.cut_to_folds(res, E.whole_range(b), b)
    return tidy(E.non_overlapping(cut, SW.KEY, REACH), "symbol", "param_id", "i", "exit_i", "side", "reason")


@query("trades_costs", f"""SELECT symbol, i::BIGINT AS i, reason, {out('entry_price', 'exit_price', 'ret', digits=6)} FROM e1""")
def trades_costs(spark, d):
    return tidy(one_run(spark, d)[1], "symbol", "i", "reason", "entry_price", "exit_price", "ret", digits=6)


@query("trades_compounded", f"""SELECT symbol, param_id::BIGINT AS param_id, i::BIGINT AS i, {r6('cash_before', digits=3)}, {out('capital_at_entry', 'pnl_abs')}, {r6('size', digits=4)} FROM ew""")
def trades_compounded(spark, d):
    t = one_run(spark, d, GRID)[1]
    t = t.withColumns({"cash_before": fix("cash_before", 3), "size": fix("size", 4)})
    return tidy(t, "symbol", "param_id", "i", "cash_before", "capital_at_entry", "pnl_abs", "size")


@query("trades_by_fold", f"""SELECT symbol, param_id::BIGINT AS param_id, fold::BIGINT AS fold, i::BIGINT AS i, exit_i::BIGINT AS exit_i, reason, {out('pnl_abs')} FROM ef""")
def trades_by_fold(spark, d):
    b, res = resolved(spark, d, GRID)
    folds = wf_ranges(b)
    return tidy(SW.fold_trades(res, folds, b, REACH, ACCT), "symbol", "param_id", "fold", "i", "exit_i", "reason", "pnl_abs")


def wf_ranges(b):
    f = FD.walk_forward(FD.series_lengths(b), RULES)
    train = f.select("symbol", (F.col("fold") * 2).alias("fold"), F.lit(0).cast("bigint").alias("start_i"), F.col("train_end_i").alias("end_i"))
    test = f.select("symbol", (F.col("fold") * 2 + 1).alias("fold"), F.col("test_start_i").alias("start_i"), F.col("test_end_i").alias("end_i"))
    return train.unionByName(test)


cte("lt_adapt", """SELECT e.*, f.i AS x, f.t AS x_t, f.high, f.low, f.close, o.opp_i,
   CASE WHEN f.atr > 0 THEN f.atr ELSE 1e-8::DOUBLE END * least(greatest(1.0::DOUBLE / CASE WHEN cv.v IS NULL THEN 1.0::DOUBLE ELSE least(greatest(2.0::DOUBLE / sqrt(cv.v), 0.5), 2.0) END, 0.7), 1.5) AS a
  FROM ents e LEFT JOIN opps o USING (symbol, param_id, i) JOIN feats f ON f.symbol = e.symbol AND f.i > e.i AND f.i <= e.i + e.max_hold
  LEFT JOIN cv ON cv.symbol = f.symbol AND cv.i = f.i WHERE e.param_id = 1""")
cte("ad_levels", """SELECT *, entry_price - side * hard_stop * a AS hard_level, best - side * trail * a AS trail_level FROM (
  SELECT *, CASE WHEN side = 1 THEN greatest(entry_high, max(high) OVER w) ELSE least(entry_low, min(low) OVER w) END AS best,
    bool_or(CASE WHEN side = 1 THEN high - entry_price ELSE entry_price - low END >= 1.5::DOUBLE * a) OVER w AS active
  FROM lt_adapt WINDOW w AS (PARTITION BY symbol, param_id, i ORDER BY x))""")


@query("exit_adaptive_stops", f"""SELECT e.symbol, e.i::BIGINT AS i, z.x::BIGINT AS exit_i, z.reason FROM ents e LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY symbol, i ORDER BY x) AS k FROM (
    SELECT *, CASE WHEN CASE WHEN side = 1 THEN low <= hard_level ELSE high >= hard_level END THEN 'hard_stop'
      WHEN active AND CASE WHEN side = 1 THEN low <= trail_level ELSE high >= trail_level END THEN 'trailing_stop'
      WHEN x - i >= max_hold THEN 'time_exit' WHEN x = opp_i THEN 'opposing_signal' END AS reason FROM ad_levels) WHERE reason IS NOT NULL) z
  ON z.symbol = e.symbol AND z.i = e.i AND z.k = 1 WHERE e.param_id = 1""")
def exit_adaptive_stops(spark, d):
    b = bars(spark, d)
    vol = I.conditional_variance(b, 0.8, 0.1, 0.7, 72).select("symbol", "i", "vol_ratio")
    feats = settle(S.features(b, [(7, 60, 40, 3)]).join(vol, ["symbol", "i"]).withColumn(
        "stop_factor", E.stop_factor(F.col("vol_ratio"))))
    sig = settle(S.signal_rows(b, ONE, feats=feats.drop("vol_ratio", "stop_factor")).filter("fired != 0"))
    res = E.resolve(sig, feats, ONE, slip(), adaptive=F.col("stop_factor"))
    return tidy(res, "symbol", "i", "exit_i", "reason")  # open ones without exit


SUMMARY = ["win_rate", "avg_win", "avg_loss", "profit_factor", "expectancy", "total_pnl_pct", "max_drawdown", "sharpe_daily", "trades_per_year"]


@query("trade_summary_engine", f"""SELECT symbol, param_id::BIGINT AS param_id, trades, winning_trades, {out(*SUMMARY)} FROM ew_m""")
def trade_summary_engine(spark, d):
    t = one_run(spark, d, GRID)[1]
    return tidy(SW.fold_metrics(t, ACCT, ["symbol", "param_id"]), "symbol", "param_id", "trades", "winning_trades", *SUMMARY)


cte("own", """SELECT * FROM (SELECT e.symbol, b.i, e.i AS ei, e.side, e.entry_price, b.close, b.pc, row_number() OVER (PARTITION BY e.symbol, b.i ORDER BY e.i DESC) AS k
  FROM e1 e JOIN (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY i) AS pc FROM bars) b ON b.symbol = e.symbol AND b.i BETWEEN e.i AND e.exit_i
  WHERE e.exit_i > e.i) WHERE k = 1""")


@query("sharpe_hourly_in_market", f"""SELECT symbol, n AS hours, {r6('''CASE WHEN n >= 100 AND sd > 1e-12 THEN m / sd * sqrt(8760) ELSE 0 END''', 'sharpe_hourly')} FROM (
  SELECT symbol, n, sum(r) / n AS m, sqrt(sum(r * r) / n - (sum(r) / n) * (sum(r) / n)) AS sd FROM (
    SELECT symbol, CASE WHEN i = ei THEN side * (close - entry_price) / entry_price ELSE side * (close - pc) / pc END AS r FROM own) JOIN lens USING (symbol)
  GROUP BY symbol, n)""")
def sharpe_hourly_in_market(spark, d):
    b, t = one_run(spark, d)
    return tidy(M.hourly_sharpe(t, b), "symbol", "hours", "sharpe_hourly")


@query("entry_timing_grid", """SELECT g.c // 24 AS weekday, g.c % 24 AS hour, coalesce(s.n, 0)::BIGINT AS n FROM range(168) g(c) LEFT JOIN (
  SELECT (isodow(to_timestamp(entry_t) AT TIME ZONE 'UTC') - 1) * 24 + hour(to_timestamp(entry_t) AT TIME ZONE 'UTC') AS c, count(*) AS n FROM ew GROUP BY 1) s USING (c)""")
def entry_timing_grid(spark, d):
    t = one_run(spark, d, GRID)[1]
    ts = F.timestamp_seconds("entry_t")
    return tidy(R.timing_grid(t, F.weekday(ts), F.hour(ts)))


# all ticks as one series by the minute: long enough for the window of 2,160
cte("rets_min", """SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, close / lag(close) OVER (ORDER BY t) - 1 AS ret FROM (
  SELECT (floor(epoch(ts) / 60) * 60)::BIGINT AS t, last(price ORDER BY ts, seq) AS close FROM ticks GROUP BY 1)""")


@query("rolling_sharpe", f"""SELECT 'all' AS symbol, i::BIGINT AS i, {r6('''CASE WHEN count(ret) OVER w = 2160 THEN CASE WHEN stddev_pop(ret) OVER w > 1e-12
   THEN avg(ret) OVER w / stddev_pop(ret) OVER w * sqrt(8760) ELSE 0 END END''', 'rolling_sharpe')} FROM rets_min
  WINDOW w AS (ORDER BY i ROWS 2159 PRECEDING)""")
def rolling_sharpe(spark, d):
    ticks = T.ticks(spark, d).withColumn("symbol", F.lit("all"))
    b = bar_index(settle(B.ticks_to_bars(ticks, 60)), width=60)
    return tidy(Q.rolling_sharpe(I.returns(b), ["symbol"], 2160), "symbol", "i", "rolling_sharpe")


# ---------------------------------------------------------------- folds and sweeps
cte("li_lens", "SELECT l_returnflag AS symbol, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1")


def _fold_sql(rows):
    cols = ", ".join(r6(c) for c in ("train_end", "test_start", "test_end"))
    return f"""SELECT mode, symbol, fold::BIGINT AS fold, {cols}, (floor(n::DOUBLE * train_end))::BIGINT AS train_end_i,
      (floor(n::DOUBLE * test_start))::BIGINT AS test_start_i, (floor(n::DOUBLE * test_end))::BIGINT AS test_end_i FROM ({rows})"""


_STATIC = """SELECT 'static' AS mode, symbol, n, fold, train_end, train_end + 50.0::DOUBLE / n AS test_start, test_end FROM li_lens JOIN (VALUES
  ('l', 0, 0.5::DOUBLE, 0.6::DOUBLE), ('l', 1, 0.6::DOUBLE, 0.7::DOUBLE), ('l', 2, 0.7::DOUBLE, 0.8::DOUBLE), ('l', 3, 0.8::DOUBLE, 0.9::DOUBLE), ('l', 4, 0.9::DOUBLE, 1.0::DOUBLE),
  ('m', 0, 0.6::DOUBLE, 0.7::DOUBLE), ('m', 1, 0.7::DOUBLE, 0.8::DOUBLE), ('m', 2, 0.8::DOUBLE, 0.9::DOUBLE),
  ('s', 0, 0.7::DOUBLE, 0.85::DOUBLE), ('s', 1, 0.85::DOUBLE, 1.0::DOUBLE)) v(kind, fold, train_end, test_end)
  ON kind = CASE WHEN n >= 26280 THEN 'l' WHEN n >= 13140 THEN 'm' ELSE 's' END WHERE n >= 1000"""
_CUSTOM = """SELECT 'custom' AS mode, symbol, n, fold, 0.5::DOUBLE + (fold + 1) * st AS train_end, 0.5::DOUBLE + (fold + 1) * st + pg AS test_start,
  least(0.5::DOUBLE + (fold + 1) * st + pg + 0.2::DOUBLE, 1.0::DOUBLE) AS test_end FROM (
    SELECT symbol, n, 50.0::DOUBLE / n AS pg, ((1.0::DOUBLE - 0.5::DOUBLE - 0.2::DOUBLE) - 50.0::DOUBLE / n) / 4 AS st FROM li_lens WHERE n >= 1000), range(4) r(fold)"""
_CEIL = """SELECT 'ceiling' AS mode, symbol, n, fold, round(e, 4) AS train_end, round(b, 4) AS test_start, round(z, 4) AS test_end FROM (
  SELECT *, least(b + 0.2::DOUBLE * 0.8::DOUBLE, 0.8::DOUBLE) AS z FROM (SELECT *, e + pg AS b FROM (
    SELECT *, 0.8::DOUBLE * 0.5::DOUBLE + (fold + 1) * st AS e FROM (
      SELECT symbol, n, pg, cnt, greatest(CASE WHEN room <= 0 THEN 0.8::DOUBLE - 0.8::DOUBLE * 0.5::DOUBLE - pg ELSE room END / cnt, 0.05::DOUBLE) AS st FROM (
        SELECT symbol, n, 50.0::DOUBLE / n AS pg, CASE WHEN floor(n * 0.8::DOUBLE) >= 26280 THEN 5 WHEN floor(n * 0.8::DOUBLE) >= 13140 THEN 3 ELSE 2 END AS cnt,
          (0.8::DOUBLE - 0.8::DOUBLE * 0.5::DOUBLE - 0.2::DOUBLE * 0.8::DOUBLE) - 50.0::DOUBLE / n AS room FROM li_lens WHERE n >= 1000 AND floor(n * 0.8::DOUBLE) >= 1000)
    ) q, LATERAL (SELECT unnest(range(cnt)) AS fold)) WHERE e <= 0.8::DOUBLE)) WHERE z > b"""


def _lengths(spark, d):
    li = T.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    o = T.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return li.unionByName(o)


@query("wf_folds", " UNION ALL ".join(_fold_sql(q) for q in (_STATIC, _CUSTOM, _CEIL)))
def wf_folds(spark, d):
    n, rules = _lengths(spark, d), FD.FoldRules(minimum=1000)
    parts = [("static", {}), ("custom", {"n_folds": 4}), ("ceiling", {"ceiling": 0.8})]
    rows = None
    for mode, kw in parts:
        f = FD.walk_forward(n, rules, **kw).withColumn("mode", F.lit(mode))
        rows = f if rows is None else rows.unionByName(f)
    return tidy(rows, "mode", "symbol", "fold", "train_end", "test_start", "test_end", "train_end_i", "test_start_i", "test_end_i")


@query("oos_windows", """SELECT symbol, w AS "window", ceiling_i + w * sz AS start_i, CASE WHEN w = windows - 1 THEN n ELSE ceiling_i + (w + 1) * sz END AS end_i FROM (
  SELECT symbol, n, windows, ceiling_i, (n - ceiling_i) // windows AS sz FROM (
    SELECT symbol, n, CASE WHEN n >= 13140 THEN 3 ELSE 1 END AS windows,
      (floor(n * CASE WHEN n >= 26280 THEN 0.70::DOUBLE WHEN n >= 13140 THEN 0.75::DOUBLE ELSE 0.80::DOUBLE END))::BIGINT AS ceiling_i FROM li_lens)) q,
  LATERAL (SELECT unnest(range(windows)) AS w) WHERE CASE WHEN w = windows - 1 THEN n ELSE ceiling_i + (w + 1) * sz END - (ceiling_i + w * sz) >= 100""")
def oos_windows(spark, d):
    return tidy(FD.out_of_sample(_lengths(spark, d)), "symbol", "window", "start_i", "end_i")


@query("sweep_size", "SELECT symbol, n, CASE WHEN n >= 39420 THEN 50000 WHEN n >= 21900 THEN 30000 ELSE 20000 END::BIGINT AS trials FROM li_lens")
def sweep_size(spark, d):
    return tidy(_lengths(spark, d).withColumn("trials", FD.sweep_size(F.col("n"))))


@query("cscv_block_rows", f"""SELECT c.combo, c.side_name AS role, b.symbol, count(*) AS n_rows, {r6('sum(b.close)', 'sum_close')} FROM (
  SELECT bars.*, i // (n // 6) AS block FROM bars JOIN lens USING (symbol) WHERE i // (n // 6) < 6) b JOIN (
  SELECT m AS combo, q AS block, CASE WHEN (m >> q) & 1 = 1 THEN 'train' ELSE 'test' END AS side_name FROM range(64) r(m), range(6) s(q) WHERE bit_count(m) = 3) c USING (block)
  GROUP BY ALL""")
def cscv_block_rows(spark, d):
    b = bars(spark, d)
    rows = FD.row_blocks(b, FD.series_lengths(b), 6)
    # blocks are summarised before they meet the combinations they belong to
    per = rows.groupBy("symbol", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("s"))
    g = per.join(F.broadcast(FD.cscv_combinations(spark, 6)), "block").groupBy("combo", "role", "symbol").agg(
        F.sum("n").alias("n_rows"), F.sum("s").alias("sum_close"))
    return tidy(g)


cte("sw_train", "SELECT symbol, param_id, fold // 2 AS fold, trades_per_year FROM ef_m_x WHERE fold % 2 = 0")
cte("ef_m_x", f"SELECT *, {score(5)} AS score FROM ef_m")
cte("sw_test", "SELECT symbol, param_id, fold // 2 AS fold, trades, score FROM ef_m_x WHERE fold % 2 = 1")
cte("sw", """SELECT wf.symbol, p.param_id, wf.fold, coalesce(t.trades, 0) AS test_trades,
  CASE WHEN coalesce(r.trades_per_year, 0) >= 60 AND coalesce(t.trades, 0) >= 5 THEN t.score ELSE 0 END AS score
  FROM wf CROSS JOIN params p LEFT JOIN sw_train r USING (symbol, param_id, fold) LEFT JOIN sw_test t USING (symbol, param_id, fold)""")
cte("sw_mean", "SELECT symbol, param_id, round(avg(score), 9) AS score FROM sw GROUP BY ALL")


def _sweep(spark, d):
    b, res = resolved(spark, d, GRID)
    f = FD.walk_forward(FD.series_lengths(b), RULES)
    return SW.sweep(res, f, b, REACH, range(12), ACCT, min_year=60, min_test=5)


@query("sweep_scores", f"SELECT symbol, param_id::BIGINT AS param_id, fold::BIGINT AS fold, test_trades, {out('score')} FROM sw")
def sweep_scores(spark, d):
    return tidy(_sweep(spark, d), "symbol", "param_id", "fold", "test_trades", "score")


@query("sweep_best", f"""SELECT symbol, param_id::BIGINT AS param_id, {out('score')} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, param_id) AS k FROM sw_mean) WHERE k = 1""")
def sweep_best(spark, d):
    return tidy(SW.best_sets(_sweep(spark, d)), "symbol", "param_id", "score")


@query("halving_rung", f"""SELECT symbol, param_id::BIGINT AS param_id, {out('score')} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, param_id) AS k FROM sw_mean) WHERE k <= 6""")
def halving_rung(spark, d):
    m = SW.mean_scores(_sweep(spark, d)).withColumn("bucket", F.floor(-F.col("score") * 16).cast("bigint"))
    return tidy(SEL.better_half(m, ["symbol"], ["bucket"]), "symbol", "param_id", "score")


# ---------------------------------------------------------------- parameter sets as a table
SPACE = FD.SearchSpace({
    "fast": FD.Range(2, 6), "slow": FD.Range(8, 16, True), "signal": FD.Range(2, 5, True), "rsi_period": FD.Range(5, 9, True),
    "rsi_lower": FD.Range(50, 65), "rsi_upper": FD.Range(35, 50), "rsi_lookback": FD.Range(0, 4, True), "adx_min": FD.Range(5, 15),
    "hard_stop": FD.Range(1, 2), "trail": FD.Range(0.8, 1.6), "max_hold": FD.Range(8, 24, True)})
#: Sets of the overfitting score (100 drawn and one more) and of the sweep, blocks, least trades of a score.
PBO_SETS, SWEEP_SETS, BLOCKS, MIN_TEST = 101, 1000, 8, 5


def random_sets(spark, n):
    sets = FD.random_sets(spark, n, SPACE, 42, uniform=text_uniform)
    return settle(sets.withColumns({c: F.col(c).cast("int") for c in ("rsi_period", "rsi_lookback", "max_hold")}))


def _draw(name):
    return f"('0x' || substr(md5('42|' || k || '|{name}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _value(name, r):
    u = _draw(name)
    if r.whole:
        return f"(floor({u} * {int(r.hi) - int(r.lo) + 1}) + {int(r.lo)})::DOUBLE AS {name}"
    return f"{float(r.lo)}::DOUBLE + {u} * ({float(r.hi)}::DOUBLE - {float(r.lo)}::DOUBLE) AS {name}"


def _params_cte(name, n):
    cte(name, f"""SELECT * REPLACE (CASE WHEN slow - fast < 5 THEN floor(fast) + 5 ELSE slow END AS slow, max_hold::BIGINT AS max_hold) FROM (
      SELECT k AS param_id, {', '.join(_value(c, r) for c, r in SPACE.ranges.items())},
        (['4h', '8h', '1d'])[1 + (floor({_draw('trend_tf')} * 3))::BIGINT] AS trend_tf FROM range({n}) r(k))""")


# the chain of tables from parameter sets to exits, once more for these sets
_CHAIN = ["combos", "macds", "macd_rows", "cross_rows", "hm_4h", "hm_8h", "hm_1d", "trend_4h", "trend_8h", "trend_1d"]
_AFTER = ["ents", "opps", "walked", "levels", "barriers", "exits0", "resolved"]
_zone = " UNION ALL ".join(
    f"""SELECT symbol, i, {n} AS rsi_period, {m} AS rsi_lookback, rsi, min(rsi) OVER w AS rsi_min, max(rsi) OVER w AS rsi_max
      FROM (SELECT symbol, t, i, {rsi_sql(n)} AS rsi FROM deltas) WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS {m} PRECEDING)"""
    for n in range(5, 10) for m in range(5))
cte("zones_long", _zone)
_params_cte("q_params", PBO_SETS)
fork("q_", _CHAIN, ["params"])
cte("q_trends", " UNION ALL ".join(f"SELECT '{tf}' AS trend_tf, * FROM q_trend_{tf}" for tf in ("4h", "8h", "1d")))
cte("q_sig_free", """SELECT h.symbol, h.param_id, h.i, f.t, h.crossed AS fired, abs(h.macd - h.sig) / CASE WHEN f.atr > 0 THEN f.atr ELSE 1e-8 END + abs(z.rsi - 50) / 50 AS strength,
    f.high, f.low, f.close
  FROM (SELECT c.*, p.param_id, p.trend_tf, p.rsi_period, p.rsi_lookback, p.rsi_lower, p.rsi_upper, p.adx_min, b.t AS base_t
    FROM q_cross_rows c JOIN q_params p USING (fast, slow, signal) JOIN bars b USING (symbol, i) WHERE c.crossed <> 0) h
  JOIN zones_long z ON z.symbol = h.symbol AND z.i = h.i AND z.rsi_period = h.rsi_period AND z.rsi_lookback = h.rsi_lookback
    AND CASE WHEN h.crossed = 1 THEN z.rsi_min < h.rsi_lower ELSE z.rsi_max > h.rsi_upper END
  JOIN feats f ON f.symbol = h.symbol AND f.i = h.i AND f.adx >= h.adx_min
  ASOF JOIN q_trends tr ON h.symbol = tr.symbol AND h.trend_tf = tr.trend_tf AND h.fast = tr.fast AND h.slow = tr.slow AND h.signal = tr.signal AND h.base_t >= tr.ends
  WHERE tr.bull = (h.crossed = 1)""")
fork("q_", _AFTER, ["params", "sig_free"])
cte("f_blocks8", f"SELECT symbol, b AS fold, b * (n // {BLOCKS}) AS start_i, (b + 1) * (n // {BLOCKS}) AS end_i FROM lens, range({BLOCKS}) r(b)")
cte("combos8", f"""SELECT m AS combo, b AS block, CASE WHEN (m >> b) & 1 = 1 THEN 'train' ELSE 'test' END AS side_name
  FROM range({1 << BLOCKS}) r(m), range({BLOCKS}) q(b) WHERE bit_count(m) = {BLOCKS // 2}""")
cte("sides8", "SELECT combo, side_name, min(block) AS lo, max(block) AS hi FROM combos8 GROUP BY ALL")
cte("f_spans8", f"SELECT symbol, lo * {BLOCKS} + hi AS fold, lo * (n // {BLOCKS}) AS start_i, (hi + 1) * (n // {BLOCKS}) AS end_i FROM lens, (SELECT DISTINCT lo, hi FROM sides8)")
engine("q_eb", "f_blocks8", "q_resolved")
engine("q_es", "f_spans8", "q_resolved")
metrics("q_es_m", "q_es", "symbol, param_id, fold", "i", "days", "100000.0::DOUBLE")
# sweep: the same chain for more sets
_Q = ["q_" + n for n in (*_CHAIN, "trends", "sig_free", *_AFTER)]
_params_cte("kq_params", SWEEP_SETS)
fork("k", _Q, ["q_params"])
engine("k_ef", "f_wf", "kq_resolved")
metrics("k_ef_m", "k_ef", "symbol, param_id, fold", "i", "days", "100000.0::DOUBLE")
cte("k_ef_x", f"SELECT *, {score(MIN_TEST)} AS score FROM k_ef_m")
cte("k_sw", f"""SELECT wf.symbol, p.param_id, wf.fold, coalesce(t.trades, 0) AS test_trades,
  CASE WHEN coalesce(r.trades_per_year, 0) >= 60 AND coalesce(t.trades, 0) >= {MIN_TEST} THEN t.score ELSE 0 END AS score
  FROM wf CROSS JOIN kq_params p LEFT JOIN k_ef_x r ON r.fold = wf.fold * 2 AND r.symbol = wf.symbol AND r.param_id = p.param_id
  LEFT JOIN k_ef_x t ON t.fold = wf.fold * 2 + 1 AND t.symbol = wf.symbol AND t.param_id = p.param_id""")


@query("random_parameter_sets", f"""SELECT param_id::BIGINT AS param_id, {out(*SPACE.ranges)}, trend_tf, (SELECT count(*) FROM events) AS n_ticks FROM (
  SELECT * REPLACE (max_hold::DOUBLE AS max_hold) FROM kq_params)""")
def random_parameter_sets(spark, d):
    sets = random_sets(spark, SWEEP_SETS).withColumns({c: F.col(c).cast("double") for c in SPACE.ranges})
    n = T.table(spark, d, "events").count()
    return tidy(sets.withColumn("n_ticks", F.lit(n).cast("bigint")), "param_id", *SPACE.ranges, "trend_tf", "n_ticks")


@query("sets_signals", f"SELECT symbol, param_id::BIGINT AS param_id, i::BIGINT AS i, fired::BIGINT AS fired, {out('strength')} FROM kq_sig_free")
def sets_signals(spark, d):
    return tidy(P.signals_of_sets(bars(spark, d), random_sets(spark, SWEEP_SETS)), "symbol", "param_id", "i", "fired", "strength")


def _sets_sweep(spark, d):
    b, sets = bars(spark, d), random_sets(spark, SWEEP_SETS)
    res, reach = P.resolved_of_sets(b, sets, slip())
    f = FD.walk_forward(FD.series_lengths(b), RULES)
    return SW.sweep(res, f, b, reach, sets, ACCT, min_year=60, min_test=MIN_TEST)


@query("sets_sweep", f"SELECT symbol, param_id::BIGINT AS param_id, fold::BIGINT AS fold, test_trades, {out('score')} FROM k_sw")
def sets_sweep(spark, d):
    return tidy(_sets_sweep(spark, d), "symbol", "param_id", "fold", "test_trades", "score")

# three folds of one length: each rung of successive halving scores one more
RUNGS = 3
cte("wf3", f"""SELECT symbol, fold, (floor(n::DOUBLE * train_end))::BIGINT AS train_end_i, (floor(n::DOUBLE * test_start))::BIGINT AS test_start_i,
    (floor(n::DOUBLE * test_end))::BIGINT AS test_end_i FROM (
  SELECT *, least(test_start + 0.2::DOUBLE, 1.0::DOUBLE) AS test_end FROM (SELECT *, train_end + pg AS test_start FROM (
    SELECT symbol, n, fold, pg, 0.5::DOUBLE + (fold + 1) * (((1.0::DOUBLE - 0.5::DOUBLE - 0.2::DOUBLE) - pg) / {RUNGS}) AS train_end
    FROM (SELECT *, {RULES.purge}.0::DOUBLE / n AS pg FROM lens WHERE n >= {RULES.minimum}), range({RUNGS}) r(fold))))""")
cte("f_wf3", """SELECT symbol, fold * 2 AS fold, 0 AS start_i, train_end_i AS end_i FROM wf3
  UNION ALL SELECT symbol, fold * 2 + 1, test_start_i, test_end_i FROM wf3""")
engine("h_ef", "f_wf3", "kq_resolved")
metrics("h_ef_m", "h_ef", "symbol, param_id, fold", "i", "days", "100000.0::DOUBLE")
cte("h_ef_x", f"SELECT *, {score(MIN_TEST)} AS score FROM h_ef_m")
cte("h_sw", f"""SELECT wf3.symbol, p.param_id, wf3.fold,
  CASE WHEN coalesce(r.trades_per_year, 0) >= 60 AND coalesce(t.trades, 0) >= {MIN_TEST} THEN t.score ELSE 0 END AS score
  FROM wf3 CROSS JOIN kq_params p LEFT JOIN h_ef_x r ON r.fold = wf3.fold * 2 AND r.symbol = wf3.symbol AND r.param_id = p.param_id
  LEFT JOIN h_ef_x t ON t.fold = wf3.fold * 2 + 1 AND t.symbol = wf3.symbol AND t.param_id = p.param_id""")
for _k in range(RUNGS):  # all folds scored, then cut rung by rung
    cte(f"rung{_k}", f"""SELECT symbol, param_id, {_k} AS rung, score, evaluated FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, param_id) AS pos, count(*) OVER (PARTITION BY symbol) AS evaluated FROM (
        SELECT symbol, param_id, round(avg(score), 9) AS score FROM h_sw {f"SEMI JOIN rung{_k - 1} USING (symbol, param_id)" if _k else ""}
        WHERE fold <= {_k} GROUP BY ALL)) WHERE pos <= (evaluated + 1) // 2""")


@query("halving_rungs", " UNION ALL ".join(
    f"SELECT symbol, param_id::BIGINT AS param_id, rung::BIGINT AS rung, {out('score')}, evaluated FROM rung{k}" for k in range(RUNGS)))
def halving_rungs(spark, d):
    b, sets = bars(spark, d), random_sets(spark, SWEEP_SETS)
    res, reach = P.resolved_of_sets(b, sets, slip())
    f = FD.walk_forward(FD.series_lengths(b), RULES, n_folds=RUNGS)
    rows = SW.successive_halving(res, f, b, reach, sets, RUNGS, ACCT, min_year=60, min_test=MIN_TEST)
    return tidy(rows, "symbol", "param_id", "rung", "score", "evaluated")

# out-of-sample windows through the engine, at the reference's fractions, counts and least trades
cte("oosw", """SELECT symbol, n, ceiling_i, w AS win, ceiling_i + w * sz AS start_i, CASE WHEN w = windows - 1 THEN n ELSE ceiling_i + (w + 1) * sz END AS end_i FROM (
  SELECT symbol, n, windows, ceiling_i, (n - ceiling_i) // windows AS sz FROM (
    SELECT symbol, n, CASE WHEN n >= 13140 THEN 3 ELSE 1 END AS windows,
      (floor(n * CASE WHEN n >= 26280 THEN 0.70::DOUBLE WHEN n >= 13140 THEN 0.75::DOUBLE ELSE 0.80::DOUBLE END))::BIGINT AS ceiling_i FROM lens)) q,
  LATERAL (SELECT unnest(range(windows)) AS w)""")
cte("f_oos", """SELECT symbol, win + 1 AS fold, start_i, end_i FROM oosw WHERE end_i - start_i >= 100
  UNION ALL SELECT DISTINCT symbol, 0, 0, ceiling_i FROM oosw WHERE end_i - start_i >= 100""")
engine("o_e", "f_oos", "q_resolved")
metrics("o_m", "o_e", "symbol, param_id, fold", "i", "days", "100000.0::DOUBLE")
cte("o_rows", """SELECT w.symbol, p.param_id, w.win, coalesce(CASE WHEN m.trades >= 3 THEN m.sharpe_trade END, 0) AS sharpe,
    coalesce(CASE WHEN b.trades >= 3 THEN b.sharpe_trade END, 0) AS base
  FROM (SELECT * FROM oosw WHERE end_i - start_i >= 100) w CROSS JOIN q_params p
  LEFT JOIN o_m m ON m.symbol = w.symbol AND m.param_id = p.param_id AND m.fold = w.win + 1
  LEFT JOIN o_m b ON b.symbol = w.symbol AND b.param_id = p.param_id AND b.fold = 0""")


@query("oos_evaluated", f"""SELECT symbol, param_id::BIGINT AS param_id, count(*) AS n_windows, {r6('median(sharpe)', 'median_sharpe')}, {r6('stddev_pop(sharpe)', 'std_sharpe')},
  {r6('min(sharpe)', 'worst_sharpe')}, {r6('max(base)', 'base_sharpe')}, {r6('CASE WHEN max(base) > 0 THEN median(sharpe) / max(base) ELSE 0 END', 'retention')}
  FROM o_rows GROUP BY symbol, param_id""")
def oos_evaluated(spark, d):
    b, sets = bars(spark, d), random_sets(spark, PBO_SETS)
    res, reach = P.resolved_of_sets(b, sets, slip())
    scores = SW.out_of_sample_scores(res, settle(FD.out_of_sample(FD.series_lengths(b))), b, reach, sets, ACCT)
    rows = V.window_aggregate(scores, ["symbol", "param_id"], "score", "base", "window")
    return tidy(rows, "symbol", "param_id", "n_windows", "median_sharpe", "std_sharpe", "worst_sharpe", "base_sharpe", "retention")


cte("sp_side", f"""SELECT s.combo, s.side_name, m.symbol, m.param_id, {score(MIN_TEST)} AS score FROM q_es_m m JOIN sides8 s ON m.fold = s.lo * {BLOCKS} + s.hi""")
# every combination with its own copy of the trades, equity relative to its start
cte("un_path", f"""SELECT *, max(p) OVER w AS top, sum(g) OVER (PARTITION BY symbol, param_id, combo, side_name, exit_day) AS day_g,
    row_number() OVER (PARTITION BY symbol, param_id, combo, side_name, exit_day ORDER BY i) AS day_k FROM (
    SELECT *, sum(g) OVER w AS p FROM (SELECT t.*, ln(1 + 0.2::DOUBLE * ret) AS g, c.combo, c.side_name FROM q_eb_ret t JOIN combos8 c ON c.block = t.fold)
    WINDOW w AS (PARTITION BY symbol, param_id, combo, side_name ORDER BY i ROWS UNBOUNDED PRECEDING))
  WINDOW w AS (PARTITION BY symbol, param_id, combo, side_name ORDER BY i ROWS UNBOUNDED PRECEDING)""")
cte("un_sum", f"""SELECT symbol, param_id, combo, side_name, count(*) AS trades, (exp(sum(g)) - 1) * 100 AS total_pnl_pct,
    (exp(min(p - greatest(top, 0))) - 1) * 100 AS max_drawdown, min(exit_day) AS lo, max(exit_day) AS hi, max(days) * {BLOCKS // 2} AS days FROM un_path GROUP BY ALL""")
cte("un_days", """SELECT symbol, param_id, combo, side_name, sum(exp(day_g) - 1) AS total, sum((exp(day_g) - 1) * (exp(day_g) - 1)) AS squares
  FROM un_path JOIN un_sum USING (symbol, param_id, combo, side_name) WHERE day_k = 1 AND exit_day > lo GROUP BY ALL""")
cte("un_m", """SELECT * EXCLUDE (total, squares), CASE WHEN days >= 30 AND hi - lo > 1 AND dev > 1e-12 THEN mean / dev * sqrt(365) ELSE 0 END AS sharpe_daily FROM (
  SELECT *, sqrt(greatest((squares - mean * mean * (hi - lo)) / nullif(hi - lo - 1, 0), 0)) AS dev FROM (
    SELECT s.*, coalesce(total, 0) AS total, coalesce(squares, 0) AS squares, coalesce(total, 0) / nullif(hi - lo, 0) AS mean
    FROM un_sum s LEFT JOIN un_days d USING (symbol, param_id, combo, side_name)))""")
cte("un_side", f"SELECT combo, side_name, symbol, param_id, {score(MIN_TEST)} AS score FROM un_m")


def _pbo_sql(src):
    return f"""WITH w AS (SELECT l.symbol, p.param_id, c.combo, coalesce(max(CASE WHEN side_name = 'train' THEN score END), 0) AS tr,
      coalesce(max(CASE WHEN side_name = 'test' THEN score END), 0) AS te FROM lens l CROSS JOIN q_params p CROSS JOIN (SELECT DISTINCT combo FROM combos8) c
      LEFT JOIN {src} s ON s.symbol = l.symbol AND s.param_id = p.param_id AND s.combo = c.combo GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol, combo ORDER BY round(tr, 9) DESC, param_id) AS isr,
      row_number() OVER (PARTITION BY symbol, combo ORDER BY round(te, 9) DESC, param_id) AS oos FROM w),
    g AS (SELECT symbol, avg(CASE WHEN oos >= {PBO_SETS // 2} THEN 1.0::DOUBLE ELSE 0 END) AS pbo, count(*) AS n_combos, string_agg(oos::VARCHAR, ',' ORDER BY oos) AS ranks FROM r WHERE isr = 1 GROUP BY symbol)
    SELECT symbol, n_combos, ranks, {out('pbo')}, {r6('ln(least(greatest(pbo, 1e-6::DOUBLE), (1 - 1e-6::DOUBLE)) / (1 - least(greatest(pbo, 1e-6::DOUBLE), (1 - 1e-6::DOUBLE))))', 'logit')} FROM g"""


def _pbo(spark, d, span):
    b, sets = bars(spark, d), random_sets(spark, PBO_SETS)
    res, reach = P.resolved_of_sets(b, sets, slip())
    scores = SW.cscv_scores(res, FD.series_lengths(b), b, BLOCKS, reach, sets, ACCT, span, MIN_TEST)
    return tidy(V.pbo(scores, ["symbol"]), "symbol", "n_combos", "ranks", "pbo", "logit")


def _merge_with(sql):
    """Inner WITH of a query body becomes a derived table so that shared expressions lead."""
    return f"SELECT * FROM ({sql})"


@query("pbo_score", _merge_with(_pbo_sql("un_side")))
def pbo_score(spark, d):
    return _pbo(spark, d, False)


@query("pbo_score_span", _merge_with(_pbo_sql("sp_side")))
def pbo_score_span(spark, d):
    return _pbo(spark, d, True)
