"""Sizing, exposure counts, marked equity, volatility fits, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import case_map
from ..operators import decisions as D
from ..operators import indicators as I
from ..operators import metrics as M
from ..operators import reports as R
from ..operators import selection as SEL
from ..operators import signals as S
from ..operators import sizing as Z
from ..operators import validation as V
from ..operators.bars import ticks_to_bars
from ..operators.scan import bar_index
from ..sources import tables as T
from ..sources.scratch import scratch_dir, settle
from ..streaming import live
from .bar_queries import ONE, bars, tail_edges
from .engine_queries import one_run
from .registry import cte, query, r6, tidy
from .templates import out

GATE = 0.02
NOTIONAL = 20_000.0

cte("near", "SELECT a AS symbol, b AS other FROM tail_edges WHERE abs(corr) > 0.02 UNION ALL SELECT b, a FROM tail_edges WHERE abs(corr) > 0.02")
cte("held", "SELECT e.*, d.cluster, d.oi, d.tier FROM e1 e JOIN dims d USING (symbol)")
cte("counts", """SELECT h.symbol, h.i, h.entry_t, (SELECT count(*) FROM held o WHERE o.cluster = h.cluster AND o.entry_t < h.entry_t AND o.exit_t > h.entry_t) AS cluster_open,
  (SELECT count(*) FROM held o JOIN near n ON n.other = o.symbol WHERE n.symbol = h.symbol AND o.entry_t < h.entry_t AND o.exit_t > h.entry_t) AS correlated_open FROM held h""")


def held(spark, d):
    b, t = one_run(spark, d)
    return b, t.withColumn("cluster", case_map("symbol", T.CLUSTER))


@query("cluster_open_count", "SELECT symbol, i::BIGINT AS i, cluster_open FROM counts")
def cluster_open_count(spark, d):
    t = held(spark, d)[1]
    return tidy(Z.open_in_cluster(t, t), "symbol", "i", "cluster_open")


@query("correlated_open_count", "SELECT symbol, i::BIGINT AS i, correlated_open FROM counts")
def correlated_open_count(spark, d):
    b, t = held(spark, d)
    return tidy(Z.open_correlated(t, t, tail_edges(b), GATE), "symbol", "i", "correlated_open")


@query("position_size", f"""SELECT c.symbol, c.i::BIGINT AS i, {r6('''least(greatest(w.weight * pow(0.9::DOUBLE, c.correlated_open) * CASE WHEN cv.v IS NULL THEN 1.0::DOUBLE ELSE least(greatest(2.0::DOUBLE / sqrt(cv.v), 0.5), 2.0) END
    * CASE WHEN d.oi > 0.06 THEN 0.7::DOUBLE ELSE 1 END, 0.05), 0.20) * CASE d.tier WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.6 WHEN 'C' THEN 0.25 ELSE 0 END''', 'pct')}
  FROM counts c JOIN inv_vol w ON w.symbol = c.symbol AND w.i = c.i JOIN dims d ON d.symbol = c.symbol LEFT JOIN cv ON cv.symbol = c.symbol AND cv.i = c.i""")
def position_size(spark, d):
    b, t = held(spark, d)
    w = Z.inverse_vol_weight(I.atr_adx(b)).select("symbol", "i", F.col("weight").alias("iv"))
    v = I.conditional_variance(b, 0.8, 0.1, 0.7, 72).select("symbol", "i", "vol_ratio")
    rows = Z.open_correlated(t, t, tail_edges(b), GATE).join(w, ["symbol", "i"]).join(v, ["symbol", "i"])
    tier = D.multiplier(case_map("symbol", T.TIER))
    pct = Z.position_pct(F.col("iv"), F.col("correlated_open"), F.col("vol_ratio"), F.lit(1.0), case_map("symbol", T.OI_RATIO, 0.0), tier)
    return tidy(rows.withColumn("pct", pct), "symbol", "i", "pct")


cte("ranked", """SELECT s.symbol, s.i, s.t AS entry_t, s.fired AS side, s.strength, row_number() OVER (PARTITION BY s.t ORDER BY s.strength *
  CASE d.tier WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.6 WHEN 'C' THEN 0.25 ELSE 0 END DESC, s.symbol) AS rank
  FROM sig_free s JOIN dims d USING (symbol) WHERE s.param_id = 1 AND s.fired <> 0""")


def _ranked(cands):
    return SEL.rank_candidates(cands, [], weight=D.multiplier(case_map("symbol", T.TIER)))


@query("candidate_rank", "SELECT symbol, i::BIGINT AS i, rank FROM ranked")
def candidate_rank(spark, d):
    sig = S.signal_rows(bars(spark, d), ONE).filter("fired != 0").withColumn("entry_t", F.col("t"))
    return tidy(_ranked(sig), "symbol", "i", "rank")


cte("cover", """SELECT e.symbol, e.i AS entry_i, b.t, 20000.0::DOUBLE * e.side * (b.close / e.entry_price - 1) AS mark FROM e1 e
  JOIN bars b ON b.symbol = e.symbol AND b.i BETWEEN e.i AND e.exit_i - 1""")
cte("mk", """SELECT t, realised, u, n_open, 100000.0::DOUBLE + realised + u AS equity FROM (
  SELECT g.t, sum(coalesce(r.r, 0)) OVER (ORDER BY g.t) AS realised, coalesce(o.u, 0) AS u, coalesce(o.n, 0) AS n_open FROM (SELECT DISTINCT t FROM bars) g
  LEFT JOIN (SELECT t, sum(mark) AS u, count(*) AS n FROM cover GROUP BY t) o USING (t) LEFT JOIN (SELECT exit_t AS t, sum(20000.0::DOUBLE * ret) AS r FROM e1 GROUP BY 1) r USING (t))""")
cte("mkp", "SELECT *, (equity - peak) / peak * 100 AS drawdown FROM (SELECT *, greatest(100000.0::DOUBLE, max(equity) OVER (ORDER BY t)) AS peak FROM mk)")


def _marked(spark, d):
    b, t = one_run(spark, d)
    t = t.withColumn("notional", F.lit(NOTIONAL))
    return b, t, Z.marked_equity(t, b, 100_000.0)


@query("marked_equity", f"SELECT t, n_open, {out('realised', 'equity', 'peak', 'drawdown', digits=3)}, {r6('u', 'unrealised', 3)} FROM mkp")
def marked_equity(spark, d):
    return tidy(_marked(spark, d)[2], digits=3)


@query("portfolio_calmar", f"""SELECT {r6('last(equity ORDER BY t)', 'final_equity', 3)}, {r6('(last(equity ORDER BY t) / 100000.0::DOUBLE - 1) / 0.08::DOUBLE / greatest(abs(min(drawdown)) / 100, 0.05::DOUBLE)', 'calmar', 3)} FROM mkp""")
def portfolio_calmar(spark, d):
    return tidy(M.portfolio_calmar(_marked(spark, d)[2], 100_000.0, 0.08, "t"), digits=3)


@query("heat_breaches", f"""SELECT m.t, {out('equity', 'drawdown', digits=3)}, w.symbol AS worst_symbol, {r6('w.mark', 'worst_mark', 3)} FROM mkp m LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY mark, symbol) AS k FROM cover) w ON w.t = m.t AND w.k = 1 WHERE m.drawdown < -1""")
def heat_breaches(spark, d):
    b, t, curve = _marked(spark, d)
    return tidy(Z.heat_breaches(settle(curve), t, b, 0.01), digits=3)


# all ticks as one series by the minute; windows, steps and grid of the reference's size
WIN, EVERY = 720, 168
ALPHAS, BETAS = [0.02 + 0.03 * k for k in range(10)], [0.50 + 0.05 * k for k in range(10)]
cte("pct", "SELECT 'all' AS symbol, i, ln(1 + ret) * 100 AS pct FROM rets_min WHERE ret IS NOT NULL")
cte("vw", f"""SELECT k * {EVERY} AS p, x.symbol, x.pct, x.i - (k * {EVERY} - {WIN}) - 1 AS j FROM range(1, 100000) r(k) JOIN pct x ON x.i > k * {EVERY} - {WIN} AND x.i <= k * {EVERY}
  WHERE k * {EVERY} >= {WIN} AND k * {EVERY} <= (SELECT max(i) FROM pct)""")
cte("vv", f"SELECT symbol, p, var_pop(pct) AS var FROM vw GROUP BY 1, 2 HAVING count(*) >= {WIN - 1}")
cte("vg", "SELECT * FROM (VALUES " + ", ".join(f"({a!r}::DOUBLE)" for a in ALPHAS) + ") x(alpha), (VALUES " + ", ".join(
    f"({b!r}::DOUBLE)" for b in BETAS) + ") y(beta) WHERE alpha + beta < 1")
cte("vr", """SELECT symbol, p, alpha, beta, 0::BIGINT, var, 0.0::DOUBLE, var FROM vv, vg
  UNION ALL SELECT r.symbol, r.p, r.alpha, r.beta, r.j + 1, r.var * (1 - r.alpha - r.beta) + r.alpha * x.pct * x.pct + r.beta * r.v, r.nll + ln(r.v) + x.pct * x.pct / r.v, r.var
  FROM vr r JOIN vw x ON x.symbol = r.symbol AND x.p = r.p AND x.j = r.j""", "(symbol, p, alpha, beta, j, v, nll, var)")


@query("volatility_grid", f"""SELECT symbol, p AS refit_i, {out('alpha', 'beta')}, {r6('var * (1 - alpha - beta)', 'omega')}, {out('nll')} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, p ORDER BY nll, alpha, beta) AS k FROM (SELECT *, max(j) OVER (PARTITION BY symbol, p, alpha, beta) AS mj FROM vr) WHERE j = mj) WHERE k = 1""")
def volatility_grid(spark, d):
    ticks = T.ticks(spark, d).withColumn("symbol", F.lit("all"))
    b = bar_index(settle(ticks_to_bars(ticks, 60)), width=60)
    r = I.returns(b).select("symbol", "i", (F.col("log_ret") * 100).alias("pct"))
    return tidy(V.volatility_grid(r, ["symbol"], WIN, EVERY, ALPHAS, BETAS), "symbol", "refit_i", "alpha", "beta", "omega", "nll")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("param_matrix", "SELECT param, " + ", ".join(r6(f"max(CASE WHEN symbol = '{p}' THEN v END)", f'"{p}"') for p in PRIORITIES) + """ FROM (
  SELECT symbol, unnest(['number', 'objective', 'second']) AS param, unnest([number::DOUBLE, objective, second]) AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY objective DESC, number) AS k FROM trials) WHERE k = 1) GROUP BY param""")
def param_matrix(spark, d):
    best = SEL.best_per_key(T.trial_log(spark, d), ["symbol"], "objective", "number")
    return tidy(R.parameter_matrix(best, "symbol", ["number", "objective", "second"], PRIORITIES))


@query("stream_hourly_bars", f"SELECT symbol, t, {out('open', 'high', 'low', 'close', 'volume')} FROM bars0")
def stream_hourly_bars(spark, d):
    """The tick stream run to its end; the bars that the last watermark left open are completed
    from their ticks in batch."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = live.hourly_bars(live.tick_stream(spark, d, name="events.parquet"))
    q = rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(
        availableNow=True).start(f"{base}/bars")
    q.awaitTermination()
    closed = spark.read.schema(rows.schema).parquet(f"{base}/bars")
    ticks = T.ticks(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    rest = live.hourly_bars(live.open_ticks(ticks, closed))
    return tidy(closed.unionByName(rest), "symbol", "t", "open", "high", "low", "close", "volume")
