"""Bars, indicators, alignment and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import correlation as C
from ..operators import indicators as I
from ..operators import signals as S
from ..operators.scan import ema, linear_recurrences
from ..sources import tables as T
from ..sources.scratch import settle
from .registry import cte, query, r6, tidy

# ---------------------------------------------------------------- parameter sets
BENCH = S.Benchmark(T.BENCHMARK, "4h", 3.0, 8, 3)


def param_set(k: int) -> dict:
    return dict(
        param_id=k, fast=2.5 + 0.5 * (k % 3), slow=8.0 + 2 * (k // 3 % 2), signal=3.0,
        rsi_period=7, rsi_lower=60, rsi_upper=40, rsi_lookback=3,
        trend_tf="4h" if k % 2 == 0 else "8h", adx_min=5.0 + 5 * (k // 6),
        hard_stop=1.0 + 0.5 * (k % 2), trail=0.8 + 0.4 * (k // 2 % 2), max_hold=12 + 12 * (k % 2),
    )


GRID = [param_set(k) for k in range(12)]
ONE = [dict(GRID[1], param_id=0)]


def bars(spark, d):
    return settle(T.bars(spark, d))


cte("ticks", "SELECT event_type AS symbol, ts, event_id AS seq, 100.0::DOUBLE + value / 10 AS price FROM events")
cte("bars0", """SELECT symbol, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS t, first(price ORDER BY ts, seq) AS open,
  max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, count(*)::DOUBLE AS volume
  FROM ticks GROUP BY 1, 2""")
cte("bars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM bars0")


for _tf, _w in (("bars_4h", 14400), ("bars_8h", 28800), ("bars_1d", 86400)):
    cte(_tf, f"""SELECT symbol, g AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY t) AS close, sum(volume) AS volume FROM (SELECT *, (t // {_w} * {_w})::BIGINT AS g FROM bars0)
  GROUP BY symbol, g""")

BAR_OUT = ", ".join(["symbol", "t"] + [r6(c) for c in ("open", "high", "low", "close", "volume")])


@query("bars_1h", f"SELECT {BAR_OUT}, i::BIGINT AS i FROM bars")
def bars_1h(spark, d):
    return tidy(T.bars(spark, d), "symbol", "t", "open", "high", "low", "close", "volume", "i")


@query("bars_many_series", f"""WITH m AS (SELECT user_id::VARCHAR AS symbol, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS t,
  100.0::DOUBLE + value / 10 AS price, ts, event_id FROM events)
  SELECT symbol, t, {r6('first(price ORDER BY ts, event_id)', 'open')}, {r6('max(price)', 'high')}, {r6('min(price)', 'low')},
  {r6('last(price ORDER BY ts, event_id)', 'close')}, {r6('count(*)', 'volume')},
  (row_number() OVER (PARTITION BY symbol ORDER BY t) - 1)::BIGINT AS i FROM m GROUP BY symbol, t""")
def bars_many_series(spark, d):
    return tidy(T.bars(spark, d, "user_id"), "symbol", "t", "open", "high", "low", "close", "volume", "i")


@query("bars_resample_4h_8h_1d", " UNION ALL ".join(
    f"SELECT '{tf}' AS tf, {BAR_OUT} FROM bars_{tf}" for tf in ("4h", "8h", "1d")))
def bars_resample(spark, d):
    df = B.stack_timeframes(B.ticks_to_bars(T.ticks(spark, d)), ("4h", "8h", "1d"))
    return tidy(df, "tf", "symbol", "t", *B.PRICES)


@query("bars_dedup_first", f"""SELECT symbol, t, seq::BIGINT AS seq, {r6('price')} FROM (
  SELECT *, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS t, row_number() OVER (
    PARTITION BY symbol, floor(epoch(ts) / 3600) ORDER BY seq) AS k FROM ticks) WHERE k = 1""")
def bars_dedup_first(spark, d):
    rows = T.ticks(spark, d).select("symbol", B.bucket(F.unix_seconds(F.col("ts").cast("timestamp")), 3600).alias("t"), "seq", "price")
    return tidy(B.dedupe_first(rows, ["symbol", "t"], "seq"), "symbol", "t", "seq", "price")


@query("bars_with_benchmark", f"SELECT {BAR_OUT} FROM bars0 WHERE symbol IN ('click', 'error', 'view')")
def bars_with_benchmark(spark, d):
    wanted = B.with_benchmark(T.ticks(spark, d), ["click", "error", T.BENCHMARK], T.BENCHMARK)
    return tidy(B.ticks_to_bars(wanted), "symbol", "t", *B.PRICES)


@query("bars_lookback", f"SELECT {BAR_OUT} FROM bars0 WHERE t >= (SELECT max(t) FROM bars0) - 240 * 3600")
def bars_lookback(spark, d):
    return tidy(B.lookback_from_latest(B.ticks_to_bars(T.ticks(spark, d)), 240), "symbol", "t", *B.PRICES)


@query("bars_fallback_source", f"""SELECT symbol, '1h' AS tf, t, {r6('close')}, 'a' AS source FROM bars0 WHERE symbol < 'p'
  UNION ALL SELECT symbol, '4h' AS tf, t, {r6('close')}, 'b' AS source FROM bars_4h
  UNION ALL SELECT symbol, '1h' AS tf, t, {r6('close')}, 'b' AS source FROM bars0 WHERE symbol >= 'p'""")
def bars_fallback_source(spark, d):
    b = B.ticks_to_bars(T.ticks(spark, d))
    a = b.filter("symbol < 'p'").select("symbol", F.lit("1h").alias("tf"), "t", "close", F.lit("a").alias("source"))
    second = B.stack_timeframes(b, ("1h", "4h")).select("symbol", "tf", "t", "close", F.lit("b").alias("source"))
    return tidy(B.prefer_source(a, second))


# ---------------------------------------------------------------- indicators
@query("sma_full_window", f"""SELECT symbol, t, {r6('''CASE WHEN count(*) OVER w = 24 THEN avg(close) OVER w END''', 'sma')}
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 23 PRECEDING)""")
def sma_full_window(spark, d):
    return tidy(I.sma(T.bars(spark, d), 24), "symbol", "t", "sma")


cte("deltas", "SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) AS dlt FROM bars")


def rsi_sql(n):
    w = f"(PARTITION BY symbol ORDER BY t ROWS {n - 1} PRECEDING)"
    g = f"avg(greatest(dlt, 0.0::DOUBLE)) OVER {w}"
    l = f"avg(greatest(-dlt, 0.0::DOUBLE)) OVER {w}"
    return f"""coalesce(CASE WHEN count(*) OVER {w} = {n} AND {l} > 0
      THEN 100.0::DOUBLE - 100.0::DOUBLE / (1.0::DOUBLE + {g} / {l}) END, 100.0::DOUBLE)"""


cte("rsi7", f"SELECT symbol, t, i, {rsi_sql(7)} AS rsi FROM deltas")


@query("rsi_sma", f"SELECT symbol, t, {r6(rsi_sql(7), 'rsi_7')}, {r6(rsi_sql(14), 'rsi_14')} FROM deltas")
def rsi_sma(spark, d):
    return tidy(I.rsi(T.bars(spark, d), [7, 14]), "symbol", "t", "rsi_7", "rsi_14")


def _ema_cte(name, span):
    a = f"({2.0 / (span + 1)!r})::DOUBLE"
    cte(name, f"""SELECT symbol, i, close FROM bars WHERE i = 0 UNION ALL
      SELECT b.symbol, b.i, {a} * b.close + (1 - {a}) * e.y FROM {name} e JOIN bars b ON b.symbol = e.symbol AND b.i = e.i + 1""",
        "(symbol, i, y)")


for _n, _s in (("ema_a", 3.7), ("ema_b", 26), ("ema_c", 300)):
    _ema_cte(_n, _s)


@query("ema_scan", f"""SELECT symbol, i::BIGINT AS i, {r6('a.y', 'ema_fast')}, {r6('b.y', 'ema_mid')}, {r6('c.y', 'ema_slow')}
  FROM ema_a a JOIN ema_b b USING (symbol, i) JOIN ema_c c USING (symbol, i)""")
def ema_scan(spark, d):
    out = linear_recurrences(T.bars(spark, d), ["symbol"], {
        "ema_fast": ema("close", 3.7, "close"), "ema_mid": ema("close", 26, "close"), "ema_slow": ema("close", 300, "close")})
    return tidy(out, "symbol", "i", "ema_fast", "ema_mid", "ema_slow")


# MACD of any number of period combinations: one recursion carries both means and the signal
cte("params", """SELECT k AS param_id, 2.5::DOUBLE + 0.5::DOUBLE * (k % 3) AS fast, 8.0::DOUBLE + 2 * (k // 3 % 2) AS slow,
  3.0::DOUBLE AS signal, CASE WHEN k % 2 = 0 THEN '4h' ELSE '8h' END AS trend_tf, 5.0::DOUBLE + 5 * (k // 6) AS adx_min,
  1.0::DOUBLE + 0.5::DOUBLE * (k % 2) AS hard_stop, 0.8::DOUBLE + 0.4::DOUBLE * (k // 2 % 2) AS trail,
  12 + 12 * (k % 2) AS max_hold FROM range(12) r(k)""")
cte("combos", "SELECT DISTINCT fast, slow, signal FROM params")
cte("macds", """SELECT 0::BIGINT AS i, b.symbol, c.fast, c.slow, c.signal, b.close AS f, b.close AS s, 0.0::DOUBLE AS sig
    FROM bars b, combos c WHERE b.i = 0
  UNION ALL
  SELECT i, symbol, fast, slow, signal, f, s, 2 / (signal + 1) * (f - s) + (1 - 2 / (signal + 1)) * sig FROM (
    SELECT b.i, b.symbol, m.fast, m.slow, m.signal, m.sig,
      2 / (m.fast + 1) * b.close + (1 - 2 / (m.fast + 1)) * m.f AS f,
      2 / (m.slow + 1) * b.close + (1 - 2 / (m.slow + 1)) * m.s AS s
    FROM macds m JOIN bars b ON b.symbol = m.symbol AND b.i = m.i + 1)""", "(i, symbol, fast, slow, signal, f, s, sig)")
cte("macd_rows", "SELECT symbol, i, fast, slow, signal, f - s AS macd, sig FROM macds")
cte("cross_rows", """SELECT *, CASE WHEN pm <= ps AND macd > sig THEN 1 WHEN pm >= ps AND macd < sig THEN -1 ELSE 0 END AS crossed FROM (
  SELECT *, lag(macd) OVER w AS pm, lag(sig) OVER w AS ps FROM macd_rows
  WINDOW w AS (PARTITION BY symbol, fast, slow, signal ORDER BY i))""")
cte("one_macd", "SELECT * FROM cross_rows WHERE fast = 3.0 AND slow = 8.0")


@query("macd", f"""SELECT symbol, i::BIGINT AS i, {r6('macd')}, {r6('sig', 'macd_signal')}, {r6('macd - sig', 'macd_hist')} FROM one_macd""")
def macd(spark, d):
    return tidy(I.macd(T.bars(spark, d), 3, 8, 3), "symbol", "i", "macd", "macd_signal", "macd_hist")


@query("macd_cross", "SELECT symbol, i::BIGINT AS i, crossed::BIGINT AS \"cross\" FROM one_macd WHERE crossed <> 0")
def macd_cross(spark, d):
    rows = S.macd_many(T.bars(spark, d), [(3.0, 8.0, 3.0)], crosses=True)
    return tidy(rows.filter(F.col("cross") != 0), "symbol", "i", "cross")


cte("ranges", """SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM (
  SELECT *, lag(close) OVER w AS pc, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY i))""")
cte("di", """SELECT *, 100 * pm / nullif(atr, 0) AS pdi, 100 * mm / nullif(atr, 0) AS mdi FROM (
  SELECT *, CASE WHEN count(*) OVER w = 14 THEN avg(tr) OVER w END AS atr, CASE WHEN count(*) OVER w = 14 THEN avg(pdm) OVER w END AS pm,
    CASE WHEN count(*) OVER w = 14 THEN avg(mdm) OVER w END AS mm FROM ranges
  WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING))""")
cte("feats", """SELECT symbol, t, i, open, high, low, close, atr, pdi, mdi, CASE WHEN count(dx) OVER w = 14 THEN avg(dx) OVER w END AS adx FROM (
  SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di)
  WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING)""")


@query("atr", f"SELECT symbol, t, {r6('atr')} FROM feats")
def atr(spark, d):
    return tidy(I.atr_adx(T.bars(spark, d)), "symbol", "t", "atr")


@query("adx", f"SELECT symbol, t, {r6('pdi', 'plus_di')}, {r6('mdi', 'minus_di')}, {r6('adx')} FROM feats")
def adx(spark, d):
    return tidy(I.atr_adx(T.bars(spark, d)), "symbol", "t", "plus_di", "minus_di", "adx")


cte("rets", """SELECT *, close / lag(close) OVER w - 1 AS ret, ln(close / lag(close) OVER w) AS log_ret FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY i)""")


@query("log_and_simple_returns", f"SELECT symbol, t, {r6('ret')}, {r6('log_ret')} FROM rets")
def log_and_simple_returns(spark, d):
    return tidy(I.returns(T.bars(spark, d)), "symbol", "t", "ret", "log_ret")


cte("cv", """SELECT symbol, i, 4.0::DOUBLE FROM rets WHERE i = 72
  UNION ALL SELECT r.symbol, r.i, 0.8::DOUBLE + 0.1::DOUBLE * (r.log_ret * 100) * (r.log_ret * 100) + 0.7::DOUBLE * c.v
  FROM cv c JOIN rets r ON r.symbol = c.symbol AND r.i = c.i + 1""", "(symbol, i, v)")


@query("cond_variance", f"""SELECT symbol, r.i::BIGINT AS i, {r6('v', 'cond_var')}, {r6('sqrt(v)', 'cond_vol')},
  {r6('CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE least(greatest(2.0::DOUBLE / sqrt(v), 0.5), 2.0) END', 'vol_ratio')} FROM rets r LEFT JOIN cv USING (symbol, i)""")
def cond_variance(spark, d):
    # omega / (1 - alpha - beta) = 4: the long-term variance of the recursion
    out = I.conditional_variance(T.bars(spark, d), 0.8, 0.1, 0.7, 72)
    return tidy(out, "symbol", "i", "cond_var", "cond_vol", "vol_ratio")


# ---------------------------------------------------------------- alignment
@query("rsi_zone_memory", f"""SELECT symbol, i::BIGINT AS i, {r6('rsi', 'rsi_7')}, bool_or(rsi < 45) OVER w AS low, bool_or(rsi > 55) OVER w AS high
  FROM rsi7 WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 3 PRECEDING)""")
def rsi_zone_memory(spark, d):
    rows = S.rsi_zones(T.bars(spark, d), [(7, 45, 55, 3)]).withColumnsRenamed({"low": "p_low", "high": "p_high"})
    return tidy(rows.withColumnsRenamed({"low_0": "low", "high_0": "high"}), "symbol", "i", "rsi_7", "low", "high")


def _htf_macd(tf, width):
    cte(f"hb_{tf}", f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM bars_{tf}")
    name = f"hm_{tf}"
    cte(name, f"""SELECT 0::BIGINT AS i, b.symbol, c.fast, c.slow, c.signal, b.close AS f, b.close AS s, 0.0::DOUBLE AS sig, b.t
        FROM hb_{tf} b, combos c WHERE b.i = 0
      UNION ALL
      SELECT i, symbol, fast, slow, signal, f, s, 2 / (signal + 1) * (f - s) + (1 - 2 / (signal + 1)) * sig, t FROM (
        SELECT b.i, b.symbol, m.fast, m.slow, m.signal, m.sig, b.t,
          2 / (m.fast + 1) * b.close + (1 - 2 / (m.fast + 1)) * m.f AS f,
          2 / (m.slow + 1) * b.close + (1 - 2 / (m.slow + 1)) * m.s AS s
        FROM {name} m JOIN hb_{tf} b ON b.symbol = m.symbol AND b.i = m.i + 1)""", "(i, symbol, fast, slow, signal, f, s, sig, t)")
    cte(f"trend_{tf}", f"SELECT symbol, fast, slow, signal, t, t + {width} AS ends, f - s > sig AS bull FROM {name}")


_htf_macd("4h", 14400)
_htf_macd("8h", 28800)
_htf_macd("1d", 86400)
cte("trend_one", "SELECT symbol, t, ends, bull FROM trend_4h WHERE fast = 3.0 AND slow = 8.0")


def _trend(spark, d, align):
    b = bars(spark, d)
    states = S.trend_states(b, ["4h"], [(3.0, 8.0, 3.0)])
    return tidy(S.align_trend(b, states, ["symbol"], align), "symbol", "t", "bull")


@query("asof_open", """SELECT b.symbol, b.t, coalesce(h.bull, (SELECT bull FROM trend_one f WHERE f.symbol = b.symbol ORDER BY f.t LIMIT 1)) AS bull
  FROM bars b ASOF LEFT JOIN trend_one h ON b.symbol = h.symbol AND b.t >= h.t""")
def asof_open(spark, d):
    return _trend(spark, d, "open")


@query("asof_closed", """SELECT b.symbol, b.t, h.bull FROM bars b ASOF LEFT JOIN trend_one h ON b.symbol = h.symbol AND b.t >= h.ends""")
def asof_closed(spark, d):
    return _trend(spark, d, "closed")


cte("regimes", """SELECT b.t, CASE WHEN h.bull THEN 1 WHEN NOT h.bull THEN -1 END AS regime FROM (SELECT DISTINCT t FROM bars) b
  ASOF LEFT JOIN (SELECT * FROM trend_one WHERE symbol = 'view') h ON b.t >= h.ends""")


@query("benchmark_regime", "SELECT b.symbol, b.t, r.regime::BIGINT AS regime FROM bars b JOIN regimes r USING (t)")
def benchmark_regime(spark, d):
    b = bars(spark, d)
    return tidy(b.join(S.regime(b, BENCH), "t"), "symbol", "t", "regime")


# ---------------------------------------------------------------- signals
cte("zones", """SELECT symbol, i, rsi, bool_or(rsi < 60) OVER w AS zlow, bool_or(rsi > 40) OVER w AS zhigh FROM rsi7
  WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 3 PRECEDING)""")
cte("hits", """SELECT p.param_id, c.symbol, c.i, c.macd, c.sig, c.crossed, p.trend_tf, p.adx_min, p.fast, p.slow, p.signal
  FROM cross_rows c JOIN params p USING (fast, slow, signal) WHERE c.crossed <> 0""")
cte("trends", """SELECT '4h' AS trend_tf, * FROM trend_4h UNION ALL SELECT '8h' AS trend_tf, * FROM trend_8h""")
cte("sig_rows", """SELECT h.symbol, h.param_id, h.i, f.t, h.crossed,
    CASE WHEN h.crossed = 1 THEN z.zlow ELSE z.zhigh END AS rsi_ok, coalesce(tr.bull = (h.crossed = 1), false) AS trend_ok,
    coalesce(h.symbol = 'view' OR r.regime = h.crossed, false) AS regime_ok, coalesce(f.adx >= h.adx_min, false) AS adx_ok,
    abs(h.macd - h.sig) / CASE WHEN f.atr > 0 THEN f.atr ELSE 1e-8 END + abs(z.rsi - 50) / 50 AS strength,
    f.atr, f.high, f.low, f.close
  FROM (SELECT hits.*, b.t AS base_t FROM hits JOIN bars b USING (symbol, i)) h
  ASOF LEFT JOIN trends tr ON h.symbol = tr.symbol AND h.trend_tf = tr.trend_tf AND h.fast = tr.fast AND h.slow = tr.slow AND h.base_t >= tr.ends
  JOIN feats f ON f.symbol = h.symbol AND f.i = h.i JOIN zones z ON z.symbol = h.symbol AND z.i = h.i
  JOIN regimes r ON r.t = f.t""")
cte("sig_gated", """SELECT *, CASE WHEN rsi_ok AND trend_ok AND regime_ok AND adx_ok THEN crossed ELSE 0 END AS fired FROM sig_rows""")
# without the benchmark gate, as used for tuning
cte("sig_free", """SELECT *, CASE WHEN rsi_ok AND trend_ok AND adx_ok THEN crossed ELSE 0 END AS fired FROM sig_rows""")


@query("signal_funnel", """SELECT symbol, param_id::BIGINT AS param_id, count(*) AS crosses, count_if(rsi_ok)::BIGINT AS after_rsi,
  count_if(rsi_ok AND trend_ok)::BIGINT AS after_trend, count_if(rsi_ok AND trend_ok AND regime_ok)::BIGINT AS after_regime,
  count_if(fired <> 0)::BIGINT AS fired FROM sig_gated GROUP BY ALL""")
def signal_funnel(spark, d):
    rows = S.signal_rows(bars(spark, d), GRID, BENCH)
    rsi, trend, reg = F.col("rsi_ok"), F.col("trend_ok"), F.col("regime_ok")
    return tidy(rows.groupBy("symbol", "param_id").agg(
        F.count(F.lit(1)).alias("crosses"), F.count_if(rsi).alias("after_rsi"), F.count_if(rsi & trend).alias("after_trend"),
        F.count_if(rsi & trend & reg).alias("after_regime"), F.count_if(F.col("fired") != 0).alias("fired")))


@query("signal_strength", f"""SELECT symbol, param_id::BIGINT AS param_id, i::BIGINT AS i, fired::BIGINT AS fired, {r6('CASE WHEN atr > 0 THEN strength END', 'strength')} FROM sig_gated""")
def signal_strength(spark, d):
    # no strength while the ATR is not defined
    rows = S.signal_rows(bars(spark, d), GRID, BENCH)
    rows = rows.withColumn("strength", F.when(F.col("atr") > 0, F.col("strength")))
    return tidy(rows, "symbol", "param_id", "i", "fired", "strength")


@query("signal_calm_filter", """SELECT s.symbol, s.i::BIGINT AS i, CASE WHEN coalesce(sqrt(cv.v) / 2.0::DOUBLE > 1.1, false) THEN 0 ELSE fired END::BIGINT AS fired
  FROM sig_free s LEFT JOIN cv USING (symbol, i) WHERE s.param_id = 1""")
def signal_calm_filter(spark, d):
    b = bars(spark, d)
    v = I.conditional_variance(b, 0.8, 0.1, 0.7, 72).select("symbol", "i", "cond_vol", "long_vol")
    rows = S.signal_rows(b, ONE).join(v, ["symbol", "i"], "left")
    return tidy(S.calm_only(rows, F.col("cond_vol") / F.col("long_vol"), 1.1), "symbol", "i", "fired")


# ---------------------------------------------------------------- correlation
_SYM = sorted(T.SYMBOLS)
cte("wide", "SELECT t, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN ret END) AS {s}" for s in _SYM) + " FROM rets GROUP BY t")
_PAIRS = [(a, b) for n, a in enumerate(_SYM) for b in _SYM[n + 1:]]
cte("tail_edges", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) >= 360 THEN corr({a}, {b}) END AS corr "
    "FROM (SELECT * FROM wide ORDER BY t DESC LIMIT 720)" for a, b in _PAIRS))


def tail_edges(b):
    return C.tail_correlation(I.returns(b), 720)


@query("pairwise_corr_tail", f"SELECT a, b, {r6('corr')} FROM tail_edges")
def pairwise_corr_tail(spark, d):
    return tidy(tail_edges(T.bars(spark, d)))


@query("corr_matrix_dense", "SELECT a AS symbol, " + ", ".join(
    r6(f"CASE WHEN a = '{s}' THEN 1.0::DOUBLE ELSE coalesce(max(CASE WHEN b = '{s}' THEN corr END), 0) END", s) for s in _SYM)
    + " FROM (SELECT a, b, corr FROM tail_edges UNION ALL SELECT b, a, corr FROM tail_edges) GROUP BY a")
def corr_matrix_dense(spark, d):
    return tidy(C.dense_matrix(tail_edges(T.bars(spark, d)), T.SYMBOLS))


@query("rolling_corr", " UNION ALL ".join(
    f"SELECT * FROM (SELECT t, '{a}' AS a, '{b}' AS b, " + r6(
        f"CASE WHEN count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) OVER w >= 360 THEN corr({a}, {b}) OVER w END", "corr")
    + " FROM wide WINDOW w AS (ORDER BY t ROWS 719 PRECEDING))" for a, b in _PAIRS))
def rolling_corr(spark, d):
    return tidy(C.rolling_correlation(I.returns(T.bars(spark, d)), 720), "t", "a", "b", "corr")


cte("inv_vol", """SELECT symbol, t, i, v, (1 / v) / sum(1 / v) OVER (PARTITION BY t) AS weight FROM (
  SELECT *, CASE WHEN close > 0 AND atr > 0 THEN atr / close ELSE 0.01::DOUBLE END AS v FROM feats)""")


@query("inverse_vol_weight", f"SELECT symbol, t, {r6('v', 'vol')}, {r6('weight')} FROM inv_vol")
def inverse_vol_weight(spark, d):
    from ..operators.sizing import inverse_vol_weight as weights

    return tidy(weights(I.atr_adx(T.bars(spark, d))), "symbol", "t", "vol", "weight")
