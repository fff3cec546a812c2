"""Pareto fronts, admission, thinning, streaks, episodes and shuffles by brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmith.functions.columns import div_floor
from seriesmith.operators import decisions, equity, folds, intervals, selection, sizing, validation


def brute_front(rows):
    keep = []
    for a in rows:
        if not any(all(y >= x for x, y in zip(a[1:], b[1:])) and b[1:] != a[1:] for b in rows):
            keep.append(a)
    return sorted(keep)


@pytest.mark.parametrize("kind", ["ties", "random", "all_front"])
def test_pareto(spark, kind):
    rng = np.random.default_rng(4)
    n = 400
    if kind == "ties":
        v = rng.integers(0, 6, (n, 3)).astype(float)
    elif kind == "random":
        v = rng.normal(size=(n, 3))
    else:
        x = rng.permutation(n).astype(float)
        v = np.stack([x, -x, np.zeros(n)], 1)
    pdf = pd.DataFrame(v, columns=["p", "q", "r"]).assign(k=np.where(np.arange(n) % 3 == 0, "u", "v"), number=np.arange(n))
    got = selection.pareto_front(spark.createDataFrame(pdf).repartition(6), ["k"], ["p", "q", "r"], slabs=5).collect()
    for k, g in pdf.groupby("k"):
        want = brute_front([tuple(x) for x in g[["number", "p", "q", "r"]].values.tolist()])
        have = sorted((r["number"], r["p"], r["q"], r["r"]) for r in got if r["k"] == k)
        assert have == want


def test_pareto_without_keys(spark):
    pdf = pd.DataFrame({"number": range(50), "p": np.arange(50.0) % 7, "q": -np.arange(50.0) % 5, "r": np.arange(50.0) % 3})
    got = selection.pareto_front(spark.createDataFrame(pdf), [], ["p", "q", "r"], slabs=4).collect()
    want = brute_front([tuple(x) for x in pdf.values.tolist()])
    assert sorted((float(r["number"]), r["p"], r["q"], r["r"]) for r in got) == want


def test_thin_and_half(spark):
    df = spark.range(1003).select(F.lit("s").alias("symbol"), F.col("id").alias("number"), (F.col("id") % 17).cast("double").alias("score"))
    df = df.withColumn("p", div_floor("number", 100))
    got = sorted(r["number"] for r in selection.thin(df, ["symbol"], ["p"], "number", 100).collect())
    want = list(range(0, 1003, 10))[:100]
    assert got == want + [1002]
    half = selection.better_half(df.withColumn("b", -F.col("score")), ["symbol"], ["b"], "score", "number").collect()
    want = df.toPandas().sort_values(["score", "number"], ascending=[False, True]).head(502).number
    assert sorted(r["number"] for r in half) == sorted(want)


def trades_of(spark, pnl):
    rows = [("s", k, k // 3, float(p)) for k, p in enumerate(pnl)]
    return spark.createDataFrame(rows, "symbol string, k bigint, b bigint, pnl_abs double")


def test_streaks(spark):
    t = trades_of(spark, [1, 1, 0, 1, 1, 1, -1, -1, 0, -1, 2])
    best = equity.streak_max(t, ["symbol"], ["b"], ["k"]).first()
    assert (best["max_win_streak"], best["max_loss_streak"]) == (3, 4)
    dist = {(r["kind"], r["length"]): r["n"] for r in equity.streak_distribution(t, ["symbol"], ["b"], ["k"]).collect()}
    assert dist == {("win", 2): 1, ("win", 3): 1, ("win", 1): 1, ("loss", 2): 1, ("loss", 1): 1}


def test_equity_curve_and_drawdown(spark):
    pnl = [10, -20, 5, 30, -50, 50, -1]
    t = trades_of(spark, pnl)
    c = equity.equity_curve(t, ["symbol"], ["b"], ["k"], 100.0).orderBy("k").toPandas()
    e = 100 + np.cumsum(pnl)
    pk = np.maximum.accumulate(np.concatenate([[100], e]))[1:]
    assert c.equity.tolist() == e.tolist() and c.peak.tolist() == pk.tolist()
    assert np.allclose(c.drawdown, (e - pk) / pk * 100)


def test_drawdown_episodes(spark):
    values = [100, 110, 105, 100, 110, 108, 112, 112, 90, 95, 91]
    df = spark.createDataFrame([("s", k, k // 4, float(v)) for k, v in enumerate(values)], "symbol string, k bigint, b bigint, equity double")
    got = [tuple(r)[1:7] for r in equity.drawdown_episodes(df, ["symbol"], ["b"], "k").orderBy("peak_at", "trough_at").collect()]
    assert got == [(110.0, 1, 100.0, 3, 4, 2), (110.0, 1, 108.0, 5, 6, 1), (112.0, 6, 90.0, 8, None, 3)]


def test_open_counts(spark):
    df = spark.createDataFrame([(0, 5), (3, 5), (5, 9), (9, 9)], "entry_t bigint, exit_t bigint")
    got = {r["at"]: (r["before"], r["after"]) for r in intervals.open_timeline(df, [], {"b": div_floor("at", 4)}).collect()}
    assert got == {0: (0, 1), 3: (1, 2), 5: (0, 1), 9: (0, 0)}


def test_forward_join(spark):
    left = spark.createDataFrame([("s", k) for k in range(0, 50, 7)], "symbol string, i bigint")
    right = spark.createDataFrame([("s", k) for k in range(60)], "symbol string, x bigint")
    got = sorted((r["i"], r["x"]) for r in intervals.forward_join(left, right, ["symbol"], "i", "x", 6, first=2).collect())
    assert got == [(i, x) for i in range(0, 50, 7) for x in range(60) if 2 <= x - i <= 6]


def test_combinations(spark):
    c = folds.combination_sets(folds.cscv_combinations(spark, 8), 8).collect()
    assert len({tuple(r["train"]) for r in c}) == 70
    assert all(sorted(r["train"] + r["test"]) == list(range(8)) for r in c)


def test_random_sets_are_stable(spark):
    space = folds.SearchSpace({"fast": folds.Range(3, 20), "slow": folds.Range(10, 45, True)})
    a = folds.random_sets(spark, 200, space, 42).orderBy("param_id").toPandas()
    b = folds.random_sets(spark, 100, space, 42, first_id=100).repartition(5).orderBy("param_id").toPandas()
    assert a.tail(100).reset_index(drop=True).equals(b)
    assert ((a.slow - a.fast) > 4).all() and a.fast.between(3, 20).all() and set(a.trend_tf) == {"4h", "8h", "1d"}
    assert folds.valid_gap(folds.random_sets(spark, 50, space, 1)).count() <= 50
    g = folds.grid_sets(spark, {"a": [1, 2, 3], "b": [0.5, 1.5]}).orderBy("param_id").collect()
    assert [(r["a"], r["b"]) for r in g] == [(x, y) for x in (1, 2, 3) for y in (0.5, 1.5)]


def test_shuffles(spark):
    t = spark.range(40).select(F.lit("s").alias("symbol"), F.col("id").alias("k"), ((F.col("id") * 37 % 11) - 4).cast("double").alias("pnl_abs"))
    one = validation.shuffles(t, ["symbol"], 5, 1, ["k"], block=20)
    again = validation.shuffles(t.repartition(7), ["symbol"], 5, 1, ["k"], block=20)
    key = lambda d: sorted((r["sim"], r["k"], r["pos"]) for r in d.collect())
    assert key(one) == key(again)
    paths = validation.shuffle_paths(one, ["symbol"], ["pos", "k"], 1000.0, 100.0).collect()
    for r in paths:
        order = one.filter(F.col("sim") == r["sim"]).orderBy("pos", "k").toPandas().pnl_abs
        e = np.concatenate([[1000.0], 1000 + np.cumsum(order)])
        pk = np.maximum.accumulate(e)
        assert r["max_dd"] == pytest.approx(((e - pk) / pk * 100).min())
        ret = np.diff(e) / e[:-1]
        assert r["sharpe"] == pytest.approx(ret.mean() / ret.std() * np.sqrt(40 * 365 / 100))
    few = validation.shuffle_summary(validation.shuffle_paths(
        validation.shuffles(t.limit(5), ["symbol"], 3, 1, ["k"]), ["symbol"], ["pos", "k"], 1000.0, 100.0), ["symbol"]).first()
    assert few["label"] == "LOW" and few["sharpe_mean"] == 0.0


def test_rules(spark):
    df = spark.createDataFrame([("A", 0.4, -1.0, 2.0), ("B", 0.6, 1.0, 0.1), ("C", 0.31, 0.0, 0.9), ("A", 0.2, 0.3, 0.4)],
                               "tier string, pbo double, sharpe double, calmar double")
    got = df.select(decisions.after_pbo("tier", "pbo"), decisions.after_evaluation("tier", "sharpe", "calmar")).collect()
    assert [tuple(r) for r in got] == [("B", "X"), ("X", "C"), ("X", "C"), ("A", "C")]
    p = spark.createDataFrame([(1, 0.5, 0), (4, 0.6, 3)], "m int, g double, n int")
    assert [r[0] for r in p.select(decisions.overfit_penalty(F.col("m"), F.col("g"), F.col("n"))).collect()] == pytest.approx([1.7, 0.0])


def test_weight_of_one_moment(spark):
    df = spark.createDataFrame([(0, "a", 2.0, 100.0), (0, "b", 1.0, 100.0), (0, "c", None, 100.0)], "t bigint, symbol string, atr double, close double")
    w = {r["symbol"]: r["weight"] for r in sizing.inverse_vol_weight(df).collect()}
    assert w["a"] == pytest.approx(50 / 250) and w["b"] == pytest.approx(100 / 250) and w["c"] == pytest.approx(100 / 250)


def test_strategy_parameters(spark):
    from seriesmith.operators.strategy import LayeredStrategy, strategy_parameters

    df = spark.createDataFrame([("s", 3.0, 9.5, {"fast": 3.0, "sharpe": 2.0})], "symbol string, fast double, sharpe double, m map<string,double>")
    assert strategy_parameters(df).columns == ["symbol", "fast"]
    assert strategy_parameters(df, column="m").first()["m"] == {"fast": 3.0}
    assert LayeredStrategy().defaults()["max_hold"] == 168


def test_custom_strategy_and_score(spark, data_small):
    from seriesmith.operators import metrics, sweep
    from seriesmith.operators import indicators as I
    from seriesmith.sources import tables as T
    from seriesmith.sources.scratch import settle

    class EveryTenth:
        def paths(self, bars, params):
            return I.atr_adx(bars)

        def signals(self, bars, params):
            rows = self.paths(bars, params).filter("i % 10 = 0 and atr is not null")
            ids = F.explode(F.array(*[F.lit(p["param_id"]) for p in params]))
            return rows.withColumns({"param_id": ids, "fired": F.lit(1), "strength": F.lit(1.0)})

    bars = settle(T.bars(spark, data_small))
    params = [dict(param_id=k, hard_stop=1.0 + k, trail=1.0, max_hold=9) for k in range(3)]
    res = sweep.resolved_candidates(bars, params, F.lit(0.0), strategy=EveryTenth())
    rules = folds.FoldRules(minimum=100, purge=5)
    f = folds.walk_forward(folds.series_lengths(bars), rules)
    n_trades = lambda m, min_test: F.col("trades").cast("double")
    out = sweep.sweep(res, f, bars, 9, range(3), min_year=0, min_test=1, score=n_trades, attributes=["win_rate"])
    got = out.collect()
    assert len(got) == 5 * 2 * 3 and all(r["score"] == r["test_trades"] for r in got) and "win_rate" in out.columns
    mean = sweep.mean_scores(out, ["win_rate"])
    assert mean.count() == 15 and sweep.best_sets(out).count() == 5


def test_yearly_ratios_equal_the_dense_curve(spark):
    r = np.random.default_rng(5)
    rows = [(f"k{k % 7}", int(d), float(p)) for k, d, p in zip(range(400), r.integers(9000, 11500, 400), r.integers(-900, 900, 400) / 10)]
    rows += [("idle", 9000, 5.0), ("idle", 12000, -3.0), ("one", 9500, 1.0), ("lost", None, 4.0), ("k1", None, 7.0), ("k2", 10000, None)]
    # the equity is zero for some years
    rows += [("zero", 9000, 2.0), ("zero", 9100, -1002.0), ("zero", 9900, 10.0), ("zero", 9901, 11.0), ("zero", 9902, 3.0)]
    t = spark.createDataFrame(rows, "symbol string, exit_day int, pnl_abs double")
    day = equity.daily_equity(t, ["symbol"], 1000.0).withColumn("window", F.year(F.date_from_unix_date("day")))
    want = {(x.symbol, x.window): x.sharpe for x in day.groupBy("symbol", "window").agg(
        equity.ratio_or_zero(F.avg("ret"), F.stddev_samp("ret"), 365).alias("sharpe")).collect()}
    out = equity.yearly_ratios(t, ["symbol"], 1000.0)
    have = {(x.symbol, x.window): x.sharpe for x in out.collect()}
    assert have.keys() == want.keys() and len(have) > 50
    assert all(have[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_tiers_read_the_trades_once_for_metrics_and_no_dense_days(spark, data):
    from seriesmith.plans import trade_queries

    plan = trade_queries.tier_pbo_override(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(__lo" not in plan and plan.count("l_extendedprice") < 10
