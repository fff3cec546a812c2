"""Block summaries, parameter sets as a table and successive halving."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.operators import blocks, exits, folds, parameters, signals, sweep
from seriesmith.sources import tables


def plain(trades):
    """Growth, deepest fall and daily ratio of trades in order, computed from the whole path."""
    p, top, worst, days = 0.0, 0.0, 0.0, {}
    for g, day in trades:
        p += g
        top = max(top, p)
        worst = min(worst, p - top)
        days[day] = days.get(day, 0.0) + g
    lo, hi = min(days), max(days)
    r = [math.exp(days.get(d, 0.0)) - 1 for d in range(lo + 1, hi + 1)]
    dev = np.std(r, ddof=1) if len(r) > 1 else 0.0
    return p, worst, np.mean(r) / dev * math.sqrt(365) if dev > 1e-12 else 0.0


def test_joined_summaries_equal_the_whole_path(spark):
    rng = random.Random(7)
    rows, series = [], {}
    for k in range(60):
        i = day = 0
        for block in range(rng.choice([1, 2, 5, 8])):
            for _ in range(rng.choice([0, 1, 1, 3, 9])):
                day += rng.choice([0, 0, 1, 3])
                g = rng.choice([rng.gauss(0, 0.05), 0.0, 0.02, -0.02])
                rows.append((k, block, i, day, g))
                series.setdefault(k, []).append((g, day))
                i += 1
    df = spark.createDataFrame(rows, "k int, block int, i int, exit_day int, g double").repartition(5)
    per = blocks.summaries(df, ["k"], "block", F.col("g"))
    both = per.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("block", "s"))).alias("bs"))

    def fold(array):
        return F.aggregate(array, blocks.empty(), lambda acc, b: blocks.joined(acc, b["s"]))

    half = F.floor(F.size("bs") / 2).cast("int")
    # the operation is associative: halves joined give what the blocks one by one give
    split = blocks.joined(fold(F.slice("bs", 1, half)), fold(F.slice("bs", half + 1, F.size("bs"))))
    out = both.select("k", fold(F.col("bs")).alias("s"), split.alias("t")).select(
        "k", "s", "t", blocks.daily_sharpe(F.col("s")).alias("sharpe")).collect()
    assert len(out) == len(series)
    for r in out:
        growth, worst, sharpe = plain(series[r.k])
        for s in (r.s, r.t):
            assert s.n == len(series[r.k]) and s.growth == pytest.approx(growth, abs=1e-12) and s.worst == pytest.approx(worst, abs=1e-12)
        assert r.sharpe == pytest.approx(sharpe, abs=1e-9)
        assert r.t.days_sum == pytest.approx(r.s.days_sum, abs=1e-12) and r.t.days_square == pytest.approx(r.s.days_square, abs=1e-12)


@pytest.fixture(scope="module")
def few(spark, data):
    space = folds.SearchSpace({
        "fast": folds.Range(2, 6), "slow": folds.Range(8, 16, True), "signal": folds.Range(2, 5, True), "rsi_period": folds.Range(5, 7, True),
        "rsi_lower": folds.Range(50, 65), "rsi_upper": folds.Range(35, 50), "rsi_lookback": folds.Range(0, 2, True),
        "adx_min": folds.Range(5, 15), "hard_stop": folds.Range(1, 2), "trail": folds.Range(1, 2), "max_hold": folds.Range(8, 20, True)})
    sets = folds.random_sets(spark, 6, space, 1)
    sets = sets.withColumns({c: F.col(c).cast("int") for c in ("rsi_period", "rsi_lookback", "max_hold")})
    return tables.bars(spark, data).cache(), sets.cache()


def test_table_of_sets_fires_like_a_list_of_sets(spark, few):
    bars, sets = few
    listed = [r.asDict() for r in sets.collect()]
    want = signals.signal_rows(bars, listed).filter("fired != 0")
    got = parameters.signals_of_sets(bars, sets)
    cols = ["symbol", "param_id", "i", "fired"]
    a, b = ({tuple(r) for r in df.select(*cols).collect()} for df in (want, got))
    assert a == b and len(a) > 50
    # exits follow from either form
    slip = F.lit(0.001)
    x = {tuple(r) for r in exits.resolve(got, parameters.features_of_sets(bars, sets)[0], sets, slip).select("symbol", "param_id", "i", "exit_i", "reason").collect()}
    y = {tuple(r) for r in sweep.resolved_candidates(bars, listed, slip).select("symbol", "param_id", "i", "exit_i", "reason").collect()}
    assert x == y


def test_halving_equals_scoring_everything_and_cutting(spark, few):
    bars, sets = few
    resolved, reach = parameters.resolved_of_sets(bars, sets, F.lit(0.001))
    wf = folds.walk_forward(folds.series_lengths(bars), folds.FoldRules(minimum=100), n_folds=3)
    rules = dict(min_year=1, min_test=1)
    got = {(r.rung, r.symbol, r.param_id): (r.score, r.evaluated)
           for r in sweep.successive_halving(resolved, wf, bars, reach, sets, 3, **rules).collect()}
    scores = {}
    for r in sweep.sweep(resolved, wf, bars, reach, sets, **rules).collect():
        scores.setdefault(r.symbol, {}).setdefault(r.param_id, {})[r.fold] = r.score
    want = {}
    for symbol, by_set in scores.items():
        left = set(by_set)
        for k in range(3):
            mean = {p: round(sum(by_set[p][f] for f in range(k + 1)) / (k + 1), 9) for p in left}
            ranked = sorted(left, key=lambda p: (-mean[p], p))[: (len(left) + 1) // 2]
            want |= {(k, symbol, p): (pytest.approx(mean[p], abs=1e-8), len(left)) for p in ranked}
            left = set(ranked)
    assert got == want
