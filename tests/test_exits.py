"""Exit resolution against a plain per-bar loop, and constructed price paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.operators import exits as E
from seriesmith.operators import indicators as I
from seriesmith.sources import tables as T
from seriesmith.sources.scratch import settle

FEE = E.FEE


def loop(bars, sig, p, slip, start, end):
    """One position at a time, bar by bar, for one series."""
    out, pos = [], None
    for x in range(start, end):
        b = bars[x]
        atr = b["atr"] if b["atr"] and b["atr"] > 0 else 1e-8
        if pos:
            d = pos["side"]
            pos["best"] = max(pos["best"], b["high"]) if d == 1 else min(pos["best"], b["low"])
            adverse = b["low"] if d == 1 else b["high"]
            move = (b["high"] - pos["price"]) if d == 1 else (pos["price"] - b["low"])
            hard = pos["price"] - d * p["hard_stop"] * atr
            reason, level = None, None
            if (adverse - hard) * d <= 0:
                reason, level = "hard_stop", hard
            else:
                pos["on"] = pos["on"] or move >= 1.5 * atr
                trail = pos["best"] - d * p["trail"] * atr
                if pos["on"] and (adverse - trail) * d <= 0:
                    reason, level = "trailing_stop", trail
                elif x - pos["i"] >= p["max_hold"]:
                    reason, level = "time_exit", b["close"]
                elif x - pos["i"] >= 2 and sig.get(x, 0) == -d:
                    reason, level = "opposing_signal", b["close"]
            if reason:
                out.append((pos["i"], x, d, reason, pos["price"], level * (1 - d * slip)))
                pos = None
                if reason != "opposing_signal":
                    continue
        if pos is None and sig.get(x, 0) != 0:
            d = sig[x]
            pos = dict(i=x, side=d, price=b["close"] * (1 + d * slip), on=False,
                       best=b["high"] if d == 1 else b["low"])
    if pos:
        d = pos["side"]
        out.append((pos["i"], end - 1, d, "force_close", pos["price"], bars[end - 1]["close"] * (1 - d * slip)))
    return out


@pytest.fixture(scope="module")
def feats(spark, data_small):
    b = settle(I.atr_adx(T.bars(spark, data_small)))
    fired = F.when(F.pmod(F.xxhash64("symbol", "i"), F.lit(5)) == 0, 1).when(
        F.pmod(F.xxhash64("symbol", "i"), F.lit(5)) == 1, -1).otherwise(0)
    return b, settle(b.withColumns({"fired": fired, "strength": F.lit(1.0), "param_id": F.lit(0)}))


@pytest.mark.parametrize("hold,stop,trail,block", [(24, 1.0, 0.8, 4096), (6, 2.2, 1.6, 7), (30, 2.5, 3.0, 40)])
def test_trades_equal_loop(spark, feats, hold, stop, trail, block):
    bars, sig = feats
    p = dict(param_id=0, hard_stop=stop, trail=trail, max_hold=hold)
    res = settle(E.resolve(sig.filter("fired != 0"), bars, [p], F.lit(0.001)))
    folds = spark.createDataFrame(
        [(s, f, a, z) for s in T.SYMBOLS for f, a, z in [(0, 0, 600), (1, 100, 433)]],
        "symbol string, fold int, start_i bigint, end_i bigint")
    cut = E.cut_to_folds(res, folds, bars)
    got = E.non_overlapping(cut, ["symbol", "param_id", "fold"], hold, block).collect()
    rows = sig.orderBy("symbol", "i").collect()
    n = 0
    for s in T.SYMBOLS:
        b = {r["i"]: r.asDict() for r in rows if r["symbol"] == s}
        fired = {i: r["fired"] for i, r in b.items()}
        for f, a, z in [(0, 0, 600), (1, 100, 433)]:
            want = loop(b, fired, p, 0.001, a, z)
            have = sorted((r["i"], r["exit_i"], r["side"], r["reason"], r["entry_price"], r["exit_price"])
                          for r in got if r["symbol"] == s and r["fold"] == f)
            assert [w[:4] for w in want] == [h[:4] for h in have]
            for w, h in zip(want, have):
                assert w[4:] == pytest.approx(h[4:], rel=1e-12)
            n += len(want)
    assert n > 100


def test_compounding_equals_cash_loop(spark, feats):
    bars, sig = feats
    p = dict(param_id=0, hard_stop=1.5, trail=1.0, max_hold=12)
    res = E.resolve(sig.filter("fired != 0"), bars, [p], F.lit(0.001))
    cut = E.cut_to_folds(res, E.whole_range(bars), bars)
    tr = settle(E.non_overlapping(cut, ["symbol", "param_id", "fold"], 12))
    got = E.compounded(tr, ["symbol"], 10_000.0, E.bet_size(0.2), block=50).orderBy("symbol", "i").collect()
    for s in T.SYMBOLS:
        cash = 10_000.0
        for r in [r for r in got if r["symbol"] == s]:
            cap = cash * 0.2
            size = cap / (r["entry_price"] * (1 + FEE))
            cash -= cap
            if r["side"] == 1:
                back = size * r["exit_price"] * (1 - FEE)
                pnl = back - cap
            else:
                pnl = size * r["entry_price"] * (1 - FEE) - size * r["exit_price"] * (1 + FEE)
            cash += cap + pnl
            assert r["pnl_abs"] == pytest.approx(pnl, abs=0.006)
            assert r["capital_at_entry"] == pytest.approx(cap, abs=0.006)


def _path(spark, closes, spread=0.0):
    rows = [("s", k, k * 3600, c, c + spread, c - spread, c, 1.0, 1.0) for k, c in enumerate(map(float, closes))]
    return spark.createDataFrame(
        rows, "symbol string, i bigint, t bigint, open double, high double, low double, close double, volume double, atr double")


@pytest.mark.parametrize("closes,sells,reason,at", [
    ([100, 100, 97, 100, 100], [], "hard_stop", 2),
    ([100, 102, 103, 101.5, 101.5], [], "trailing_stop", 3),
    ([100, 100.1, 100.2, 100.1, 100.2, 100.2], [], "time_exit", 4),
    ([100, 100.1, 100.2, 100.1], [1, 2], "opposing_signal", 2),
    ([100, 100.1, 100.2], [], "force_close", 2),
    ([100, 100.1, 97], [2], "hard_stop", 2),
])
def test_each_reason(spark, closes, sells, reason, at):
    bars = _path(spark, closes)
    fired = F.when(F.col("i") == 0, 1).when(F.col("i").isin(sells or [-1]), -1).otherwise(0)
    sig = bars.withColumns({"fired": fired, "strength": F.lit(1.0), "param_id": F.lit(0)})
    p = dict(param_id=0, hard_stop=2.0, trail=1.0, max_hold=4)
    cut = E.cut_to_folds(E.resolve(sig, bars, [p], F.lit(0.0)), E.whole_range(bars), bars)
    first = E.non_overlapping(cut, ["symbol", "param_id", "fold"], 4).orderBy("i").first()
    assert (first["reason"], first["exit_i"]) == (reason, at)


@pytest.mark.parametrize("n, reach, block, fan", [(300, 5, 7, 3), (900, 12, 1, 2), (400, 3, 3072, 64)])
def test_non_overlapping_as_a_tree(spark, n, reach, block, fan):
    rng = np.random.default_rng(n)
    rows = []
    for symbol in ("a", "b", "c"):
        for i in sorted(rng.choice(n, size=n // int(rng.integers(2, 9)), replace=False).tolist()):
            rows.append((symbol, int(i) + (n if symbol == "c" else 0), int(i) + (n if symbol == "c" else 0) + int(rng.integers(1, reach + 2))))
    got = {tuple(r) for r in E.non_overlapping(
        spark.createDataFrame(rows, "symbol string, i bigint, free_i bigint"), ["symbol"], reach, block, fan).collect()}
    want, free = set(), {}
    for symbol, i, out in rows:
        if i >= free.get(symbol, -1):
            want.add((symbol, i, out))
            free[symbol] = out
    assert got == want


def test_non_overlapping_of_a_hundred_thousand_blocks(spark):
    rows = spark.range(400_000).select(F.lit("a").alias("symbol"), F.col("id").alias("i"), (F.col("id") + 1 + F.col("id") * 7919 % 3).alias("free_i"))
    got = [r.i for r in E.non_overlapping(rows, ["symbol"], 3, 4).select("i").orderBy("i").collect()]
    want, free = [], 0
    for i in range(400_000):
        if i >= free:
            want.append(i)
            free = i + 1 + i * 7919 % 3
    assert got == want
