"""Blocked scans against pandas, with one series holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmith.functions.columns import div_floor
from seriesmith.operators import asof, bars, correlation, indicators
from seriesmith.operators.scan import Recurrence, Run, ema, linear_recurrences, rolling, running, with_index


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    parts = []
    for name, n in [("hot", 900), ("a", 60), ("b", 1), ("c", 7)]:
        parts.append(pd.DataFrame({
            "symbol": name, "t": np.sort(rng.choice(5000, n, replace=False)).astype("int64"),
            "x": rng.normal(size=n).round(6)}))
    pdf = pd.concat(parts).sort_values(["symbol", "t"]).reset_index(drop=True)
    pdf["i"] = pdf.groupby("symbol").cumcount().astype("int64")
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("width", [1, 13, 700, 10000])
def test_running_matches_pandas(series, width):
    pdf, df = series
    path = [div_floor("t", width * 8), div_floor("t", width)]
    blocked = df.withColumns({"p0": path[0], "p1": path[1]})
    x = F.col("x")
    out = running(blocked, ["symbol"], ["p0", "p1"], ["t"], {
        "s": Run("sum", x), "n": Run("count"), "hi": Run("max", x), "lo": Run("min", x),
        "prev": Run("last", F.when(x > 0, x))}).toPandas().sort_values(["symbol", "t"]).reset_index(drop=True)
    g = pdf.groupby("symbol").x
    assert np.allclose(out.s, g.cumsum()) and (out.n == pdf.i + 1).all()
    assert (out.hi == g.cummax()).all() and (out.lo == g.cummin()).all()
    want = pdf.x.where(pdf.x > 0).groupby(pdf.symbol).ffill()
    assert out.prev.astype(float).fillna(-9).eq(want.fillna(-9)).all()


def test_exclusive_and_unkeyed(series):
    pdf, df = series
    out = running(df.withColumn("p", div_floor("t", 50)), [], ["p"], ["t", "symbol"], {
        "s": Run("sum", F.col("x"))}, exclusive=True).toPandas().sort_values(["t", "symbol"])
    want = pdf.sort_values(["t", "symbol"]).x.cumsum().shift(1)
    assert np.allclose(out.s.astype(float).fillna(0), want.fillna(0))


@pytest.mark.parametrize("span,block,chunk", [(1, 256, 64), (1.05, 16, 40), (3.7, 32, 100), (26, 64, 128), (500, 256, 4096)])
def test_ema_matches_pandas(series, span, block, chunk):
    pdf, df = series
    out = linear_recurrences(df, ["symbol"], {"y": ema("x", span, "x")}, block=block, chunk=chunk).toPandas()
    out = out.sort_values(["symbol", "i"]).reset_index(drop=True)
    want = pdf.groupby("symbol").x.transform(lambda s: s.ewm(span=span, adjust=False).mean())
    assert np.abs(out.y - want).max() < 1e-12


def test_recurrence_with_column_decay(series):
    pdf, df = series
    rec = Recurrence(F.col("x"), F.when(F.col("symbol") == "hot", 0.9).otherwise(0.5), F.lit(2.0), 0.9, 0.5)
    out = linear_recurrences(df, ["symbol"], {"y": rec}, block=16, chunk=64).toPandas().sort_values(["symbol", "i"])
    for name, g in out.groupby("symbol"):
        y, c = 2.0, 0.9 if name == "hot" else 0.5
        for got, x in zip(g.y, g.x):
            y = c * y + x
            assert got == pytest.approx(y, abs=1e-12)


@pytest.mark.parametrize("chunk", [5, 16, 4096])
def test_rolling_halo(series, chunk):
    pdf, df = series
    out = rolling(df, ["symbol"], 4, lambda f, s: f.withColumn(
        "m", F.sum("x").over(s.rowsBetween(-4, 0))), chunk=chunk).toPandas().sort_values(["symbol", "i"])
    want = pdf.groupby("symbol").x.rolling(5, min_periods=1).sum().reset_index(drop=True)
    assert len(out) == len(pdf) and np.allclose(out.m, want)


def test_index_does_not_depend_on_partitioning(spark, series):
    pdf, df = series
    results = []
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = with_index(df.drop("i").withColumn("p", div_floor("t", 37)).repartition(int(n)), ["symbol"], ["p"], ["t"])
        results.append(rows.select("symbol", "t", "i").toPandas().sort_values(["symbol", "t"]).values.tolist())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == pdf[["symbol", "t", "i"]].values.tolist()


@pytest.mark.parametrize("block", [1, 64])
def test_asof_matches_merge(spark, series, block):
    pdf, df = series
    rng = np.random.default_rng(5)
    slow = pd.DataFrame({"symbol": rng.choice(["hot", "a", "c"], 80), "t": rng.integers(100, 5000, 80)}).drop_duplicates()
    slow["v"] = np.arange(len(slow)).astype(float)
    out = asof.asof_join(df, spark.createDataFrame(slow), ["symbol"], ["v"], width=1, block=block).toPandas()
    out = out.sort_values(["t", "symbol"]).reset_index(drop=True)
    want = pd.merge_asof(pdf.sort_values("t"), slow.sort_values("t"), on="t", by="symbol").sort_values(["t", "symbol"])
    assert out.v.fillna(-1).tolist() == want.v.fillna(-1).tolist()


def test_dedupe_keeps_first(spark):
    rows = [("s", 0, k, float(k)) for k in range(500)] + [("s", 1, 9, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, t bigint, seq bigint, price double").repartition(7)
    assert sorted(map(tuple, bars.dedupe_first(df, ["symbol", "t"], "seq").collect())) == [("s", 0, 0, 0.0), ("s", 1, 9, 1.0)]


def test_indicator_edges(spark):
    flat = spark.createDataFrame([("s", k, k * 3600, 5.0, 5.0, 5.0, 5.0, 1.0) for k in range(40)],
                                 "symbol string, i bigint, t bigint, open double, high double, low double, close double, volume double")
    r = indicators.rsi(flat, [14]).orderBy("i").collect()
    assert all(x["rsi_14"] == 100.0 for x in r)
    a = indicators.atr_adx(flat).orderBy("i").collect()
    assert a[12]["atr"] is None and a[13]["atr"] == 0.0 and all(x["adx"] is None for x in a)


def test_neutral_volatility_before_warmup(spark):
    rng = np.random.default_rng(1)
    step = rng.normal(0, 0.02, 400)
    step[200:240] *= 3
    pdf = pd.DataFrame({"symbol": "s", "i": np.arange(400), "close": 100 * np.exp(np.cumsum(step))})
    out = indicators.conditional_variance(spark.createDataFrame(pdf), 0.4, 0.15, 0.75, 72).toPandas().sort_values("i")
    assert (out.vol_ratio[out.i < 72] == 1).all() and out.vol_ratio.between(0.5, 2).all() and out.vol_ratio.notna().all()
    assert out.vol_ratio[out.i.between(205, 245)].mean() < 1


def test_tail_correlation(spark):
    rng = np.random.default_rng(2)
    b = rng.normal(0, 0.005, 1000)
    cols = {"b": b, "e": 0.9 * b + rng.normal(0, 0.002, 1000), "s": 0.4 * b + rng.normal(0, 0.005, 1000)}
    pdf = pd.concat([pd.DataFrame({"symbol": k, "t": np.arange(1000), "ret": v}) for k, v in cols.items()])
    edges = {(r["a"], r["b"]): r["corr"] for r in correlation.tail_correlation(spark.createDataFrame(pdf), 720).collect()}
    want = pd.DataFrame(cols).tail(720).corr()
    for (x, y), c in edges.items():
        assert c == pytest.approx(want.loc[x, y], abs=1e-12)
    assert edges[("b", "e")] > 0.8 and 0.1 < edges[("b", "s")] < 0.7
    few = correlation.tail_correlation(spark.createDataFrame(pdf[pdf.t < 100]), 720).collect()
    assert all(r["corr"] is None for r in few)
