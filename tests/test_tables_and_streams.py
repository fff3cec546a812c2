"""Progress table under replays, results folders as written by others, correlation of many series."""

import json

import numpy as np
import pandas as pd
import pytest

from seriesmith.operators import correlation, sizing
from seriesmith.sources import runs_io
from seriesmith.streaming import live


def updates(rng, n):
    return [(f"r{rng.integers(3)}", f"s{rng.integers(4)}", int(rng.integers(1000)), int(rng.integers(90)), 100, float(rng.random()), bool(rng.random() < 0.05))
            for _ in range(n)]


def test_progress_table_equals_batch_after_replays_and_restart(spark, tmp_path):
    rng = np.random.default_rng(3)
    table = live.ProgressTable(spark, str(tmp_path / "table"), every=4)
    assert table.view().count() == 0
    seen = []
    for k in range(10):
        rows = updates(rng, 25)
        seen += rows
        df = spark.createDataFrame(rows, live.PROGRESS_SCHEMA)
        table.upsert(df, k)
        if k in (2, 3, 7, 9):  # the batch is run again, as after a lost driver, snapshot batches included
            live.ProgressTable(spark, str(tmp_path / "table"), every=4).upsert(df, k)
        whole = live.latest_progress(spark.createDataFrame(seen, live.PROGRESS_SCHEMA))
        order = ["run", "symbol"]
        assert table.view().orderBy(*order).collect() == whole.orderBy(*order).collect()


def test_progress_stream_continues_from_its_checkpoint(spark, tmp_path):
    rng = np.random.default_rng(4)
    folder, seen = tmp_path / "updates", []
    folder.mkdir()
    table = live.ProgressTable(spark, str(tmp_path / "table"), every=2)
    for k in range(4):
        rows = updates(rng, 30)
        seen += rows
        spark.createDataFrame(rows, live.PROGRESS_SCHEMA).coalesce(1).write.mode("append").json(str(folder))
        table.run(live.progress_stream(spark, str(folder), 1), str(tmp_path / "state")).awaitTermination()
    whole = live.latest_progress(spark.createDataFrame(seen, live.PROGRESS_SCHEMA))
    assert sorted(table.view().collect()) == sorted(whole.collect())


def test_scan_of_a_results_folder(spark, tmp_path):
    good = {"tag": "x", "symbols": ["a"], "stage1_results": {"a": {"sharpe_equity": 1.5, "trades": 7}}}
    for run, file, text in [
        ("r1", "pipeline_result", json.dumps(good)), ("r1", "stage2_result", '{"n_trials": 9}'),
        ("r1", "stage1/a", "{}"), ("r1", "evaluation/portfolio_metrics", '{"calmar": 2.0}'),
        ("r2", "pipeline_result", '{"tag": "cut'), ("r2", "evaluation/per_pair_metrics", '{"a": {"trades": 3}}'),
        ("r3", "stage1/b", "[")]:
        path = tmp_path / run / f"{file}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = {r.run: r for r in runs_io.scan_results(spark, str(tmp_path)).collect()}
    assert got["r1"].n_files == 4 and got["r1"].n_damaged == 0 and got["r1"].pipeline.tag == "x"
    assert got["r1"].pipeline.stage1_results["a"].trades == 7 and got["r1"].stage2.n_trials == 9 and got["r1"].portfolio.calmar == 2.0
    assert got["r1"].files == ["pipeline_result", "portfolio_metrics", "stage1/a", "stage2_result"] and got["r1"].modified is not None
    assert got["r2"].n_damaged == 1 and got["r2"].pipeline is None and got["r2"].pairs["a"].trades == 3
    assert got["r3"].n_damaged == 1 and got["r3"].n_files == 1


def test_correlation_of_many_series_over_chunks(spark):
    rng = np.random.default_rng(5)
    n, names = 230, [f"s{k:03d}" for k in range(150)]  # three blocks of series
    base = rng.normal(size=n)
    wide = pd.DataFrame({s: base * rng.normal() + rng.normal(size=n) for s in names}, index=np.arange(n) * 3600)
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    wide[names[7]] = 1.0  # does not vary
    wide.loc[: 150 * 3600, names[9]] = np.nan
    rets = wide.stack().dropna().rename("ret").reset_index().set_axis(["t", "symbol", "ret"], axis=1)
    df = spark.createDataFrame(rets).repartition(7)
    window = 60
    tail = {(r.a, r.b): r["corr"] for r in correlation.tail_correlation(df, window, chunk=50).collect()}
    want = wide.tail(window).corr(min_periods=window // 2)
    assert len(tail) == 150 * 149 // 2
    for (a, b), c in tail.items():
        w = want.loc[a, b]
        assert (c is None and np.isnan(w)) or c == pytest.approx(w, abs=1e-9)
    some = ["s000", "s007", "s009", "s077", "s149"]
    roll = correlation.rolling_correlation(df.filter(df.symbol.isin(some)), window, chunk=50).toPandas()
    assert len(roll) == n * 10
    for (a, b), part in roll.groupby(["a", "b"]):
        w = wide[a].rolling(window, min_periods=1).corr(wide[b])
        common = (wide[a].notna() & wide[b].notna()).rolling(window, min_periods=1).sum()
        w = w.where(common >= window / 2).reindex(part["t"]).to_numpy()
        if "s007" in (a, b):
            assert part["corr"].isna().all()
        else:
            assert np.allclose(part["corr"].to_numpy(float), w, atol=1e-9, equal_nan=True)


def test_open_positions_with_overlapping_trades(spark):
    rng = np.random.default_rng(6)
    bars = pd.DataFrame({"symbol": np.repeat(["a", "b"], 100), "i": np.tile(np.arange(100), 2), "close": rng.uniform(50, 150, 200)})
    bars["t"] = bars["i"] * 3600
    entry = rng.integers(0, 80, 40)
    trades = pd.DataFrame({"symbol": rng.choice(["a", "b"], 40), "i": entry, "exit_i": entry + rng.integers(0, 20, 40),
                           "side": rng.choice([1, -1], 40), "notional": rng.uniform(100, 900, 40), "entry_price": rng.uniform(50, 150, 40)})
    got = sizing.open_positions(spark.createDataFrame(trades), spark.createDataFrame(bars)).toPandas()
    assert len(got) == len(bars)
    for r in got.itertuples():
        held = trades[(trades.symbol == r.symbol) & (trades.i <= r.i) & (r.i < trades.exit_i)]
        mark = (held.notional * held.side * (r.close / held.entry_price - 1)).sum()
        assert r.n_open == len(held) and r.units * r.close - r.cost == pytest.approx(mark, abs=1e-6)
