"""Round trips through files, and streams that must equal the batch result."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from seriesmith.operators import bars as B
from seriesmith.operators import runs as U
from seriesmith.sources import bars_io, runs_io, scratch
from seriesmith.sources import tables as T
from seriesmith.streaming import live


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="seriesmith-test-")


def test_bars_round_trip(spark, data, folder):
    long = B.stack_timeframes(B.ticks_to_bars(T.ticks(spark, data)), ("1h", "4h"))
    bars_io.write_bars(long, f"{folder}/bars")
    back = bars_io.read_bars(spark, f"{folder}/bars")
    cols = ["symbol", "tf", "t", "open", "high", "low", "close", "volume"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, long.select(cols).collect()))
    some = bars_io.read_bars(spark, f"{folder}/bars", ["click", "absent"], ["4h"], T.BENCHMARK)
    assert {(r["symbol"], r["tf"]) for r in some.select("symbol", "tf").distinct().collect()} == {("click", "4h"), ("view", "4h")}
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "symbol#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_exchange_rows(spark):
    rows = spark.createDataFrame([("s", "1h", 3_600_000, 1.0, 1), ("s", "1h", 3_600_000, 2.0, 0), ("s", "1h", 7_200_000, 3.0, 2)],
                                 "symbol string, tf string, epoch_ms bigint, close double, ingest_seq bigint")
    got = bars_io.from_exchange_rows(rows).orderBy("ts").collect()
    assert [r["close"] for r in got] == [2.0, 3.0]


def test_run_files(spark, folder):
    def put(path, doc):
        os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
        with open(f"{folder}/{path}", "w") as f:
            f.write(doc if isinstance(doc, str) else json.dumps(doc, indent=1))

    put("r1/pipeline_result.json", {"tag": "x", "symbols": ["a"], "hours": 5, "stage1_results": {"a": {"sharpe_equity": 1.5}}})
    put("r1/evaluation/per_pair_metrics.json", {"a": {"sharpe_ratio_equity_based": 2.0, "trades": 7}, "b": {"calmar_ratio": 1.0}})
    put("r1/stage2_result.json", {"objectives": {"portfolio_calmar": 1.2}, "portfolio_params": {"max_concurrent": 3}, "n_trials": 9})
    put("r1/evaluation/portfolio_metrics.json", {"calmar_ratio": 0.7, "trades": 11})
    put("r2/stage1/a_progress.json", {"trials_completed": 3})
    put("r3/pipeline_result.json", "{ broken")
    docs = {r["run"]: r for r in runs_io.read_pipeline_results(spark, folder).collect()}
    assert docs["r1"]["tag"] == "x" and docs["r1"]["stage1_results"]["a"]["sharpe_equity"] == 1.5 and docs["r3"]["tag"] is None
    pairs = {(r["run"], r["symbol"]): r for r in runs_io.read_per_pair_metrics(spark, folder).collect()}
    assert pairs[("r1", "a")]["trades"] == 7 and pairs[("r1", "b")]["calmar_ratio"] == 1.0
    two = runs_io.read_stage2_results(spark, folder).first()
    assert two["run"] == "r1" and two["objectives"]["portfolio_calmar"] == 1.2 and two["portfolio_params"]["max_concurrent"] == 3.0
    assert runs_io.read_portfolio_metrics(spark, folder).first()["trades"] == 11
    files = runs_io.list_artefacts(spark, folder)
    status = {r["run"]: (r["phase"], r["status"]) for r in U.phase(files).collect()}
    assert status == {"r1": ("pre_s2", "completed"), "r2": ("wf_eval", "running"), "r3": ("wf_eval", "completed")}
    assert U.latest_unfinished(files).first()["run"] == "r2"
    made = files.select("run", "file").union(spark.createDataFrame([("r9", "notes")], "run string, file string"))
    assert U.latest_unfinished(made).first()["run"] == "r2"
    assert U.latest_unfinished(made.withColumn("new", F.col("run") == "r9"), recent="new").first()["run"] == "r9"
    assert [r["run"] for r in U.search(docs and runs_io.read_pipeline_results(spark, folder), "x").collect()] == ["r1"]


def test_sinks(spark, folder):
    t = spark.createDataFrame([("a", 1, 2.5), ("b", 2, -1.0)], "symbol string, i int, pnl_abs double")
    runs_io.write_trades_csv(t, f"{folder}/trades")
    back = spark.read.option("header", True).schema("i int, pnl_abs double, symbol string").csv(f"{folder}/trades")
    assert sorted(map(tuple, back.select("symbol", "i", "pnl_abs").collect())) == [("a", 1, 2.5), ("b", 2, -1.0)]
    runs_io.write_trades_csv(t.limit(0), f"{folder}/none")
    runs_io.write_documents(t.withColumn("run", F.lit("r1")), f"{folder}/docs")
    assert spark.read.json(f"{folder}/docs").count() == 2
    runs_io.write_stage_table(t, folder, "top_trials")
    assert spark.read.parquet(f"{folder}/top_trials").count() == 2


class _Session:
    """A session whose settings are given: core settings cannot change at run time."""

    def __init__(self, **values):
        self.conf = self
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_scratch_folder_is_taken_from_the_session(spark):
    shared = _Session(**{"spark.checkpoint.dir": "hdfs://shared/cp", "spark.master": "yarn"})
    assert scratch.scratch_dir(shared) == "hdfs://shared/cp"
    assert scratch.scratch_dir(_Session(**{"spark.sql.warehouse.dir": "hdfs://shared/wh"})) == "hdfs://shared/wh"
    df = scratch.settle(spark.range(5))
    assert df.count() == 5 and df.inputFiles()[0].startswith(f"file://{scratch.scratch_dir(spark)}".replace("file://file:", "file:"))


def drain(df, folder, mode):
    q = df.writeStream.format("memory").queryName("drained_" + mode).outputMode(mode).option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table("drained_" + mode)


def test_stream_bars_equal_batch(spark, data, folder):
    ev = spark.read.parquet(f"{data}/events.parquet")
    # three files in time order; the second repeats some rows of the first
    cut1, cut2 = [r["t"] for r in ev.selectExpr("explode(percentile_approx(unix_micros(cast(ts as timestamp)), array(0.3, 0.6))) t").collect()]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    parts = [ev.filter(us <= cut1), ev.filter((us > cut1 - 3_000_000_000) & (us <= cut2)), ev.filter(us > cut2 - 60_000_000)]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    streamed = drain(live.hourly_bars(live.tick_stream(spark, f"{folder}/in", per_trigger=1)), folder, "append")
    batch = B.ticks_to_bars(T.ticks(spark, data))
    cols = ["symbol", "t", "open", "high", "low", "close", "volume"]
    have = {(r["symbol"], r["t"]): tuple(r) for r in streamed.select(cols).collect()}
    last = ev.select(F.max(us)).first()[0] / 1e6 - 7200
    want = {(r["symbol"], r["t"]): tuple(r) for r in batch.select(cols).collect() if r["t"] + 3600 <= last}
    assert have == want and len(want) > 100


def test_progress_stream_equals_batch(spark, folder):
    rows = [(f"r{k % 2}", f"s{k % 3}", k, k * 2 % 40, 30, float(k), k % 3 == 1 and k > 50) for k in range(60)]
    df = spark.createDataFrame(rows, live.PROGRESS_SCHEMA)
    for lo in (0, 20, 40):
        df.filter(F.col("updated").between(lo, lo + 19)).coalesce(1).write.mode("append").json(f"{folder}/in")
    streamed = drain(live.latest_progress(live.progress_stream(spark, f"{folder}/in")), folder, "complete")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, live.latest_progress(df).collect()))
    status = {(r.run, r.symbol): r.status for r in streamed.collect()}
    assert {s for (_, sym), s in status.items() if sym == "s1"} == {"done"} and set(status.values()) == {"done", "running"}
