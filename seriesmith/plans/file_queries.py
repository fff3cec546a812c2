"""Round trips through files, parameter projections and block sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import folds as FD
from ..operators import runs as U
from ..operators import strategy as ST
from ..sources import bars_io, runs_io
from ..sources import tables as T
from ..sources.scratch import scratch_dir
from ..streaming import live
from .bar_queries import bars
from .registry import cte, query, r6, tidy
from .templates import out
from .trade_queries import run_metrics, trades, trials


def folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/seriesmith-{name}-{uuid.uuid4().hex}"


BAR = ["open", "high", "low", "close", "volume"]


@query("bars_round_trip", f"SELECT symbol, t, {out(*BAR)} FROM bars0 WHERE symbol IN ('click', 'error', 'view')")
def bars_round_trip(spark, d):
    """Bars written by series and read back for some series and the benchmark."""
    path = folder(spark, "bars")
    bars_io.write_bars(bars(spark, d).withColumn("tf", F.lit("1h")), path)
    return tidy(bars_io.read_bars(spark, path, ["click", "error"], ["1h"], benchmark=T.BENCHMARK), "symbol", "t", *BAR)


@query("trades_csv_round_trip", f"SELECT symbol, order_id, line::BIGINT AS line, part, supp, reason, {out('pnl_abs')} FROM tr")
def trades_csv_round_trip(spark, d):
    path = folder(spark, "trades")
    kept = ["symbol", "order_id", "line", "part", "supp", "reason", "pnl_abs"]
    runs_io.write_trades_csv(trades(spark, d).select(*kept), path)
    schema = "order_id bigint, line bigint, part bigint, supp bigint, reason string, pnl_abs double, symbol string"
    return tidy(spark.read.schema(schema).option("header", True).csv(path), *kept)


@query("stage_table_round_trip", f"SELECT symbol, number, state, {out('objective', 'second')} FROM trials")
def stage_table_round_trip(spark, d):
    path = folder(spark, "stage")
    runs_io.write_stage_table(trials(spark, d), path, "trial_history")
    return tidy(spark.read.parquet(f"{path}/trial_history"), "symbol", "number", "state", "objective", "second")


@query("run_documents_round_trip", f"SELECT run, symbol, trades, {out('sharpe', 'calmar')} FROM run_m")
def run_documents_round_trip(spark, d):
    path = folder(spark, "documents")
    runs_io.write_documents(run_metrics(spark, d), path)
    schema = "symbol string, trades bigint, sharpe double, calmar double, run string"
    return tidy(spark.read.schema(schema).json(path), "run", "symbol", "trades", "sharpe", "calmar")


YEARS = range(1992, 1999)


@query("runs_compare_wide", "SELECT symbol, " + ", ".join(
    r6(f"coalesce(max(CASE WHEN run = 'run-{y}' THEN sharpe END), 0)", f'"run-{y}"') for y in YEARS) + " FROM run_m GROUP BY symbol")
def runs_compare_wide(spark, d):
    return tidy(U.compare_wide(run_metrics(spark, d), "sharpe", [f"run-{y}" for y in YEARS]))


@query("overfit_penalty", f"""SELECT number, {r6('''CASE WHEN most <= 1 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN gate < 0.55 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN n_trades = 0 THEN 1.0::DOUBLE ELSE 0 END''', 'penalty')} FROM (
  SELECT o_orderkey AS number, 1 + o_custkey % 3 AS most, (o_orderkey % 11) / 10.0::DOUBLE AS gate, o_custkey % 5 AS n_trades FROM orders)""")
def overfit_penalty(spark, d):
    o = T.table(spark, d, "orders")
    penalty = D.overfit_penalty(1 + F.col("o_custkey") % 3, (F.col("o_orderkey") % 11) / F.lit(10.0), F.col("o_custkey") % 5)
    return tidy(o.select(F.col("o_orderkey").alias("number"), penalty.alias("penalty")))


@query("strategy_parameters", f"SELECT symbol, number, {out('fast', 'slow')}, trend_tf FROM (SELECT o_orderpriority AS symbol, o_orderkey AS number, "
       "2.5::DOUBLE + o_custkey % 20 AS fast, (10 + o_orderkey % 25)::DOUBLE AS slow, CASE WHEN o_orderkey % 2 = 0 THEN '4h' ELSE '8h' END AS trend_tf FROM orders)")
def strategy_parameters(spark, d):
    """The strategy's own columns of a flat result that also holds scores."""
    flat = T.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("number"), (F.lit(2.5) + F.col("o_custkey") % 20).alias("fast"),
        (F.lit(10) + F.col("o_orderkey") % 25).cast("double").alias("slow"),
        F.when(F.col("o_orderkey") % 2 == 0, "4h").otherwise("8h").alias("trend_tf"), F.col("o_totalprice").alias("objective"))
    return tidy(ST.strategy_parameters(flat, ["symbol", "number"]), "symbol", "number", "fast", "slow", "trend_tf")


@query("cscv_sets", """SELECT symbol, combo, string_agg(CASE WHEN (combo >> b) & 1 = 1 THEN b::VARCHAR END, ',' ORDER BY b) AS train,
  string_agg(CASE WHEN (combo >> b) & 1 = 0 THEN b::VARCHAR END, ',' ORDER BY b) AS test, (n // 8 * 4)::BIGINT AS train_rows
  FROM lens, range(256) r(combo), range(8) q(b) WHERE bit_count(combo) = 4 GROUP BY symbol, combo, n""")
def cscv_sets(spark, d):
    """Train and test blocks of each of the 70 combinations, with the rows a series trains on."""
    sets = FD.combination_sets(FD.cscv_combinations(spark, 8), 8)  # 70 rows
    rows = FD.series_lengths(bars(spark, d)).withColumn("combo", F.explode(FD.combo_ids(8))).join(F.broadcast(sets), "combo")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select("symbol", "combo", text("train"), text("test"),
                       (F.floor(F.col("n") / 8) * F.size("train")).cast("bigint").alias("train_rows"))


# ---------------------------------------------------------------- results folder
_QUARTERS = "trials_q"
cte(_QUARTERS, "SELECT *, 'run-' || year || '-' || number % 4 AS run FROM trials")
cte("q_docs", """SELECT run, count(*) AS n_trials, count(DISTINCT symbol) AS n_symbols, avg(objective) AS sharpe, max(second) AS calmar,
    (substr(run, 10, 1) <> '3') AS finished, (substr(run, 10, 1) <> '2') AS staged, run = min(run) OVER () AS hurt FROM trials_q GROUP BY run""")


def _documents(spark, d):
    """The artefacts of a run for each year and quarter of the tuning log, one of them cut in half."""
    t = trials(spark, d).withColumn("run", F.concat_ws("-", F.lit("run"), "year", F.col("number") % 4))
    per = t.groupBy("run", "symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("objective").alias("sharpe_equity"), F.max("second").alias("calmar"))
    whole = t.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_trials"), F.avg("objective").alias("sharpe_equity"), F.max("second").alias("calmar"))
    metrics = F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", F.struct("trades", "sharpe_equity", "calmar").alias("m")))))
    pairs = per.groupBy("run").agg(metrics.alias("m"))
    last = F.substring("run", 10, 1)
    docs = [
        whole.filter(last != "3").join(pairs, "run").select("run", F.lit("pipeline_result").alias("file"), F.to_json(F.struct(
            F.concat(F.lit("tag-"), "run").alias("tag"), F.map_keys("m").alias("symbols"), F.col("m").alias("stage1_results"))).alias("value")),
        whole.filter(last != "2").select("run", F.lit("stage2_result").alias("file"), F.to_json(F.struct(
            "n_trials", F.struct(F.col("calmar").alias("portfolio_calmar")).alias("objectives"))).alias("value")),
        whole.select("run", F.lit("portfolio_metrics").alias("file"), F.to_json(F.struct("sharpe_equity", "calmar")).alias("value")),
        pairs.select("run", F.lit("per_pair_metrics").alias("file"), F.to_json("m").alias("value")),
        per.select("run", F.concat(F.lit("stage1/"), "symbol").alias("file"), F.to_json(F.struct("trades")).alias("value")),
    ]
    rows = docs[0]
    for more in docs[1:]:
        rows = rows.unionByName(more)
    first = whole.agg(F.min("run")).first()[0]
    hurt = (F.col("run") == first) & (F.col("file") == "portfolio_metrics")
    return rows.withColumn("value", F.when(hurt, F.expr("left(value, length(value) div 2)")).otherwise(F.col("value")))


@query("results_scan", f"""SELECT run, n_symbols + 2 + CASE WHEN finished THEN 1 ELSE 0 END + CASE WHEN staged THEN 1 ELSE 0 END AS n_files,
  CASE WHEN hurt THEN 1 ELSE 0 END::BIGINT AS n_damaged, CASE WHEN finished THEN 'completed' ELSE 'running' END AS status, 'pre_s2' AS phase,
  CASE WHEN finished THEN 'tag-' || run END AS tag, n_symbols AS n_pairs, CASE WHEN staged THEN n_trials END AS n_trials,
  {r6('CASE WHEN NOT hurt THEN sharpe END', 'sharpe')}, {r6('CASE WHEN NOT hurt THEN calmar END', 'calmar')} FROM q_docs""")
def results_scan(spark, d):
    """A results folder written from the log, with one damaged file, read as a table of runs."""
    root = folder(spark, "results")
    runs_io.write_results(_documents(spark, d), root)
    runs = runs_io.scan_results(spark, root)
    seen = U.phase(runs.select("run", F.explode("files").alias("file")))
    rows = runs.join(seen, "run").select(
        "run", "n_files", "n_damaged", "status", "phase", F.col("pipeline.tag").alias("tag"), F.size("pairs").alias("n_pairs"),
        F.col("stage2.n_trials").alias("n_trials"), F.col("portfolio.sharpe_equity").alias("sharpe"), F.col("portfolio.calmar").alias("calmar"))
    return tidy(rows)


@query("progress_stream", f"""SELECT run, symbol, updated, completed, total, {out('best_value')}, CASE WHEN done THEN 'done' ELSE 'running' END AS status FROM (
  SELECT 'run-' || year AS run, symbol, number AS updated, number % 997 AS completed, 500::BIGINT AS total, objective AS best_value, count_if(number % 61 = 0) OVER (PARTITION BY year, symbol) > 0 AS done,
    row_number() OVER (PARTITION BY year, symbol ORDER BY number % 61 = 0 DESC, number DESC) AS k FROM trials) WHERE k = 1""")
def progress_stream(spark, d):
    """The tuning log as a stream of progress files into a keyed table, batch by batch."""
    root = folder(spark, "progress")
    rows = trials(spark, d).select(
        F.concat(F.lit("run-"), "year").alias("run"), "symbol", F.col("number").alias("updated"), (F.col("number") % 997).alias("trials_completed"),
        F.lit(500).cast("bigint").alias("trials_total"), F.col("objective").alias("best_value"), (F.col("number") % 61 == 0).alias("is_result"))
    rows.repartition(12, "updated").write.json(f"{root}/updates")
    table = live.ProgressTable(spark, f"{root}/table", every=3)
    table.run(live.progress_stream(spark, f"{root}/updates", 2), f"{root}/state").awaitTermination()
    return tidy(table.view(), "run", "symbol", "updated", "completed", "total", "best_value", "status")
