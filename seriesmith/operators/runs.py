"""Comparison and roll-up of several runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefer(best: DataFrame, fallback: DataFrame, keys, values) -> DataFrame:
    """Row of ``best`` where it exists as a whole, else the row of ``fallback``."""
    keys = list(keys)
    a = best.select(*keys, F.struct(*values).alias("__a"))
    b = fallback.select(*keys, F.struct(*values).alias("__b"))
    row = F.coalesce("__a", "__b")
    return a.join(b, keys, "full").select(
        *keys, *[row[v].alias(v) for v in values],
        F.when(F.col("__a").isNotNull(), "evaluation").otherwise("tuning").alias("source"),
    )


def symbols_in_order(rows: DataFrame, run_no: str, pos: str, symbol="symbol") -> DataFrame:
    """Union of the symbols of all runs in the order they are first seen."""
    first = F.min(F.struct(run_no, pos))
    return rows.groupBy(symbol).agg(first.alias("f")).select(
        symbol, F.col("f")[run_no].alias("first_run"), F.col("f")[pos].alias("first_pos"))


def compare(metrics: DataFrame, values, run="run", symbol="symbol") -> DataFrame:
    """One row per (symbol, run) for every run and every symbol; absent ones are zero.

    The grid is the result, so each name is dealt to every run over a constant key in slices."""
    slices = 16
    runs = metrics.select(run).distinct().withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    names = metrics.select(symbol).distinct().withColumn("__k", F.pmod(F.xxhash64(symbol), F.lit(slices)).cast("int"))
    grid = names.join(runs, "__k").drop("__k")
    return grid.join(metrics, [symbol, run], "left").fillna(0, list(values))


def compare_wide(metrics: DataFrame, value: str, runs, run="run", symbol="symbol") -> DataFrame:
    """One row per symbol, one column per run."""
    return metrics.groupBy(symbol).pivot(run, list(runs)).agg(F.first(value)).fillna(0.0)


def roll_up(verdicts: DataFrame, headline: DataFrame, run="run") -> DataFrame:
    """Verdict counts and headline figures per run."""
    v = F.col("verdict")
    counts = verdicts.groupBy(run).agg(
        F.count_if(v == "PASS").alias("n_pass"), F.count_if(v == "WARN").alias("n_warn"),
        F.count_if(v == "FAIL").alias("n_fail"))
    return headline.join(counts, run, "left").fillna(0, ["n_pass", "n_warn", "n_fail"])


# artefacts in the order a run writes them, with the phase each one opens (fixed values)
PHASES = [("per_pair_metrics", "pre_s2"), ("pbo_results", "per_pair_eval"), ("wf_eval_metrics", "pbo")]
FINAL = "pipeline_result"


def phase(files: DataFrame, run="run", name="file") -> DataFrame:
    """Phase and status of each run from the file names seen so far."""
    has = lambda n: F.max((F.col(name) == n).cast("int"))
    g = files.groupBy(run).agg(
        *[has(n).alias(n) for n, _ in PHASES], has(FINAL).alias(FINAL),
        F.max(F.col(name).startswith("stage1/").cast("int")).alias("__s1"))
    p = F
    for n, label in PHASES:
        p = p.when(F.col(n) == 1, label)
    status = F.when(F.col(FINAL) == 1, "completed").when(F.col("__s1") == 1, "running").otherwise("partial")
    return g.select(run, p.otherwise("wf_eval").alias("phase"), status.alias("status"))


def latest_unfinished(files: DataFrame, run="run", name="file", recent: str | None = None) -> DataFrame:
    """The greatest run id without a final result that has started its first stage or, with the
    boolean column ``recent``, has just been made."""
    live = F.col(name).startswith("stage1/")
    if recent:
        live = live | F.col(recent)
    g = files.groupBy(run).agg(F.max(F.col(name) == FINAL).alias("__done"), F.max(live).alias("__live"))
    return g.filter(~F.col("__done") & F.col("__live")).agg(F.max(run).alias(run))


def search(runs: DataFrame, text: str, run="run", tag="tag") -> DataFrame:
    return runs.filter(F.col(run).contains(text) | F.col(tag).contains(text))


def attach_pbo(tiers: DataFrame, pbo: DataFrame, keys=("symbol",)) -> DataFrame:
    """Report join: overfitting score per tier row, -1 where it was not computed."""
    return tiers.join(pbo, list(keys), "left").withColumn("pbo", F.coalesce("pbo", F.lit(-1.0)))


def without_excluded(rows: DataFrame, tiers: DataFrame, keys=("symbol",)) -> DataFrame:
    """Rows of series that are not in tier X."""
    return rows.join(tiers.filter("tier = 'X'").select(*keys), list(keys), "left_anti")
