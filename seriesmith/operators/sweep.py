"""Parameter sweeps: parameter sets x series x folds in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from . import blocks
from . import exits as E
from .decisions import train_gate
from .folds import block_folds, combo_ids, cscv_combinations
from .metrics import fold_score, full_metrics
from .parameters import each_with
from .scan import BLOCK_BARS
from .selection import best_per_key, better_half
from .signals import Benchmark
from .strategy import LayeredStrategy, Strategy
from ..functions.columns import div_floor

KEY = ["symbol", "param_id", "fold"]


@dataclass(frozen=True)
class Account:
    start: float = 100_000.0
    pct: float = 0.20
    fee: float = E.FEE
    bars_per_day: int = 24


def resolved_candidates(bars: DataFrame, params: list[dict], slippage: Column, bench: Benchmark | None = None,
                        align="closed", strategy: Strategy | None = None) -> DataFrame:
    """Signals and first exits of all parameter sets, settled once for all folds."""
    strategy = strategy or LayeredStrategy(bench, align)
    sig = settle(strategy.signals(bars, params).filter(F.col("fired") != 0))
    return settle(E.resolve(sig, strategy.paths(bars, params), params, slippage))


def fold_trades(resolved: DataFrame, folds: DataFrame, bars: DataFrame, reach: int, acct: Account = Account()) -> DataFrame:
    """Non-overlapping, costed, compounded trades per (symbol, param_id, fold)."""
    cut = E.cut_to_folds(resolved, folds, bars)
    taken = E.non_overlapping(cut, KEY, reach)
    return with_days(E.compounded(taken, KEY, acct.start, E.bet_size(acct.pct), acct.fee), acct)


def with_days(trades: DataFrame, acct: Account) -> DataFrame:
    return trades.withColumns({
        "hold_bars": (F.col("exit_i") - F.col("i")).cast("int"),
        "exit_day": F.floor(F.col("exit_t") / 86400).cast("int"),
        "days": (F.col("end_i") - F.col("start_i")) / F.lit(float(acct.bars_per_day)),
        "eb": div_floor("i", BLOCK_BARS),
    })


def fold_metrics(trades: DataFrame, acct: Account = Account(), keys=KEY) -> DataFrame:
    return full_metrics(trades, list(keys), ["eb"], ["i"], acct.start, F.col("days"))


def each(ids) -> Column:
    """One row per id of a short driver-side list."""
    return F.explode(F.array(*[F.lit(int(k)) for k in ids]))


def with_sets(rows: DataFrame, sets) -> DataFrame:
    """Every row with every ``param_id``: of a table of sets (of its own symbol, if the table names
    symbols), or of a short list of ids."""
    if isinstance(sets, DataFrame) and "symbol" in sets.columns:
        return rows.join(sets.select("symbol", "param_id"), "symbol")
    if isinstance(sets, DataFrame):
        return each_with(rows, sets.select("param_id"), F.col("param_id"))
    return rows.withColumn("param_id", each(sets))


def sweep(resolved: DataFrame, folds: DataFrame, bars: DataFrame, reach: int, param_ids, acct: Account = Account(),
          warmup: int = 0, min_year: float = 60, min_test: int = 5, score=fold_score,
          attributes=("sharpe_daily", "max_drawdown", "total_pnl_pct")) -> DataFrame:
    """Score of every (symbol, param_id, fold): test score behind the train constraints.

    ``param_ids`` is a table of sets or a short list of ids.  ``score`` maps a metric table to a score column; ``attributes`` are metrics of the test
    window kept next to it.  ``folds`` comes from ``walk_forward``; train is ``[warmup, train_end_i)``, test is
    ``[test_start_i, test_end_i)``.  Both run in one job as separate folds.
    """
    f = F.col("fold")
    train = folds.select("symbol", (f * 2).alias("fold"), F.lit(warmup).cast("bigint").alias("start_i"),
                         F.col("train_end_i").alias("end_i"))
    test = folds.select("symbol", (f * 2 + 1).alias("fold"), F.col("test_start_i").alias("start_i"),
                        F.col("test_end_i").alias("end_i"))
    trades = settle(fold_trades(resolved, train.unionByName(test), bars, reach, acct))
    m = fold_metrics(trades, acct)
    m = m.withColumn("score", score(m, min_test=min_test))
    part = F.col("fold") % 2
    test_side = F.when(part == 1, F.struct("score", "trades", *attributes))
    g = m.groupBy("symbol", "param_id", F.floor(f / 2).cast("int").alias("fold")).agg(
        F.max(F.when(part == 0, F.col("trades_per_year"))).alias("train_year"), F.max(test_side).alias("t"))
    scored = g.select(
        "symbol", "param_id", "fold", "train_year", F.coalesce("t.trades", F.lit(0)).alias("test_trades"),
        train_gate(F.coalesce("t.score", F.lit(0.0)), F.col("train_year"), F.col("t.trades"), min_year, min_test).alias("score"),
        *[F.col(f"t.{a}").alias(a) for a in attributes],
    )
    # combinations without any trade still count with score zero
    grid = with_sets(folds.select("symbol", "fold"), param_ids)
    return grid.join(scored, ["symbol", "param_id", "fold"], "left").withColumns({
        "score": F.coalesce("score", F.lit(0.0)), "test_trades": F.coalesce("test_trades", F.lit(0)),
    })


def mean_scores(scores: DataFrame, attributes=()) -> DataFrame:
    """Mean over folds; failed folds count as zero, attributes average over the others."""
    return scores.groupBy("symbol", "param_id").agg(
        F.round(F.avg("score"), 9).alias("score"), F.count(F.lit(1)).alias("n_folds"),
        *[F.avg(a).alias(a) for a in attributes])


def out_of_sample_scores(resolved: DataFrame, windows: DataFrame, bars: DataFrame, reach: int, sets, acct: Account = Account(),
                         min_trades: int = 3, value="sharpe_trade") -> DataFrame:
    """``symbol, param_id, window, score, base`` of every out-of-sample window and set.

    ``windows`` comes from ``folds.out_of_sample``.  Each window is a fold of its own, from its first
    bar with no open trade; below ``min_trades`` trades its score is zero.  ``base`` is the same value in
    front of the ceiling.  Windows and the ranges in front of them run in one job."""
    w = windows.select("symbol", (F.col("window") + 1).alias("fold"), "start_i", "end_i")
    base = windows.select("symbol", F.lit(0).alias("fold"), F.lit(0).cast("bigint").alias("start_i"), F.col("ceiling_i").alias("end_i")).distinct()
    m = fold_metrics(settle(fold_trades(resolved, base.unionByName(w), bars, reach, acct)), acct)
    score = F.when(F.col("trades") >= min_trades, F.col(value)).otherwise(0.0)
    m = settle(m.select("symbol", "param_id", "fold", score.alias("score")))
    grid = with_sets(windows.select("symbol", "window"), sets)
    rows = grid.join(m.filter("fold > 0").select("symbol", "param_id", (F.col("fold") - 1).alias("window"), "score"), ["symbol", "param_id", "window"], "left")
    rows = rows.join(m.filter("fold = 0").select("symbol", "param_id", F.col("score").alias("base")), ["symbol", "param_id"], "left")
    return rows.fillna(0.0, ["score", "base"])


def successive_halving(resolved: DataFrame, folds: DataFrame, bars: DataFrame, reach: int, sets: DataFrame, n_rungs: int,
                       acct: Account = Account(), steps: int = 64, **rules) -> DataFrame:
    """Sets that survive ``n_rungs`` rungs: each rung scores one more fold, and the better half by the mean
    of the folds so far goes on (per symbol, rounded up, ties to the smaller id).

    Returns ``symbol, param_id, rung, score, evaluated``: the survivors of every rung with their mean
    and how many sets of the symbol the rung scored.  A rung resolves trades only for the sets that
    are left, so fold k costs about 2^-k of the first.  Between rungs the scores of the survivors are a
    written table; a lost executor repeats its part of one rung.  Ranks are blocked scans over
    ``steps`` buckets a unit of score.  Symbols without a fold drop out at its rung."""
    alive, so_far, out = None, None, None
    for k in range(n_rungs):
        now = folds.filter(F.col("fold") == k)
        left = resolved if alive is None else resolved.join(alive, ["symbol", "param_id"], "left_semi")
        scores = sweep(left, now, bars, reach, sets if alive is None else alive, acct, **rules)
        scores = scores.select("symbol", "param_id", "fold", "score")
        if so_far is not None:
            again = so_far.join(scores.select("symbol").distinct(), "symbol", "left_semi")
            scores = scores.unionByName(again.join(alive, ["symbol", "param_id"], "left_semi"))
        so_far = settle(scores)
        m = mean_scores(so_far).withColumn("bucket", F.floor(-F.col("score") * steps).cast("bigint"))
        n = m.groupBy("symbol").agg(F.count(F.lit(1)).alias("evaluated"))
        best = better_half(m, ["symbol"], ["bucket"]).join(n, "symbol")
        best = settle(best.select("symbol", "param_id", F.lit(k).alias("rung"), "score", "evaluated"))
        alive = best.select("symbol", "param_id")
        out = best if out is None else out.unionByName(best)
    return out


def best_sets(scores: DataFrame) -> DataFrame:
    return best_per_key(mean_scores(scores), ["symbol"], "score", "param_id")


def cscv_scores(resolved: DataFrame, lengths: DataFrame, bars: DataFrame, n_blocks: int, reach: int, param_ids,
                acct: Account = Account(), span=False, min_test: int = 5) -> DataFrame:
    """Train and test score of every (symbol, combination, parameter set).

    By default a side is the union of its blocks: trades are resolved per block and then
    follow each other.  Each block is summarised once, and a side is folded from the summaries of
    its blocks (``blocks``).  ``span=True`` uses the range from the first to the last block of a
    side instead, so both sides can overlap; ranges that several combinations share are run once.
    ``param_ids`` is a table of sets or a short list of ids.
    """
    if span:
        combos = cscv_combinations(bars.sparkSession, n_blocks)
        edge = combos.groupBy("combo", "role").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
        edge = edge.withColumn("fold", F.col("lo") * n_blocks + F.col("hi"))
        every = [lo * n_blocks + hi for lo in range(n_blocks) for hi in range(lo, n_blocks)]
        size = div_floor("n", n_blocks)
        folds = lengths.withColumn("fold", each(every)).select(
            "symbol", "fold", (F.floor(F.col("fold") / n_blocks) * size).alias("start_i"),
            ((F.col("fold") % n_blocks + 1) * size).alias("end_i"))
        folds = folds.join(F.broadcast(edge.select("fold").distinct()), "fold", "left_semi")
        m = fold_metrics(settle(fold_trades(resolved, folds, bars, reach, acct)), acct)
        m = m.withColumn("score", fold_score(m, min_test=min_test))
        sides = m.select("symbol", "param_id", "fold", "score").join(edge.select("combo", "role", "fold"), "fold")
        wide = sides.groupBy("symbol", "param_id", "combo").agg(
            F.max(F.when(F.col("role") == "train", F.col("score"))).alias("train_score"),
            F.max(F.when(F.col("role") == "test", F.col("score"))).alias("test_score"))
    else:
        taken = E.non_overlapping(E.cut_to_folds(resolved, block_folds(lengths, n_blocks), bars), KEY, reach)
        factor = F.greatest(F.lit(1.0) + E.bet_size(acct.pct) * E.price_return(acct.fee), F.lit(1e-12))  # ruin
        per = blocks.summaries(with_days(taken, acct), ["symbol", "param_id"], "fold", F.ln(factor))
        row = F.array_sort(F.collect_list(F.struct("fold", "s"))).alias("blocks")
        row = per.groupBy("symbol", "param_id").agg(row).withColumn("combo", F.explode(combo_ids(n_blocks)))
        span_days = F.floor(F.col("n") / n_blocks) * (n_blocks // 2) / F.lit(float(acct.bars_per_day))

        def side(inside):
            mine = F.filter("blocks", lambda b: F.getbit(F.col("combo"), b["fold"]) == inside)
            whole = F.aggregate(mine, blocks.empty(), lambda acc, b: blocks.joined(acc, b["s"]))
            return blocks.union_score(whole, F.col("days"), min_test)

        row = row.join(lengths, "symbol").withColumn("days", span_days)
        wide = row.select("symbol", "param_id", "combo", side(1).alias("train_score"), side(0).alias("test_score"))
    grid = with_sets(lengths.select("symbol"), param_ids).withColumn("combo", F.explode(combo_ids(n_blocks)))
    return grid.join(wide, ["symbol", "param_id", "combo"], "left").fillna(0.0, ["train_score", "test_score"])
