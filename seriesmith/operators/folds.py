"""Walk-forward folds, out-of-sample windows, combinatorial splits, parameter sets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div_floor, hash_uniform


@dataclass(frozen=True)
class FoldRules:
    """Row-count thresholds and the static fold tables (fixed values)."""

    minimum: int = 4000
    medium: int = 13140
    long: int = 26280
    purge: int = 50
    test_size: float = 0.20
    # (train_end, test_end) as fractions of the rows
    short_folds: tuple = ((0.70, 0.85), (0.85, 1.00))
    medium_folds: tuple = ((0.60, 0.70), (0.70, 0.80), (0.80, 0.90))
    long_folds: tuple = ((0.50, 0.60), (0.60, 0.70), (0.70, 0.80), (0.80, 0.90), (0.90, 1.00))
    # (ceiling, windows) for short, medium, long data
    oos: tuple = ((0.80, 1), (0.75, 3), (0.70, 3))


def series_lengths(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _pairs(table) -> Column:
    return F.array(*[
        F.struct(F.lit(k).alias("fold"), F.lit(float(a)).alias("train_end"), F.lit(float(b)).alias("test_end"))
        for k, (a, b) in enumerate(table)
    ])


def _floor(c: Column) -> Column:
    return F.floor(c).cast("bigint")


def walk_forward(lengths: DataFrame, rules: FoldRules = FoldRules(), n_folds: int | None = None,
                 ceiling: float = 1.0) -> DataFrame:
    """Anchored folds per series from its length ``n``; series that are too short get none.

    Result: fractions and the row numbers ``train_end_i, test_start_i, test_end_i``.
    """
    n = F.col("n").cast("double")
    purge = F.lit(float(rules.purge)) / n
    ok = lengths.filter(F.col("n") >= rules.minimum)
    if ceiling < 1.0:
        eff = _floor(n * ceiling)
        ok = ok.filter(eff >= rules.minimum)
        count = F.when(eff >= rules.long, 5).when(eff >= rules.medium, 3).otherwise(2)
        anchor, test = ceiling * 0.50, rules.test_size * ceiling
        room = F.lit(ceiling - anchor - test) - purge
        room = F.when(room <= 0, F.lit(ceiling - anchor) - purge).otherwise(room)
        step = F.greatest(room / count, F.lit(0.05))
        ok = ok.withColumns({"__step": step, "__p": purge}).withColumn(
            "fold", F.explode(F.sequence(F.lit(0), count - 1)))
        end = F.lit(anchor) + (F.col("fold") + 1) * F.col("__step")
        ok = ok.withColumn("__end", end).filter(F.col("__end") <= ceiling)
        begin = F.col("__end") + F.col("__p")
        stop = F.least(begin + test, F.lit(ceiling))
        rows = ok.filter(stop > begin).select(
            *lengths.columns, "fold", F.round("__end", 4).alias("train_end"),
            F.round(begin, 4).alias("test_start"), F.round(stop, 4).alias("test_end"),
        )
    elif n_folds is not None and n_folds >= 2:
        step = (F.lit(1.0 - 0.50 - rules.test_size) - purge) / n_folds
        rows = ok.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
        rows = rows.withColumn("train_end", F.lit(0.50) + (F.col("fold") + 1) * step)
        rows = rows.withColumn("test_start", F.col("train_end") + purge).withColumn(
            "test_end", F.least(F.col("test_start") + rules.test_size, F.lit(1.0)))
    else:
        table = (
            F.when(n >= rules.long, _pairs(rules.long_folds))
            .when(n >= rules.medium, _pairs(rules.medium_folds))
            .otherwise(_pairs(rules.short_folds))
        )
        rows = ok.withColumn("f", F.explode(table)).select(*lengths.columns, "f.*")
        rows = rows.withColumn("test_start", F.col("train_end") + purge)
    return rows.withColumns({
        "train_end_i": _floor(n * F.col("train_end")),
        "test_start_i": _floor(n * F.col("test_start")),
        "test_end_i": _floor(n * F.col("test_end")),
    })


def out_of_sample(lengths: DataFrame, rules: FoldRules = FoldRules(), min_rows=100) -> DataFrame:
    """Windows behind the tuning ceiling; the last one takes the remainder."""
    n = F.col("n")
    kind = [n >= rules.long, n >= rules.medium]

    def pick(k):
        return F.when(kind[0], rules.oos[2][k]).when(kind[1], rules.oos[1][k]).otherwise(rules.oos[0][k])

    w = lengths.withColumns({"ceiling": pick(0).cast("double"), "windows": pick(1).cast("int")})
    w = w.withColumn("ceiling_i", _floor(n * F.col("ceiling")))
    w = w.withColumn("__size", div_floor(n - F.col("ceiling_i"), F.col("windows")))
    w = w.withColumn("window", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    w = w.withColumn("start_i", F.col("ceiling_i") + F.col("window") * F.col("__size"))
    w = w.withColumn(
        "end_i", F.when(F.col("window") == F.col("windows") - 1, n).otherwise(F.col("start_i") + F.col("__size")))
    return w.filter(F.col("end_i") - F.col("start_i") >= min_rows).drop("__size", "ceiling")


def combo_ids(n_blocks: int) -> Column:
    """Array of all train sets of half the blocks: bit patterns with n/2 ones."""
    every = F.sequence(F.lit(0).cast("bigint"), F.lit((1 << n_blocks) - 1).cast("bigint"))
    return F.filter(every, lambda m: F.bit_count(m) == n_blocks // 2)


def cscv_combinations(spark, n_blocks: int) -> DataFrame:
    """Combinations in long form: ``combo, block, side`` with side train or test."""
    masks = spark.range(1).select(F.explode(combo_ids(n_blocks)).alias("id"))
    long = masks.select(F.col("id").alias("combo"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    return long.withColumn("role", F.expr("if(shiftright(combo, block) & 1 = 1, 'train', 'test')"))


def combination_sets(combos: DataFrame, n_blocks: int) -> DataFrame:
    """Short form: sorted train and test block arrays per combination."""
    blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    g = combos.filter("role = 'train'").groupBy("combo").agg(F.array_sort(F.collect_list("block")).alias("train"))
    return g.withColumn("test", F.array_except(blocks, F.col("train")))


def row_blocks(bars: DataFrame, lengths: DataFrame, n_blocks: int, keys=("symbol",)) -> DataFrame:
    """Block id of every row, ``n // n_blocks`` rows each; the remainder is dropped."""
    rows = bars.join(lengths, list(keys)).withColumn("__size", div_floor("n", n_blocks))
    return rows.withColumn("block", div_floor("i", F.col("__size")).cast("int")).filter(
        F.col("block") < n_blocks).drop("__size", "n")


def block_folds(lengths: DataFrame, n_blocks: int) -> DataFrame:
    """The blocks as index ranges, one fold per block."""
    size = div_floor("n", n_blocks)
    return lengths.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        *[c for c in lengths.columns if c != "n"], "fold",
        (F.col("fold") * size).alias("start_i"), ((F.col("fold") + 1) * size).alias("end_i"),
    )


def sweep_size(n: Column) -> Column:
    """Parameter sets to try by length of the series (fixed values)."""
    return F.when(n >= 39420, 50_000).when(n >= 21900, 30_000).otherwise(20_000)


@dataclass(frozen=True)
class Range:
    lo: float
    hi: float
    whole: bool = False


@dataclass(frozen=True)
class SearchSpace:
    ranges: dict[str, Range] = field(default_factory=dict)
    trend_tfs: tuple = ("4h", "8h", "1d")
    min_gap: float = 5.0


def random_sets(spark, n: int, space: SearchSpace, seed: int, first_id: int = 0, uniform=hash_uniform) -> DataFrame:
    """Seeded parameter sets; a value depends only on (seed, set, name).  ``uniform`` draws it."""
    out = spark.range(first_id, first_id + n).withColumnRenamed("id", "param_id")
    cols = {}
    for name, r in space.ranges.items():
        u = uniform(seed, "param_id", F.lit(name))
        if r.whole:
            cols[name] = (F.floor(u * (int(r.hi) - int(r.lo) + 1)) + int(r.lo)).cast("double")
        else:
            cols[name] = F.lit(float(r.lo)) + u * (float(r.hi) - float(r.lo))
    tf = F.element_at(
        F.array(*[F.lit(t) for t in space.trend_tfs]),
        (F.floor(uniform(seed, "param_id", F.lit("trend_tf")) * len(space.trend_tfs)) + 1).cast("int"),
    )
    return repair_gap(out.withColumns({**cols, "trend_tf": tf}), space.min_gap)


def repair_gap(params: DataFrame, gap: float = 5.0) -> DataFrame:
    """Force ``slow - fast >= gap``: too close sets get ``slow = int(fast) + gap``."""
    if not {"fast", "slow"} <= set(params.columns):
        return params
    close = F.col("slow") - F.col("fast") < gap
    return params.withColumn("slow", F.when(close, F.floor("fast") + gap).otherwise(F.col("slow")).cast("double"))


def valid_gap(params: DataFrame, gap: float = 5.0) -> DataFrame:
    return params.filter(F.col("slow") - F.col("fast") >= gap)


def grid_sets(spark, axes: dict[str, list]) -> DataFrame:
    """Full grid of the given axis values, numbered in axis order."""
    size = 1
    for values in axes.values():
        size *= len(values)
    out = spark.range(size).withColumnRenamed("id", "param_id")
    stride = size
    for name, values in axes.items():
        stride //= len(values)
        pos = (F.floor(F.col("param_id") / stride) % len(values)).cast("int")
        out = out.withColumn(name, F.get(F.array(*[F.lit(v) for v in values]), pos))
    return out
