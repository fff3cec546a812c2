"""Ordered scans that never put a whole series into one task.

Every scan works over *blocks*.  ``path`` is a list of columns from coarse to fine that
split a series and do not decrease along its order (for example ``[day, id_range]``).  The
rows are scanned inside their block, the blocks are summarised with a map-side aggregate,
the summaries are scanned the same way one level up, and the carry is joined back.  The
largest group in any task is one block, so a key that holds a third of all rows is spread
over its blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, div_floor

# a block with its halo fits the rows a window keeps in memory (4096 by default)
BLOCK_BARS = 3072


@dataclass(frozen=True)
class Run:
    """One running aggregate: ``kind`` is sum, count, max, min or last (non-null)."""

    kind: str
    value: Column | None = None

    def local(self, w) -> Column:
        v = self.value
        return {
            "sum": lambda: F.sum(v).over(w),
            "count": lambda: F.count(F.lit(1)).over(w),
            "max": lambda: F.max(v).over(w),
            "min": lambda: F.min(v).over(w),
            "last": lambda: F.last(v, ignorenulls=True).over(w),
        }[self.kind]()

    def summary(self, order: list[Column]) -> Column:
        v = self.value
        if self.kind == "count":
            return F.count(F.lit(1))
        if self.kind == "last":
            # rows with a NULL value get a NULL ordering and are skipped by max_by
            return F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](v)

    def merge(self, carry: Column, local: Column) -> Column:
        if self.kind == "count":
            return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        if self.kind == "sum":
            return F.when(
                carry.isNotNull() | local.isNotNull(),
                F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
            )
        if self.kind == "max":
            return F.greatest(carry, local)
        if self.kind == "min":
            return F.least(carry, local)
        return F.coalesce(local, carry)

    def lifted(self, name: str) -> "Run":
        """The same aggregate over block summaries."""
        return Run("sum" if self.kind == "count" else self.kind, F.col(name))


def running(df: DataFrame, keys, path, order, runs: dict[str, Run], exclusive=False) -> DataFrame:
    """Add running aggregates (start of series .. current row, or the row before it)."""
    order = [col(o) for o in order]
    frame_end = -1 if exclusive else 0
    w = Window.partitionBy(*keys, *path).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, frame_end
    )
    if not path:
        return df.withColumns({n: r.local(w) for n, r in runs.items()})
    blocks = df.groupBy(*keys, *path).agg(
        *[r.summary(order).alias(f"__s_{n}") for n, r in runs.items()]
    )
    carries = running(
        blocks, keys, path[:-1], [path[-1]],
        {f"__c_{n}": r.lifted(f"__s_{n}") for n, r in runs.items()}, exclusive=True,
    ).select(*keys, *path, *[f"__c_{n}" for n in runs])
    local = df.withColumns({f"__l_{n}": r.local(w) for n, r in runs.items()})
    joined = local.join(carries, [*keys, *path], "left")
    merged = joined.withColumns(
        {n: r.merge(F.col(f"__c_{n}"), F.col(f"__l_{n}")) for n, r in runs.items()}
    )
    return merged.drop(*[f"__l_{n}" for n in runs], *[f"__c_{n}" for n in runs])


def split_path(df: DataFrame, path: dict[str, Column]) -> DataFrame:
    """Add the path columns.  Every series is split the same way, long or short, so sums are
    added up in one order whatever the size, and no pass over the data comes before."""
    return df.withColumns(path)


def with_index(df: DataFrame, keys, path, order, name="i") -> DataFrame:
    """Dense position of each row in its series, from 0."""
    return running(df, keys, path, order, {name: Run("count")}).withColumn(
        name, (F.col(name) - 1).cast("bigint")
    )


def bar_index(bars: DataFrame, keys=("symbol",), ts="t", width=3600, block=BLOCK_BARS) -> DataFrame:
    """``with_index`` for rows that are unique per (keys, bar): a block of ``block`` bar
    widths holds at most ``block`` rows of a series."""
    df = bars.withColumn("__b", div_floor(ts, width * block))
    return with_index(df, list(keys), ["__b"], [ts]).drop("__b")


def rolling(df: DataFrame, keys, lookback: int, fn, index="i", chunk: int = BLOCK_BARS) -> DataFrame:
    """Apply ``fn(frame, spec)`` where every row sees its last ``lookback`` predecessors.

    The series is cut into chunks of ``chunk`` positions; each chunk also receives a copy
    of the ``lookback`` rows before it (its halo), which are dropped afterwards.  ``spec``
    is the window (series chunk ordered by position); ``fn`` may stack several windows as
    long as their lookbacks add up to at most ``lookback``.
    """
    chunk = max(chunk, lookback, 1)
    home = div_floor(index, chunk)
    copies = df.withColumn("__home", home).withColumn(
        "__chunk",
        F.explode(F.sequence(F.col("__home"), div_floor(F.col(index) + lookback, chunk))),
    )
    spec = Window.partitionBy(*keys, "__chunk").orderBy(index)
    return fn(copies, spec).filter(F.col("__chunk") == F.col("__home")).drop("__home", "__chunk")


def full_mean(c, n: int, spec) -> Column:
    """Simple mean of the last ``n`` rows, NULL unless all ``n`` are present."""
    w = spec.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(w) == n, F.avg(col(c)).over(w))


def full_std(c, n: int, spec) -> Column:
    """Population deviation of the last ``n`` rows, NULL unless all are present."""
    w = spec.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(w) == n, F.stddev_pop(col(c)).over(w))


@dataclass(frozen=True)
class Recurrence:
    """``y_t = decay * y_(t-1) + x_t`` with ``y_(-1) = start``.

    ``decay`` is a number or a column that is constant per series, in [0, 1).
    ``slowest`` bounds it from above when it is a column.
    """

    x: Column
    decay: object
    start: Column
    slowest: float | None = None
    fastest: float | None = None


_TINY = 1e-300


def _rate(c: float) -> float:
    return -math.log(max(c, _TINY))


def memory(recs, block=256) -> tuple[int, int, int]:
    """Block size, blocks a carry looks back, and the rows of history this needs.

    ``c^B`` must not overflow when inverted; contributions below 1e-20 vanish in a double.
    """
    fast = max(_rate(r.fastest if r.fastest is not None else r.decay) for r in recs)
    slow = min(_rate(r.slowest if r.slowest is not None else r.decay) for r in recs)
    size = max(1, min(block, int(500 / fast) if fast > 0 else block))
    back = max(1, math.ceil(46.0 / (size * max(slow, 1e-9))))
    return size, back, (back + 1) * size


def recur(frame: DataFrame, part, recs: dict[str, Recurrence], index="i", block=256) -> DataFrame:
    """Recurrences inside a chunk that carries ``memory(recs)`` rows of history.

    Inside a block the closed form ``c^j * sum(x_i * c^-i)`` is a running window sum; the
    carry folds the tails of the few blocks before it.  Both windows share one sort.
    """
    size, back, _ = memory(recs.values(), block)

    def c_of(r: Recurrence) -> Column:
        return F.greatest(r.decay if isinstance(r.decay, Column) else F.lit(float(r.decay)), F.lit(_TINY))

    block_no = div_floor(index, size)
    df = frame.withColumns({"__rb": block_no, "__rj": (F.col(index) - block_no * size).cast("double")})
    inside = Window.partitionBy(*part, "__rb").orderBy("__rj")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    j = F.col("__rj")
    df = df.withColumns({
        **{f"__l_{n}": F.sum(r.x * F.pow(c_of(r), -j)).over(upto) * F.pow(c_of(r), j) for n, r in recs.items()},
        **{f"__a_{n}": F.first(F.when(F.col(index) == 0, r.start)).over(upto) for n, r in recs.items()},
        "__tail": F.lead(F.lit(1)).over(inside).isNull(),
    })
    before = Window.partitionBy(*part).orderBy("__rb").rangeBetween(-back, -1)
    history = {}
    for n, r in recs.items():
        decay = F.pow(c_of(r), j + 1)
        whole = F.col(f"__l_{n}") + F.coalesce(F.col(f"__a_{n}") * decay, F.lit(0.0))
        tail = F.when(F.col("__tail"), F.struct(decay.alias("d"), whole.alias("v")))
        history[f"__h_{n}"] = F.collect_list(tail).over(before)
    df = df.withColumns(history)
    out = {}
    for n, r in recs.items():
        carry = F.coalesce(F.col(f"__a_{n}"), F.aggregate(
            f"__h_{n}", F.lit(0.0), lambda acc, e: acc * e["d"] + e["v"]))
        out[n] = F.pow(c_of(r), j + 1) * carry + F.col(f"__l_{n}")
    helpers = [f"__{p}_{n}" for n in recs for p in "lah"]
    return df.withColumns(out).drop("__rb", "__rj", "__tail", *helpers)


def linear_recurrences(df: DataFrame, keys, recs: dict[str, Recurrence], index="i", block=256,
                       chunk: int = BLOCK_BARS) -> DataFrame:
    """Evaluate several first-order recurrences in one shuffle: chunks with enough history."""
    part = [*keys, "__chunk"]
    return rolling(df, keys, memory(recs.values(), block)[2],
                   lambda f, s: recur(f, part, recs, index, block), index, chunk)


def ema(x, span, name_start, slowest_span=None, fastest_span=None) -> Recurrence:
    """Exponential mean with ``alpha = 2 / (span + 1)``, started at the first value."""
    if isinstance(span, Column):
        alpha = F.lit(2.0) / (span + 1)
        return Recurrence(
            alpha * col(x), F.lit(1.0) - alpha, col(name_start),
            slowest=1 - 2 / (slowest_span + 1), fastest=1 - 2 / (fastest_span + 1),
        )
    alpha = 2.0 / (float(span) + 1.0)
    return Recurrence(F.lit(alpha) * col(x), 1.0 - alpha, col(name_start))
