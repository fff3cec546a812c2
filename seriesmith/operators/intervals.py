"""Interval operators: bucketed range join and open-interval counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, div_floor
from .scan import Run, running


def forward_join(left: DataFrame, right: DataFrame, keys, left_at: str, right_at: str, reach: int,
                 how="inner", first: int = 1) -> DataFrame:
    """Pairs with ``left_at + first <= right_at <= left_at + reach`` per key.

    The left side is copied to the (at most two) buckets its reach touches and joined by
    equality, so a long series is spread over its buckets and no nested loop is planned.
    A left row meets at most ``reach`` positions.
    """
    keys = list(keys)
    spread = left.withColumn(
        "__bucket",
        F.explode(F.sequence(
            div_floor(F.col(left_at) + first, reach), div_floor(F.col(left_at) + reach, reach)
        )),
    )
    other = right.withColumn("__bucket", div_floor(right_at, reach))
    joined = spread.join(other, [*keys, "__bucket"], how)
    gap = F.col(right_at) - F.col(left_at)
    return joined.filter(gap.between(first, reach)).drop("__bucket")


def open_timeline(intervals: DataFrame, keys, path, start="entry_t", end="exit_t", at="at") -> DataFrame:
    """Open-interval counts at every moment something opens or closes.

    Events are summed per moment before any ordering, so the scan sees one row per moment.
    ``before`` counts intervals open just before the entries of that moment (exits of the
    moment are already gone), ``after`` includes them.  Intervals of no length never count.
    """
    intervals = intervals.filter(col(end) > col(start))
    opens = intervals.select(*keys, col(start).alias(at), F.lit(1).alias("o"), F.lit(0).alias("c"))
    closes = intervals.select(*keys, col(end).alias(at), F.lit(0).alias("o"), F.lit(1).alias("c"))
    per_moment = (
        opens.unionByName(closes).groupBy(*keys, at)
        .agg(F.sum("o").alias("opened"), F.sum("c").alias("closed"))
    )
    per_moment = per_moment.withColumns(path)
    levels = running(
        per_moment, keys, list(path), [at], {"after": Run("sum", F.col("opened") - F.col("closed"))}
    )
    return levels.withColumn("before", F.col("after") - F.col("opened")).drop(*path)
