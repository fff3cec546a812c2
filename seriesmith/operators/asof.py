"""As-of alignment of a slower series to a base series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, div_floor
from .scan import BLOCK_BARS, Run, running


def asof_join(base: DataFrame, slow: DataFrame, keys, values, base_ts="t", slow_ts="t",
              width=3600, before_first="null", block=BLOCK_BARS) -> DataFrame:
    """For each base row the values of the last slow row with ``slow_ts <= base_ts``.

    Both sides are stacked and the last slow row is carried forward over time blocks, so
    no row is compared with another series' rows and no range join is needed.
    ``before_first='clip'`` gives base rows before the first slow row that row's values.
    """
    keys = list(keys)
    base_cols = base.columns
    packed = F.struct(col(slow_ts).alias("__at"), *[F.col(v) for v in values])
    left = base.select(
        *keys, col(base_ts).alias("__ts"), F.lit(1).alias("__side"),
        F.struct(*[F.col(c) for c in base_cols]).alias("__row"),
    )
    right = slow.select(
        *keys, col(slow_ts).alias("__ts"), F.lit(0).alias("__side"), packed.alias("__val")
    )
    both = left.unionByName(right, allowMissingColumns=True).withColumn(
        "__blk", div_floor("__ts", width * block)
    )
    scanned = running(
        both, keys, ["__blk"], ["__ts", "__side"], {"__last": Run("last", F.col("__val"))}
    ).filter(F.col("__side") == 1)
    value = F.col("__last")
    if before_first == "clip":
        first = slow.groupBy(*keys).agg(F.min_by(packed, col(slow_ts)).alias("__first"))
        scanned = scanned.join(first, keys, "left")
        value = F.coalesce(F.col("__last"), F.col("__first"))
    return scanned.select(
        *[F.col("__row")[c].alias(c) for c in base_cols],
        *[value[v].alias(v) for v in values],
        value["__at"].alias("asof_t"),
    )
