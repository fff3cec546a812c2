"""Small column helpers shared by all operators (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """``a / b``, NULL when ``b`` is zero or NULL (safe under ANSI mode)."""
    a, b = col(a), col(b)
    return F.when(b != 0, a / b)


# Prices times rates often end exactly half way between two rounded values, where the last
# bit of a double would decide.  The rounding point is moved off the decimal grid instead.
OFF_GRID = 0.31415926535


def fix(c, digits: int = 6) -> Column:
    """Round for presentation; adding 0.0 turns -0.0 into 0.0."""
    return F.round(col(c).cast("double") + F.lit(OFF_GRID * 10.0 ** -digits), digits) + F.lit(0.0)


def clip(c, lo, hi) -> Column:
    """Limit to [lo, hi]; NULL stays NULL (``least`` and ``greatest`` would skip it)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), lo), hi))


def epoch(ts) -> Column:
    """Seconds since 1970 of a UTC timestamp column, bigint."""
    return F.unix_seconds(col(ts).cast("timestamp"))


def day_number(ts) -> Column:
    """Days since 1970, int."""
    return F.unix_date(F.to_date(col(ts)))


def div_floor(c, n) -> Column:
    """Floor division for bigint columns (also for negative values)."""
    return F.floor(col(c) / n).cast("bigint")


def case_map(key, mapping: dict, default=None) -> Column:
    """Look a key up in a small constant dictionary."""
    out = None
    for k, v in mapping.items():
        out = (F if out is None else out).when(col(key) == F.lit(k), F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def hash_uniform(seed: int, *cols) -> Column:
    """Uniform double in [0, 1) that depends only on the values, never on partitioning."""
    h = F.xxhash64(F.lit(seed), *[col(c) for c in cols])
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def text_uniform(seed: int, *cols) -> Column:
    """As ``hash_uniform``, from the first 32 bits of an MD5 that other engines have as well."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
