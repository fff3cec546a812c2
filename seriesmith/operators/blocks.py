"""Scores of unions of blocks from mergeable block summaries.

Trades of a block are reduced once to a summary; the summary of two blocks in a row follows from
theirs, so the score of any union of blocks is a fold over at most as many summaries as there are
blocks.  No trade is copied to the combinations it takes part in.

A summary describes the equity relative to its value before the block, as logarithms:

* ``n`` trades, ``growth`` over the block, ``low`` and ``high``: the lowest and highest prefix, start
  included, ``worst``: the deepest fall from an earlier high;
* the daily returns in between: the first and the last exit day with the growth on them, which may go
  on in the neighbouring block, and over the days strictly inside the sum and sum of squares.

Joining x and y: growth adds up, y's prefixes are shifted by x's growth, the deepest fall is x's, y's,
or from x's high to y's low; where x ends on the day y starts, that day's growth is their sum.
The operation is associative, and the empty summary is neutral.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .equity import ratio_or_zero
from .metrics import objective

FIELDS = ["n", "growth", "low", "high", "worst", "first_day", "first_growth", "last_day", "last_growth", "days_sum", "days_square"]


def summaries(trades: DataFrame, keys, block: str, log_growth: Column, order="i", day="exit_day") -> DataFrame:
    """One summary (column ``s``) for each (keys, block); ``log_growth`` is the logarithm of a trade's factor.

    A block's trades are one group: at most as many as the block has bars."""
    own = [*keys, block]
    w = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("__g", log_growth).withColumn("__p", F.sum("__g").over(w))
    t = t.withColumn("__h", F.greatest(F.lit(0.0), F.max("__p").over(w)))
    ends = t.groupBy(*own).agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    per_day = t.groupBy(*own, F.col(day).alias("__day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__g").alias("g"), F.min("__p").alias("low"), F.max("__p").alias("high"),
        F.min(F.col("__p") - F.col("__h")).alias("worst")).join(ends, own)
    g, inside = F.col("g"), (F.col("__day") > F.col("__lo")) & (F.col("__day") < F.col("__hi"))
    r = F.exp(g) - 1

    def at(edge):
        return F.sum(F.when(F.col("__day") == F.col(edge), g))

    return per_day.groupBy(*own).agg(F.struct(
        F.sum("n").alias("n"), F.sum("g").alias("growth"), F.least(F.lit(0.0), F.min("low")).alias("low"),
        F.greatest(F.lit(0.0), F.max("high")).alias("high"), F.min("worst").alias("worst"),
        F.max("__lo").alias("first_day"), at("__lo").alias("first_growth"),
        F.max("__hi").alias("last_day"), at("__hi").alias("last_growth"),
        F.coalesce(F.sum(F.when(inside, r)), F.lit(0.0)).alias("days_sum"),
        F.coalesce(F.sum(F.when(inside, r * r)), F.lit(0.0)).alias("days_square")).alias("s"))


def empty() -> Column:
    zero, none = F.lit(0.0), F.lit(None).cast("int")
    return F.struct(
        F.lit(0).cast("bigint").alias("n"), *[zero.alias(f) for f in ("growth", "low", "high", "worst")],
        none.alias("first_day"), zero.alias("first_growth"), none.alias("last_day"), zero.alias("last_growth"),
        zero.alias("days_sum"), zero.alias("days_square"))


def joined(x: Column, y: Column) -> Column:
    """The summary of ``x`` followed by ``y``."""
    meet = x["last_day"] == y["first_day"]
    x_one, y_one = x["first_day"] == x["last_day"], y["first_day"] == y["last_day"]
    shared = x["last_growth"] + y["first_growth"]

    def closed(power):
        """Days that become inner ones: the end of x and the start of y, or their common day."""
        def term(g):
            return F.pow(F.exp(g) - 1, F.lit(float(power)))

        both = F.when(~x_one & ~y_one, term(shared)).otherwise(0.0)
        apart = F.when(~x_one, term(x["last_growth"])).otherwise(0.0) + F.when(~y_one, term(y["first_growth"])).otherwise(0.0)
        return F.when(meet, both).otherwise(apart)

    full = F.struct(
        (x["n"] + y["n"]).alias("n"), (x["growth"] + y["growth"]).alias("growth"),
        F.least(x["low"], x["growth"] + y["low"]).alias("low"), F.greatest(x["high"], x["growth"] + y["high"]).alias("high"),
        F.least(x["worst"], y["worst"], x["growth"] + y["low"] - x["high"]).alias("worst"),
        x["first_day"].alias("first_day"), F.when(meet & x_one, shared).otherwise(x["first_growth"]).alias("first_growth"),
        y["last_day"].alias("last_day"), F.when(meet & y_one, shared).otherwise(y["last_growth"]).alias("last_growth"),
        (x["days_sum"] + y["days_sum"] + closed(1)).alias("days_sum"),
        (x["days_square"] + y["days_square"] + closed(2)).alias("days_square"))
    return F.when(x["n"] == 0, y).when(y["n"] == 0, x).otherwise(full)


def daily_sharpe(s: Column, periods=365) -> Column:
    """Mean over sample deviation of the daily returns behind the first exit day; idle days return zero."""
    n = (s["last_day"] - s["first_day"]).cast("double")
    last = F.when(n > 0, F.exp(s["last_growth"]) - 1).otherwise(0.0)
    total, square = s["days_sum"] + last, s["days_square"] + last * last
    mean = total / F.when(n > 0, n)
    std = F.sqrt(F.greatest((square - mean * mean * n) / F.when(n > 1, n - 1), F.lit(0.0)))
    return ratio_or_zero(mean, F.when(n > 1, std), periods)


def union_score(s: Column, days: Column, min_test: int, dd_floor=0.05, min_days=30) -> Column:
    """``fold_score`` of a summary."""
    annual = (F.exp(s["growth"]) - 1) * 100 / (days / 365.25)
    raw = F.greatest(F.lit(0.0), annual / F.greatest(F.lit(1.0) - F.exp(s["worst"]), F.lit(dd_floor)))
    sharpe = F.when(days >= min_days, daily_sharpe(s)).otherwise(0.0)
    return F.when(s["n"] >= min_test, objective(raw, F.greatest(F.lit(0.0), sharpe))).otherwise(0.0)
