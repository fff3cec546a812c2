"""The given star-schema tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import case_map, day_number, div_floor
from ..operators.bars import ticks_to_bars
from ..operators.scan import bar_index, split_path
from .scratch import settle

BENCHMARK = "view"
SYMBOLS = ["click", "error", "purchase", "signup", "view"]
CLUSTER = {"click": "traffic", "view": "traffic", "purchase": "convert", "signup": "convert", "error": "fault"}
SLIPPAGE = {"click": 0.0006, "view": 0.0004, "purchase": 0.0010, "signup": 0.0012}
DEFAULT_SLIPPAGE = 0.0015
OI_RATIO = {"click": 0.02, "view": 0.01, "purchase": 0.07, "signup": 0.09, "error": 0.03}
TIER = {"click": "A", "view": "A", "purchase": "B", "signup": "C", "error": "B"}
REASONS = ["opposing_signal", "hard_stop", "trailing_stop", "time_exit", "force_close"]
START_EQUITY = 10_000_000.0
ORDER_RANGE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # all time arithmetic is UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark, sf_dir, symbol="event_type") -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col(symbol).cast("string").alias("symbol"), "ts", F.col("event_id").alias("seq"),
        (F.lit(100.0) + F.col("value") / 10).alias("price"),
    )


def bars(spark, sf_dir, symbol="event_type") -> DataFrame:
    """Hourly bars with their position ``i``.

    The ticks are read once: the bars they reduce to are written before the index, which
    needs them twice.
    """
    return bar_index(settle(ticks_to_bars(ticks(spark, sf_dir, symbol))))


TRADE_ORDER = ["exit_day", "order_id", "line", "part", "supp", "price", "disc"]
TRADE_PATH = ["by_day", "by_order"]


def trades(spark, sf_dir) -> DataFrame:
    """Closed trades from ``lineitem``; profit is computed in whole cents."""
    li = table(spark, sf_dir, "lineitem")
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    disc = F.round(F.col("l_discount") * 100).cast("bigint")
    hold = (F.col("l_partkey") % 20 + 1).cast("int")
    cents = F.floor((price * (disc - 5) + 50) / F.lit(100.0))
    exit_day = day_number("l_shipdate").cast("int")
    return li.select(
        F.col("l_returnflag").alias("symbol"),
        F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("direction"),
        (exit_day - hold).cast("int").alias("entry_day"),
        exit_day.alias("exit_day"),
        hold.alias("hold_bars"),
        (cents / F.lit(100.0)).alias("pnl_abs"),
        case_map(F.col("l_linenumber") % 5, dict(enumerate(REASONS))).alias("reason"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"),
    )


def split_trades(rows: DataFrame, days: int = 1) -> DataFrame:
    """Trades with the blocks their series are scanned in: exit day, then id range.

    With ``days`` over 1 a block is that many days of a series, for keys whose series stay short
    at every scale (one supplier, one customer)."""
    by_order = div_floor("order_id", ORDER_RANGE) if days == 1 else F.lit(0).cast("bigint")
    return split_path(rows, {"by_day": div_floor("exit_day", days), "by_order": by_order})


def trial_log(spark, sf_dir) -> DataFrame:
    """A tuning log from ``orders``: one row per trial, failed ones without a value."""
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderkey").alias("number"),
        F.when(F.col("o_orderstatus") == "P", "pruned").otherwise("complete").alias("state"),
        ((cents % 1_000_003) / F.lit(250_000.0)).alias("objective"),
        ((F.col("o_custkey") * 7919 % 10_007) / F.lit(2_500.0)).alias("second"),
        (-(F.col("o_orderkey") % 3) / F.lit(2.0)).alias("third"),
        F.year("o_orderdate").alias("year"),
    )

