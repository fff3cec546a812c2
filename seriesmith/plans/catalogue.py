"""All registered queries."""

from . import bar_queries, engine_queries, file_queries, portfolio_queries, trade_queries  # noqa: F401
from .registry import QUERIES, SQL, full_sql  # noqa: F401


def flagship(spark, sf_dir):
    return QUERIES["trade_summary_engine"](spark, sf_dir)
