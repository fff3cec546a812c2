"""Plug-in points: a strategy turns bars and parameter sets into signal rows."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .signals import Benchmark, features, signal_rows

# parameter names of the layered strategy and its exits (fixed values)
PARAMETERS = [
    "fast", "slow", "signal", "rsi_period", "rsi_lower", "rsi_upper", "rsi_lookback", "trend_tf",
    "adx_min", "hard_stop", "trail", "max_hold",
]


class Strategy(Protocol):
    """Columns only: a strategy composes DataFrame expressions, there is no per-row Python.

    ``signals`` returns sparse rows ``symbol, param_id, i, t, fired, strength, high, low,
    close``; ``paths`` returns the bars exits are searched on, with ``atr``.
    """

    def signals(self, bars: DataFrame, params: list[dict]) -> DataFrame: ...

    def paths(self, bars: DataFrame, params: list[dict]) -> DataFrame: ...

    def defaults(self) -> dict: ...


class LayeredStrategy:
    """MACD cross, RSI zone, slower trend, benchmark regime and ADX layers."""

    def __init__(self, bench: Benchmark | None = None, align: str = "closed"):
        self.bench, self.align, self._paths = bench, align, {}

    def paths(self, bars: DataFrame, params: list[dict]) -> DataFrame:
        zones = tuple(sorted({(p["rsi_period"], p["rsi_lower"], p["rsi_upper"], p["rsi_lookback"]) for p in params}))
        key = (id(bars), zones)
        if key not in self._paths:
            # the bars are kept next to the result so that their identity stays unique
            self._paths[key] = (bars, settle(features(bars, list(zones))))
        return self._paths[key][1]

    def signals(self, bars: DataFrame, params: list[dict]) -> DataFrame:
        return signal_rows(bars, params, self.bench, self.align, self.paths(bars, params))

    def defaults(self) -> dict:
        return dict(fast=10.5, slow=27.0, signal=9.0, rsi_period=14, rsi_lower=30, rsi_upper=70, rsi_lookback=3,
                    trend_tf="8h", adx_min=20.0, hard_stop=2.5, trail=3.0, max_hold=168)


def strategy_parameters(results: DataFrame, keys=("symbol",), column: str | None = None) -> DataFrame:
    """Only the strategy parameters of a flat result, given as columns or as one map."""
    if column is not None:
        kept = F.map_filter(column, lambda k, _: k.isin(PARAMETERS))
        return results.select(*keys, kept.alias(column))
    return results.select(*keys, *[c for c in results.columns if c in PARAMETERS])
