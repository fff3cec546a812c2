"""Correlation of all pairs of series by a blocked Gram matrix.

Series are dealt by hash into blocks of about ``BLOCK`` and moments into chunks, so the data become
matrices of bounded size (moments x series, missing values marked).  Two blocks of the same chunk give
the sums of x, y, xx, yy, xy and the counts of all their pairs as six matrix products; sums of
several chunks add up.  The number of series comes from the data, nothing is a column per series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, div, div_floor
from ..sources.scratch import settle
from .scan import BLOCK_BARS, with_index

#: Series in a block, about.
BLOCK = 64


def _moments(rets: DataFrame, at: str, width=3600) -> DataFrame:
    """Distinct moments with their position ``i``."""
    rows = rets.select(at).distinct().withColumn("__tb", div_floor(at, width * BLOCK_BARS))
    return with_index(rows, [], ["__tb"], [at]).select(at, "i")


def _values(rets: DataFrame, at: str, ret: str, symbol: str) -> DataFrame:
    """One value for each moment and series; of repeated rows the largest."""
    rows = rets.filter(col(ret).isNotNull()).select(at, col(symbol).alias("symbol"), col(ret).alias("ret"))
    return rows.groupBy(at, "symbol").agg(F.max("ret").alias("ret"))


def _chunks(last: int, chunk: int, halo: int) -> Column:
    """The chunks that see a moment: its own and those whose windows reach back to it."""
    return F.explode(F.sequence(div_floor("i", chunk), F.least(div_floor(F.col("i") + halo, chunk), F.lit(max(last, 0) // chunk))))


def _packed(rows: DataFrame, last: int, chunk: int, halo: int) -> DataFrame:
    """``chunk, block, first, symbols, data``: values of ``rows`` (i, symbol, ret) as matrices; a chunk has
    the ``halo`` moments before it as well."""
    symbols = settle(rows.select("symbol").distinct())
    n = symbols.count()
    # every series is in all chunks of its block, also where it has no value
    everywhere = symbols.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(last, 0) // chunk).cast("bigint"))))
    rows = rows.withColumn("chunk", _chunks(last, chunk, halo)).unionByName(everywhere, allowMissingColumns=True)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(-(-n // BLOCK) or 1)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        c, b = int(pdf["chunk"].iloc[0]), int(pdf["block"].iloc[0])
        lo, hi = max(0, c * chunk - halo), min(last, (c + 1) * chunk - 1)
        names = sorted(pdf["symbol"].unique().tolist())
        at = {s: k for k, s in enumerate(names)}
        x = np.full((hi - lo + 1, len(names)), np.nan)
        pdf = pdf[pdf["i"].notna()]
        x[pdf["i"].to_numpy(np.int64) - lo, pdf["symbol"].map(at).to_numpy(np.int64)] = pdf["ret"].to_numpy(float)
        return pd.DataFrame({"chunk": [c], "block": [b], "first": [lo], "symbols": [names], "data": [x.tobytes()]})

    return rows.groupBy("chunk", "block").applyInPandas(
        pack, "chunk bigint, block int, first bigint, symbols array<string>, data binary")


def _pairs(packed: DataFrame) -> DataFrame:
    """Every pair of blocks of a chunk, a block with itself included."""
    one, two = settle(packed), ["block", "symbols", "data"]
    other = one.select("chunk", *[F.col(c).alias(f"{c}2") for c in two])
    return one.join(other, "chunk").filter("block <= block2")


def _both(row) -> tuple:
    """Names of all pairs of different series of two blocks, and their matrices of equal shape."""
    a, b = list(row.symbols), list(row.symbols2)
    x, y = np.frombuffer(row.data).reshape(-1, len(a)), np.frombuffer(row.data2).reshape(-1, len(b))
    i, j = np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij")
    i, j = i.ravel(), j.ravel()
    if row.block == row.block2:
        i, j = i[i < j], j[i < j]
    return a, b, x, y, i, j


def _named(a, b, i, j) -> tuple[list, list]:
    lo = [min(a[p], b[q]) for p, q in zip(i, j)]
    return lo, [max(a[p], b[q]) for p, q in zip(i, j)]


SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _products(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    m, k = ~np.isnan(x), ~np.isnan(y)
    x, y, m, k = np.where(m, x, 0.0), np.where(k, y, 0.0), m.astype(float), k.astype(float)
    return [m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y]


def pearson(n, sx, sy, sxx, syy, sxy) -> Column:
    """From sums; NULL where a series does not vary."""
    up = sxy - sx * sy / n
    spread = F.greatest(sxx - sx * sx / n, F.lit(0.0)) * F.greatest(syy - sy * sy / n, F.lit(0.0))
    return div(up, F.sqrt(spread))


def tail_correlation(rets: DataFrame, window: int, at="t", ret="ret", symbol="symbol", chunk: int = BLOCK_BARS) -> DataFrame:
    """Pearson correlation of every pair over the last ``window`` moments, as edges ``a < b``.

    With fewer than half a window of common rows the value is NULL; a pair is there as soon as both
    series have a value in the window."""
    moments = settle(_moments(rets, at))
    last = moments.agg(F.coalesce(F.max("i"), F.lit(-1))).first()[0]
    rows = _values(rets, at, ret, symbol).join(moments.filter(F.col("i") > last - window), at)

    def sums(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a, b, x, y, i, j = _both(row)
                lo, hi = _named(a, b, i, j)
                yield pd.DataFrame({"a": lo, "b": hi} | {c: v[i, j] for c, v in zip(SUMS, _products(x, y))})

    per = _pairs(_packed(rows, last, chunk, 0)).mapInPandas(sums, "a string, b string, " + ", ".join(f"{c} double" for c in SUMS))
    # sums of x and y may change places between chunks only with the names, which are ordered
    g = per.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SUMS])
    return g.select("a", "b", F.when(F.col("n") >= window / 2, pearson(*map(F.col, SUMS))).alias("corr"))


def rolling_correlation(rets: DataFrame, window: int, at="t", ret="ret", symbol="symbol", chunk: int = BLOCK_BARS) -> DataFrame:
    """Correlation of every pair at every moment over the ``window`` moments up to it; NULL with fewer
    than half a window of common rows.  A chunk sees the moments before it that its windows reach."""
    moments = settle(_moments(rets, at))
    last = moments.agg(F.coalesce(F.max("i"), F.lit(-1))).first()[0]
    rows = _values(rets, at, ret, symbol).join(moments, at)
    half = window / 2

    def windows(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a, b, x, y, i, j = _both(row)
                lo, hi = _named(a, b, i, j)
                begin, end = row.chunk * chunk - row.first, len(x)
                for s in range(0, len(i), 256):  # pairs at a time
                    p, q = x[:, i[s:s + 256]], y[:, j[s:s + 256]]
                    ok = ~(np.isnan(p) | np.isnan(q))
                    p, q = np.where(ok, p, 0.0), np.where(ok, q, 0.0)
                    total = []
                    for v in (ok.astype(float), p, q, p * p, q * q, p * q):
                        c = np.vstack([np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)])
                        at_ = np.arange(begin, end)
                        total.append(c[at_ + 1] - c[np.maximum(at_ + 1 - window, 0)])
                    n, sx, sy, sxx, syy, sxy = total
                    with np.errstate(all="ignore"):
                        spread = (sxx - sx * sx / n) * (syy - sy * sy / n)
                        corr = np.where((n >= half) & (spread > 0), (sxy - sx * sy / n) / np.sqrt(spread), np.nan)
                    k = end - begin
                    w = corr.shape[1]
                    yield pd.DataFrame({
                        "i": np.repeat(np.arange(row.chunk * chunk, row.chunk * chunk + k), w),
                        "a": np.tile(np.array(lo[s:s + 256], object), k), "b": np.tile(np.array(hi[s:s + 256], object), k), "corr": corr.ravel()})

    found = _pairs(_packed(rows, last, chunk, window - 1)).mapInPandas(windows, "i bigint, a string, b string, corr double")
    return found.join(moments, "i").select(at, "a", "b", F.when(~F.isnan("corr"), F.col("corr")).alias("corr"))


def dense_matrix(edges: DataFrame, symbols) -> DataFrame:
    """Row per symbol, column per symbol: diagonal 1, missing 0."""
    flip = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    cells = [
        F.when(F.col("a") == s, F.lit(1.0)).otherwise(
            F.coalesce(F.max(F.when(F.col("b") == s, F.col("corr"))), F.lit(0.0))
        ).alias(s)
        for s in sorted(symbols)
    ]
    return flip.groupBy("a").agg(*cells).withColumnRenamed("a", "symbol")


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
