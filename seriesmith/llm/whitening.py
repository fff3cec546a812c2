"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Spark passes over the vectors gather a count, sums per dimension and the scatter around the mean;
what reaches the driver is one matrix whose size is the square of the vectors' length.  There the
scatter A is factored as L L^T with L lower triangular up to a permutation of its rows, taking the
largest remaining diagonal entry first, so a rank below the dimension shows as an early end.  Plane
rotations from the right then make the columns of L itself orthogonal.  The product L L^T stays the
same, so the squared column norms are its eigenvalues and the normalised columns its eigenvectors;
forming neither L^T L nor A again keeps small eigenvalues to full relative precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

#: A rotation is left out below this cosine between two columns.
ORTHOGONAL = 1e-15


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (d x rank) with L L^T = a; rows of L, sorted by pivot, are lower triangular."""
    d = len(a)
    rest = a.diagonal().copy()
    low = np.zeros((d, d))
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        p = int(np.argmax(rest))
        if not rest[p] > least:
            return low[:, :k]
        column = (a[:, p] - low[:, :k] @ low[p, :k]) / np.sqrt(rest[p])
        column[rest == -np.inf] = 0.0
        column[p] = np.sqrt(rest[p])
        low[:, k] = column
        rest -= column * column
        rest[p] = -np.inf
    return low


def one_sided_jacobi(low: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``low @ low.T``, falling, and unit eigenvectors as columns.

    A sweep meets every pair of columns once, in rounds of pairs that share no column, so a round
    is a few array operations."""
    u = low.copy()
    r = u.shape[1]
    seats = np.arange(r + r % 2)  # a round-robin; with an odd number one column rests
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            i, j = seats[: len(seats) // 2], seats[len(seats) // 2:][::-1]
            some = (i < r) & (j < r)
            i, j = i[some], j[some]
            x, y = u[:, i], u[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(c) / np.sqrt(np.maximum(a * b, np.finfo(float).tiny))
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > ORTHOGONAL
            zeta = (b - a) / np.where(turn, 2.0 * c, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1.0 / np.hypot(1.0, t)
            u[:, i], u[:, j] = cos * (x - t * y), cos * (t * x + y)
            seats[1:] = np.roll(seats[1:], 1)
        if worst <= 4 * ORTHOGONAL:
            break
    norms = np.sqrt((u * u).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, u[:, order] / norms[order]


def whole(vector_col: str, scale: int):
    """floor(scale * x) of every entry as bigint; entries beyond its range stop at its ends."""
    return F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))


def usable(vector_col: str):
    v = F.col(vector_col).cast("array<double>")
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in column])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact; beyond a bigint it stops at its end."""
    top = max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums)))
    if 4 * top * top * x.shape[1] < 2 ** 63:
        y = x * n - np.array(sums, np.int64)
        return (y * y).sum(1).tolist()
    return [min(sum((n * v - s) ** 2 for v, s in zip(row, sums)), 2 ** 63 - 1) for row in x.tolist()]


def added(rows: DataFrame, of, keys: str) -> DataFrame:
    """Sums of ``v`` by ``keys``, gathered a task at a time by ``of`` and then added by Spark."""
    names = [k.split(" ")[0] for k in keys.split(", ")]
    kind = "decimal(38,0)" if names == ["i"] else "double"
    return rows.mapInPandas(of, f"{keys}, v {kind}").groupBy(*names).agg(F.sum("v").alias("v"))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector on the first principal components.

    Entries become whole numbers floor(scale * x).  The fit list holds each distinct vector once:
    n vectors with sums S a dimension.  Returns for each row and component, by falling eigenvalue,
    the id column, ``component, n, deviation`` (sum of (n x - S)^2), ``whitened`` ((x - S/n) on the
    component, over the root of its eigenvalue), ``explained`` (its share of the trace) and
    ``identity_error`` (largest absolute entry of the fit list's whitened covariance, computed
    from the whitened values, minus the identity).

    Rows whose vector is null, empty, or holds null or non-finite entries take no part.  Vectors
    must have one length: the most frequent among distinct vectors counts (of those the longest),
    others take no part.  Repeated rows each get their rows, but count once in the fit; a null id
    stays null.  Where the distinct vectors span fewer dimensions than ``components``, only those
    with a positive eigenvalue are returned; with one distinct vector or an empty table the result
    is empty.  Other columns are not read.

    Distinct vectors are found by a hash aggregate that combines copies before the shuffle, so a
    vector that most rows share is a row a task.  Passes send sums only: at most d(d+1)/2 numbers a
    task, the same to the driver, for vectors of length d."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).alias("id"), whole(vector_col, scale).alias("x"))
    fit = settled(rows.select("x").distinct())
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    d, n = lengths[0]["d"], lengths[0]["n"]
    fit, rows = fit.where(F.size("x") == d), rows.where(F.size("x") == d)

    def sums_of(batches):
        from decimal import Decimal

        total = [0] * d
        for b in batches:
            x = matrix(b["x"])
            small = int(np.abs(x).max(initial=0)) < 2 ** 63 // max(len(x), 1)
            part = x.sum(0).tolist() if small else [sum(c) for c in zip(*x.tolist())]
            total = [a + int(p) for a, p in zip(total, part)]
        yield pd.DataFrame({"i": range(d), "v": map(Decimal, total)})

    sums = [0] * d
    for r in added(fit, sums_of, "i int").collect():
        sums[r["i"]] = int(r["v"])
    mean = np.array([s / n for s in sums])
    upper = np.triu_indices(d)

    def scatter_of(batches):
        total = np.zeros((d, d))
        for b in batches:
            y = matrix(b["x"]) - mean
            total += y.T @ y
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "v": total[upper]})

    scatter = np.zeros((d, d))
    for r in added(fit, scatter_of, "i int, j int").collect():
        scatter[r["i"], r["j"]] = scatter[r["j"], r["i"]] = r["v"]
    values, units = one_sided_jacobi(pivoted_cholesky(scatter))
    values, units = values[:components] / n, units[:, :components]
    kept, trace = len(values), float(np.trace(scatter)) / n
    if not kept:
        return spark.createDataFrame([], schema)
    turn = units / np.sqrt(values)

    def identity_of(batches):
        total, first = np.zeros((kept, kept)), np.zeros(kept)
        for b in batches:
            w = (matrix(b["x"]) - mean) @ turn
            total += w.T @ w
            first += w.sum(0)
        i, j = np.indices((kept, kept)).reshape(2, -1)
        yield pd.DataFrame({"i": np.r_[i, np.full(kept, -1)], "j": np.r_[j, np.arange(kept)], "v": np.r_[total.ravel(), first]})

    second, first = np.zeros((kept, kept)), np.zeros(kept)
    for r in added(fit, identity_of, "i int, j int").collect():
        if r["i"] < 0:
            first[r["j"]] = r["v"] / n
        else:
            second[r["i"], r["j"]] = r["v"] / n
    error = float(np.abs(second - np.outer(first, first) - np.eye(kept)).max())
    explained = values / trace

    def project(batches):
        for b in batches:
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            k = len(x)
            columns = {
                "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), k), "n": np.full(k * kept, n),
                "deviation": np.repeat(np.array(deviations(x, n, sums), np.int64), kept), "whitened": ((x - mean) @ turn).ravel(),
                "explained": np.tile(explained, k), "identity_error": np.full(k * kept, error)}
            ids = b["id"].take(pa.array(np.repeat(np.arange(k), kept)))
            yield pa.record_batch([ids, *map(pa.array, columns.values())], names=[id_col, *columns])

    return rows.mapInArrow(project, schema)
