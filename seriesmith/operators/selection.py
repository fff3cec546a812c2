"""Top-k, best-so-far, thinning, Pareto selection and candidate ranks."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, div_floor
from .scan import Run, running, with_index


def top_k(trials: DataFrame, keys, k: int, score="objective", tie="number") -> DataFrame:
    """Best ``k`` rows per key.  The rank filter becomes a group limit before the shuffle,
    so each task forwards at most ``k`` rows of a key."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return trials.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_per_key(rows: DataFrame, keys, score="score", tie="param_id") -> DataFrame:
    """The best row per key as a map-side aggregate; ties go to the smaller id."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie)))
    return rows.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, *[F.col("__b")[c].alias(c) for c in rest])


def best_so_far(trials: DataFrame, keys, path, order="number", value="objective", ok: Column | None = None) -> DataFrame:
    """Running best over the trial number; failed trials count as zero."""
    v = col(value) if ok is None else F.when(ok, col(value)).otherwise(0.0)
    rows = trials.withColumn("value", F.coalesce(v, F.lit(0.0)))
    return running(rows, keys, path, [order], {"best": Run("max", F.col("value"))})


def thin(rows: DataFrame, keys, path, order, limit: int) -> DataFrame:
    """At most ``limit`` evenly spaced rows per key, plus the last one."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    r = with_index(rows, keys, path, [order], "__i").join(n, list(keys))
    step = F.greatest(div_floor("__n", limit), F.lit(1))
    keep = (F.col("__n") <= limit) | (
        (F.col("__i") % step == 0) & (F.col("__i") < step * limit)) | (F.col("__i") == F.col("__n") - 1)
    return r.filter(keep).drop("__i", "__n")


def better_half(scores: DataFrame, keys, path, score="score", tie="param_id", order: list | None = None) -> DataFrame:
    """One successive-halving rung: the upper half of each key, rounded up.

    ``path`` buckets the score in descending order, so the rank is a blocked scan.
    """
    n = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    r = with_index(scores, keys, path, order or [-F.col(score), F.col(tie)], "__i").join(n, list(keys))
    return r.filter(F.col("__i") < F.ceil(F.col("__n") / 2)).drop("__i", "__n")


class _Stairs:
    """Front of (b, c) pairs: b rising, c falling; answers "is some point >= (b, c)"."""

    def __init__(self):
        self.b, self.c = [], []

    def covers(self, b, c):
        k = bisect_left(self.b, b)
        return k < len(self.b) and self.c[k] >= c

    def add(self, b, c):
        k = bisect_left(self.b, b)
        lo = k
        while lo > 0 and self.c[lo - 1] <= c:
            lo -= 1
        hi = k + 1 if k < len(self.b) and self.b[k] == b else k
        self.b[lo:hi], self.c[lo:hi] = [b], [c]


def _front(pdf: pd.DataFrame, a: str, b: str, c: str) -> pd.DataFrame:
    """Rows not dominated by others (distinct triples), one descending sweep over ``a``."""
    pdf = pdf.sort_values([a, b, c], ascending=False, kind="stable")
    stairs, keep = _Stairs(), []
    for y, z in zip(pdf[b].to_numpy(), pdf[c].to_numpy()):
        free = not stairs.covers(y, z)
        keep.append(free)
        if free:
            stairs.add(y, z)
    return pdf[keep]


def pareto_front(rows: DataFrame, keys, objectives, slabs: int = 16) -> DataFrame:
    """Rows for which no other row is at least as good in all three objectives and better
    in one.

    Equal triples are merged first and each task drops what its own rows dominate.  The
    rest is cut into slabs of the first objective; every slab meets its own rows plus the
    two-dimensional fronts of the slabs above, so no task sees all candidates.
    """
    keys = list(keys)
    a, b, c = objectives
    key_types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    best_c = rows.groupBy(*keys, a, b).agg(F.max(c).alias(c))
    schema = ", ".join(f"`{k}` {key_types[k]}" for k in [*keys, a, b, c])

    def local(batches):
        # merges batch after batch; a front that grows too long is passed on as it is
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            groups = [g for _, g in held.groupby(keys, sort=False)] if keys else [held]
            held = pd.concat([_front(g, a, b, c) for g in groups])
            if len(held) > 100_000:
                yield held
                held = None
        if held is not None:
            yield held

    cand = best_c.select(*keys, a, b, c).mapInPandas(local, schema)
    steps = [k / slabs for k in range(1, slabs)]
    cuts = cand.groupBy(*keys).agg(F.percentile_approx(a, steps, 1000).alias("__cuts"))
    joined = cand.join(cuts, keys) if keys else cand.withColumn("__cuts", cuts.scalar())
    placed = joined.withColumn(
        "slab", F.size(F.filter("__cuts", lambda x: x <= F.col(a)))
    ).drop("__cuts")

    def stairs(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = pdf.assign(**{a: 0.0}).drop_duplicates([a, b, c])
        return _front(flat, a, b, c)

    slab_schema = schema + ", slab int"
    above = placed.groupBy(*keys, "slab").applyInPandas(stairs, slab_schema)
    down = above.filter(F.col("slab") > 0).withColumn(
        "slab", F.explode(F.sequence(F.lit(0), F.col("slab") - 1))
    ).withColumn("__own", F.lit(False))
    both = placed.withColumn("__own", F.lit(True)).unionByName(down)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        # fronts from above win on the first objective whatever its value
        upper = pdf[~pdf["__own"]].drop_duplicates([b, c]).assign(**{a: float("inf")})
        out = _front(pd.concat([upper, pdf[pdf["__own"]]]), a, b, c)
        return out[out["__own"]][[*keys, a, b, c]]

    front = both.groupBy(*keys, "slab").applyInPandas(finish, schema)
    return rows.join(front, [*keys, a, b, c], "left_semi")


def weighted_pick(front: DataFrame, keys, first: str, second: str, tie="number", w1=0.6, w2=0.4) -> DataFrame:
    """The front member with the best weighted sum of min-max scaled objectives."""
    keys = list(keys)
    lim = front.groupBy(*keys).agg(
        F.min(first).alias("__lo1"), F.max(first).alias("__hi1"),
        F.min(second).alias("__lo2"), F.max(second).alias("__hi2"))

    def scaled(c, k):
        span = F.col(f"__hi{k}") - F.col(f"__lo{k}")
        return (F.col(c) - F.col(f"__lo{k}")) / F.when(span != 0, span).otherwise(1.0)

    scored = front.join(lim, keys).withColumn("score", F.lit(w1) * scaled(first, 1) + F.lit(w2) * scaled(second, 2))
    return best_per_key(scored.drop("__lo1", "__hi1", "__lo2", "__hi2"), keys, "score", tie)


def rank_candidates(cands: DataFrame, keys, at="entry_t", weight: Column | None = None) -> DataFrame:
    """Rank of competing candidates at one moment (at most one per symbol)."""
    s = F.col("strength") * (F.lit(1.0) if weight is None else weight)
    w = Window.partitionBy(*keys, at).orderBy(s.desc(), F.col("symbol"))
    return cands.withColumn("rank", F.row_number().over(w))
