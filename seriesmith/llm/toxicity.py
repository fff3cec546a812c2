"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

P(grade <= j) = logistic(threshold_j - w . x): all ordered thresholds share the weights ``w``.
x holds, for the terms that the fit selected, log2(1 + count) of words and log2(1 + percent of
the words) of word beginnings (inflected and compound forms of one stem).  The score of a text is
its expected severity, the sum over j of P(grade > j).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = re.compile(r"[^\W\d_]+")
#: Labelled rows the fit looks at, at most (those with the smallest hash of their id).
FIT_ROWS = 12_000
#: Words the model keeps, at most; with ``FIT_ROWS`` this bounds what is sent to the executors.
FEATURES = 512
GRADES = 4
#: Standard score from which a term's tie to the label counts (chosen on held-out rows, where 3.5 to
#: 6 did alike with thousands of labels and 3.5 did best with hundreds).
SURE = 3.5
#: Toxic texts of the sample that a term needs.
LEAST = 3


#: Lengths of word beginnings that are terms; a beginning is written with a trailing hyphen.
STEMS = (5, 6, 7)


def terms(counts: dict[str, int], wanted=None) -> dict[str, float]:
    """Feature values by term of a text given as word counts; with ``wanted``, of these terms."""
    total = sum(counts.values())
    words: dict[str, float] = {}
    stems: dict[str, int] = {}
    for w, n in counts.items():
        if wanted is None or w in wanted:
            words[w] = n
        for size in STEMS:
            if len(w) >= size:
                stem = w[:size] + "-"
                if wanted is None or stem in wanted:
                    stems[stem] = stems.get(stem, 0) + n
    out = {w: math.log2(1.0 + n) for w, n in words.items()}
    out.update((s, math.log2(1.0 + 100.0 * n / (total + 20.0))) for s, n in stems.items())
    return out


@dataclass
class Model:
    """Weights by term and the ordered thresholds between grades; no thresholds: all is clean."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def severity(self, text: str | None) -> float:
        if not self.thresholds:
            return 0.0
        found = terms(Counter(WORDS.findall((text or "").lower())), self.weights)
        eta = sum(self.weights[t] * x for t, x in sorted(found.items()))
        return sum(1.0 / (1.0 + math.exp(min(500.0, max(-500.0, t - eta)))) for t in self.thresholds)


def sketch(words, size: int = 16) -> list[int]:
    """The smallest hashes of the long words: edited copies of a text still share most of them,
    other texts hardly any."""
    import xxhash

    return sorted(xxhash.xxh64_intdigest(w) >> 1 for w in set(words) if len(w) >= 7)[:size]


def sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> pd.DataFrame:
    """Words with counts, and a sketch, of at most ``rows`` labelled texts, ordered by id."""
    graded = "grade" in labels.columns
    label = F.max(F.col("grade") if graded else F.col("toxic")).cast("int")
    chosen = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(label.alias("label"))
              .where(F.col("label").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    def run(batches):
        for b in batches:
            out = []
            for i, text, label in zip(b["doc_id"], b["text"], b["label"]):
                words = WORDS.findall((text or "").lower())
                counts = Counter(words)
                out.append((i, label, " ".join(counts), list(counts.values()), sketch(words)))
            yield pd.DataFrame(out, columns=["doc_id", "label", "words", "counts", "sketch"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the chosen rows are at most ``rows`` ids and labels, so they may be broadcast; of the rows of an id
    # that recurs the text with the smallest digest is read, so the driver gets one row an id
    one = F.min(F.struct(F.md5("text").alias("digest"), "text"))["text"].alias("text")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one, F.max("label").alias("label")).mapInPandas(
        run, "doc_id bigint, label int, words string, counts array<int>, sketch array<bigint>")
    return found.toArrow().to_pandas().sort_values(["doc_id", "words"], ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        rows: int = FIT_ROWS, features: int = FEATURES, grades: int = GRADES) -> Model:
    """Fit on at most ``rows`` labelled rows.

    ``labels`` has ``doc_id`` and either ``grade`` (0, 1, ...) or ``toxic`` (0/1).  With ``toxic``
    only, the grades above 0 are the labelled texts in equal shares by how often they use words
    that stand almost only in texts labelled toxic.  Near copies in the sample count once, so that
    one mislabelled text that was copied teaches nothing.  Several labels of an id: the highest.
    Of several rows of an id one is read.
    No labels, or only one grade, give a model that finds nothing."""
    data = sample(docs, labels, rows, id_col, text_col)
    seen: dict[int, list[int]] = {}
    keep = []
    for n, hashes in enumerate(data["sketch"]):
        shared = Counter(m for h in hashes for m in seen.get(int(h), ()))
        if shared and max(shared.values()) * 3 >= max(3, len(hashes)):
            continue
        keep.append(n)
        for h in hashes:
            seen.setdefault(int(h), []).append(n)
    data = data.iloc[keep]
    label = data["label"].to_numpy(np.int64)

    def bag(n: int, wanted=None) -> dict[str, float]:  # made anew each time: all at once are large
        words = data["words"].iat[n]
        return terms(dict(zip(words.split(" "), map(int, data["counts"].iat[n]))) if words else {}, wanted)

    toxic = label > 0
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return Model()
    df1, df0 = Counter(), Counter()
    for n in np.flatnonzero(toxic):
        df1.update(bag(n).keys())
    df1 = Counter({t: n for t, n in df1.items() if n >= LEAST})
    for n in np.flatnonzero(~toxic):
        df0.update(bag(n, df1).keys())
    share = n1 / (n1 + n0)

    def evidence(t):  # standard score of the toxic share among the texts that hold the term
        n = df1[t] + df0[t]
        return (df1[t] - n * share) / math.sqrt(n * share * (1 - share))

    scored = sorted(((-evidence(t), t) for t in df1))
    names = [t for z, t in scored if -z >= SURE][:features]
    at = {t: i for i, t in enumerate(names)}
    x = np.zeros((len(data), len(names)))
    for n in range(len(data)):
        for t, value in bag(n, at).items():
            x[n, at[t]] = value
    if "grade" not in labels.columns:
        strong = [at[t] for t in names if df1[t] >= 9 * df0[t]]
        hits = x[:, strong].sum(axis=1)
        found = hits[toxic & (hits > 0)]
        levels = np.quantile(found, np.arange(1, grades - 1) / (grades - 1)) if len(found) else []
        label = np.where(toxic, 1 + np.searchsorted(levels, hits, "left"), 0)
    label = np.unique(label, return_inverse=True)[1]
    w, theta = cumulative_link(x, label)
    return Model(dict(zip(names, w.tolist())), theta.tolist())


def cumulative_link(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> tuple:
    """Weights and ordered thresholds of greatest likelihood with a small ridge, by Adam.

    Thresholds are the first one plus exponentials, which keeps them in order."""
    n, p = x.shape
    k = int(y.max())
    upto = np.array([(y <= j).mean() for j in range(k)]).clip(1e-6, 1 - 1e-6)
    theta = np.log(upto / (1 - upto))
    params = np.r_[np.zeros(p), theta[:1], np.log(np.diff(theta).clip(1e-3))]
    mean, var = np.zeros_like(params), np.zeros_like(params)

    def thresholds(q):
        return q[0] + np.r_[0.0, np.cumsum(np.exp(q[1:]))]

    for step in range(1, steps + 1):
        w, theta = params[:p], thresholds(params[p:])
        eta = x @ w
        edges = np.r_[-np.inf, theta, np.inf]
        a = 1 / (1 + np.exp(-np.clip(edges[y + 1] - eta, -40, 40)))
        b = 1 / (1 + np.exp(-np.clip(edges[y] - eta, -40, 40)))
        a, b = np.where(y == k, 1.0, a), np.where(y == 0, 0.0, b)
        prob = np.maximum(a - b, 1e-12)
        d_eta = 1 - a - b  # of the negative log likelihood
        up, down = -a * (1 - a) / prob, b * (1 - b) / prob
        d_theta = np.array([up[y == j].sum() + down[y == j + 1].sum() for j in range(k)])
        tail = np.cumsum(d_theta[::-1])[::-1]
        d_params = np.r_[x.T @ d_eta / n + ridge * w, tail[0] / n, tail[1:] / n * np.exp(params[p + 1:])]
        mean = 0.9 * mean + 0.1 * d_params
        var = 0.999 * var + 0.001 * d_params ** 2
        rate = 0.1 * (1 - step / (steps + 1))
        params = params - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.999 ** step)) + 1e-8)
    return params[:p], thresholds(params[p:])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``severity`` (expected grade), ``grade`` (rounded) and ``toxic``
    (severity at least ``threshold``); columns of these names are replaced.

    Whole texts are read, null counts as empty; rows are independent and nothing is shuffled."""
    added = {"severity": T.DoubleType(), "grade": T.LongType(), "toxic": T.BooleanType()}

    @F.pandas_udf("double")
    def severity(texts: pd.Series) -> pd.Series:
        return pd.Series([model.severity(t) for t in texts], dtype="float64")

    out = docs.drop(*added).withColumn("severity", severity(F.col(text_col)))
    return out.withColumn("grade", F.round("severity").cast("bigint")) \
        .withColumn("toxic", F.col("severity") >= F.lit(threshold))
