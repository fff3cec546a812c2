"""SimHash fingerprints and near duplicates by a hierarchical index in Gray order.

Fingerprints that differ in at most ``k`` of 64 bits agree fully in ``blocks - k`` of ``blocks``
parts.  For each choice of such parts the bits are permuted so that these come first; the rows of
one leading value form a group.  In a group the fingerprints are sorted by Gray rank, in which
neighbours differ in few bits, and a tree is built over the sorted list: every node keeps the bits
that all fingerprints below it share.  A search descends with the number of differences in shared
bits so far, adds at each child only the bits that its parent did not share, and drops a whole
node when the sum exceeds ``k``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import components

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows of a group that one task compares at most; larger groups are split in pairs of parts.
GROUP_ROWS = 4096
FAN = 16


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text (see ``fingerprints``)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends.tolist()[width - 1:] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n], last)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        bits = np.unpackbits(h[i:i + 8192].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a bigint) for each row.

    A-Z are lowered, words are runs of non-blanks, a text with fewer than ``width`` words is one
    shingle; a text without words, or null, has fingerprint 0.  A bit is set if it is set in over
    half of the shingles' XXH64 values (seed 42), repeats counted."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint_of(t, width) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(object), "fp": fp})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def orders(k: int, blocks: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Per choice of equal blocks: (low bit, width) of the blocks in their new order, and the
    number of leading bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    out = []
    for lead in itertools.combinations(range(blocks), blocks - k):
        rest = [i for i in range(blocks) if i not in lead]
        out.append(([parts[i] for i in (*lead, *rest)], sum(parts[i][1] for i in lead)))
    return out


def permuted(fp, layout: list[tuple[int, int]]):
    """Column of the bits of ``fp`` with the given blocks moved to the top, in order."""
    out, at = F.lit(0).cast("bigint"), 64
    for low, width in layout:
        at -= width
        piece = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        out = out.bitwiseOR(F.shiftleft(piece, at))
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def bits_set(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class GrayTree:
    """Levels of nodes over fingerprints that lie group by group in Gray order.

    ``levels[0]`` are the fingerprints; a node of level n+1 covers up to ``FAN`` neighbours of
    level n of the same group and keeps ``mask`` (bits shared by all below) and ``value``."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        mask, value = np.full(len(fp), ONES), fp
        self.levels = [(mask, value, None, None)]
        while True:
            change = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
            sizes = np.diff(np.r_[change, len(group)])
            if len(sizes) == 0 or sizes.max() <= 1:
                break
            within = np.arange(len(group)) - np.repeat(change, sizes)
            first = np.flatnonzero(within % FAN == 0)
            count = np.diff(np.r_[first, len(group)])
            head = np.repeat(value[first], count)
            new = np.bitwise_and.reduceat(mask & ~(value ^ head), first)
            mask, value, group = new, value[first] & new, group[first]
            self.levels.append((mask, value, first, count))
        self.root_of = group

    def pairs(self, k: int, groups: np.ndarray, fp: np.ndarray, most: int = 1 << 20) -> Iterator[tuple]:
        """Positions (i, j), i < j, of the same group with at most ``k`` differing bits."""
        roots = np.searchsorted(self.root_of, groups)
        top = len(self.levels) - 1
        for s in range(0, len(fp), 32768):
            i = np.arange(s, min(s + 32768, len(fp)))
            node = roots[i]
            m, v = self.levels[top][0][node], self.levels[top][1][node]
            stack = [(top, i, node, bits_set((fp[i] ^ v) & m))]
            while stack:
                level, i, node, far = stack.pop()
                keep = far <= k
                i, node, far = i[keep], node[keep], far[keep]
                if level == 0:
                    keep = i < node
                    if keep.any():
                        yield i[keep], node[keep]
                    continue
                if not len(i):
                    continue
                mask, value, first, count = self.levels[level]
                n = count[node]
                total = np.cumsum(n)
                start = 0
                while start < len(i):  # a slice whose children fit
                    base = total[start - 1] if start else 0
                    end = max(start + 1, int(np.searchsorted(total, base + most, "right")))
                    q, p, f, c = i[start:end], node[start:end], far[start:end], n[start:end]
                    rep = np.repeat(np.arange(len(q)), c)
                    child = np.repeat(first[p] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                    below, own = self.levels[level - 1][0], self.levels[level - 1][1]
                    extra = below[child] & ~mask[p][rep]
                    reach = f[rep] + bits_set((fp[q][rep] ^ own[child]) & extra)
                    stack.append((level - 1, q[rep], child, reach))
                    start = end


def forest(n: int, pairs: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, root) that connect what the pairs connect, at most one for each position."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            hi, lo = np.maximum(ra[open_], rb[open_]), np.minimum(ra[open_], rb[open_])
            np.minimum.at(root, hi, lo)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def links(fps: DataFrame, k: int = 3, blocks: int = 5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that connect all pairs with at
    most ``k`` differing bits; of the pairs found in one group a spanning forest is returned.

    A group of more than ``group_rows`` rows is dealt into parts by hash, and each pair of parts
    is searched by a task of its own, so no task holds more than about twice that many rows."""
    cases = [F.struct(F.lit(n).alias("o"), permuted(F.col("fp"), layout).alias("p"),
                      F.shiftrightunsigned(permuted(F.col("fp"), layout), 64 - lead).alias("lead"))
             for n, (layout, lead) in enumerate(orders(k, blocks))]
    rows = fps.select("fp", F.explode(F.array(*cases)).alias("c")).select("fp", "c.o", "c.lead", "c.p")
    sizes = rows.groupBy("o", "lead").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["o", "lead"])
    parts = F.ceil(F.col("n") / group_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pair = F.struct(F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"))
    rows = (rows.withColumn("parts", parts).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("pair", pair)
            .select("o", "lead", "pair.s", "pair.t", "p", "fp"))
    rows = rows.repartition("o", "lead", "s", "t").sortWithinPartitions("o", "lead", "s", "t")
    keys = ["o", "lead", "s", "t"]

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows["p"].to_numpy(np.int64).view(np.uint64)
        change = np.zeros(len(rows), bool)
        for c in keys:
            v = rows[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        group = np.cumsum(change)
        at = np.lexsort((gray_rank(p), group))
        p, group, fp = p[at], group[at], rows["fp"].to_numpy(np.int64)[at]
        i, j = forest(len(p), GrayTree(p, group).pairs(k, group, p))
        return pd.DataFrame({"a": fp[i], "b": fp[j]})

    def run(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(held):
                continue
            tail = held[keys].iloc[-1]
            same = np.ones(len(held), bool)
            for c in keys:
                same &= held[c].to_numpy() == tail[c]
            done = len(held) - int(same.sum())  # rows are sorted: the last group may go on
            if done:
                yield found(held.iloc[:done])
                held = held.iloc[done:].reset_index(drop=True)
        if held is not None and len(held):
            yield found(held)

    return rows.mapInPandas(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    k: int = 3, blocks: int = 5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``.

    Fingerprints link at ``k`` or fewer differing bits; ``component_id`` is the smallest id that
    can be reached over links, the row's own included.  Equal fingerprints are one node, so copies
    cost one row each.  Repeated rows give repeated rows.  Rows with a null id belong to their
    group, and have a null component only if no row of it has an id.  Null and empty texts have
    fingerprint 0 and link like others.  An empty table gives an empty result; other columns are
    not read."""
    fps = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(nodes.select("fp"), k, blocks, group_rows), "a", "b")
    member = nodes.join(joined, F.col("fp") == F.col("node"), "left") \
        .select("fp", "least", F.coalesce("component", "fp").alias("component"))
    member = cut(member)
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    of = member.join(least, "component").select("fp", "component_id")
    out = fps.join(of, "fp").select("doc_id", "fp", "component_id")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
