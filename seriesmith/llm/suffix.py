"""Removal of byte strings that recur anywhere, by suffix sorting in two stages.

A string of ``width`` bytes is found where its window starts.  The corpus is cut so that equal
windows always meet, and few bytes travel:

1. Each window is named by the smallest hash of the grams in it, so equal windows have equal names.
   Windows of one name that start side by side form a segment.  Names that occur once are dropped.
2. Equal segments are counted, not compared.  What is left are different segments of one name,
   and periodic ones.
3. They are laid end to end, and the suffixes at their windows are sorted in two stages: those
   smaller than their successor directly, the others by scans over the buckets in order, in which
   each sorted suffix places the one before it.  Neighbours with ``width`` or more bytes in common
   are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, settled

WIDTH = 400
GRAM = 16
#: Windows of a segment, bytes sorted together, bytes of one name beyond which windows are told
#: apart by digest instead.
LONGEST, BLOCK, MOST = 8192, 1 << 18, 1 << 22
PIECE = 1 << 20


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Mixed hash of the ``size`` (a power of two) bytes from each position on."""
    h = data.astype(np.uint64) + np.uint64(1)
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < size:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        step *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by minima from both ends of fixed blocks."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def segments(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(name, first window, windows, periodic) of the segments of a text of up to 2**21 bytes.

    The gram that names a window is the leftmost of those with the smallest leading hash bits, so
    two equal windows of one segment are named by different places: without such, a segment is not
    ``periodic`` and none of its windows equals another of it."""
    grams = gram_hashes(np.frombuffer(data, np.uint8))
    places = np.uint64((1 << 21) - 1)
    least = sliding_min(grams & ~places | np.arange(len(grams), dtype=np.uint64), width - GRAM + 1) & places
    names = grams[least.astype(np.int64)]
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    count = np.diff(np.r_[first, len(names)])
    if count.max() > LONGEST:
        parts = -(-count // LONGEST)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(first + count, parts)
        first = np.repeat(first, parts) + inside * LONGEST
        count = np.minimum(end - first, LONGEST)
    return names[first].view(np.int64), first, count, least[first] != least[first + count - 1]


def runs(docs: DataFrame, width: int) -> DataFrame:
    """``h`` (name), ``s1, s2`` (digest of the segment), ``t1, t2`` (digest of the text), ``a``
    (first window), ``n`` (windows), ``p`` (periodic) of the segments of texts of ``width`` bytes or
    more."""
    schema = "h bigint, s1 bigint, s2 bigint, t1 bigint, t2 bigint, a bigint, n bigint, p bigint"

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            for texts in np.array_split(b["text"].to_numpy(object), max(1, len(b) // 500)):
                out = []
                for text in texts:
                    data = (text or "").encode("utf-8", "surrogatepass")
                    if len(data) < width:
                        continue
                    key = np.frombuffer(text_key(data), ">i8")
                    for s in range(0, len(data) - width + 1, PIECE):
                        piece = data[s:s + PIECE + width - 1]
                        name, first, count, periodic = segments(piece, width)
                        view = memoryview(piece)
                        seg = b"".join([digest(view[i:i + n + width - 1]) for i, n in zip(first.tolist(), count.tolist())])
                        out.append(np.column_stack([name, np.frombuffer(seg, np.int64).reshape(-1, 2),
                                                    np.broadcast_to(key, (len(name), 2)), first + s, count, periodic]))
                if out:
                    yield pd.DataFrame(np.concatenate(out).astype(np.int64), columns=["h", "s1", "s2", "t1", "t2", "a", "n", "p"])

    return docs.select("text").mapInPandas(run, schema)


def text_key(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def key_columns(text):
    """The two halves of ``text_key`` as bigints."""
    hex_ = F.sha2(text.cast("binary"), 256)
    half = lambda at: F.conv(F.substring(hex_, at, 16), 16, -10).cast("bigint")
    return half(1), half(17)


def eights(data: np.ndarray, beyond: int) -> np.ndarray:
    """The eight bytes from each position on as one number that sorts like them, 0 past the end."""
    n = len(data) + beyond
    padded = np.concatenate([data, np.zeros(beyond + 8, np.uint8)])
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | padded[j:j + n]
    return out


def direct_order(text: bytes, keys: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Positions sorted by their ``width`` bytes: by 24 of them, then ties by all."""
    at = at[np.lexsort((keys[at + 16], keys[at + 8], keys[at]))]
    tie = (keys[at[1:]] == keys[at[:-1]]) & (keys[at[1:] + 8] == keys[at[:-1] + 8]) & (keys[at[1:] + 16] == keys[at[:-1] + 16])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], tie.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist()):
        at[a:b] = sorted(at[a:b].tolist(), key=lambda p: text[p:p + width])
    return at


def suffix_order(data: np.ndarray, starts: np.ndarray, width: int, keys: np.ndarray | None = None) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``data``, as far as ``width`` bytes tell.

    Positions of ``data`` that are 0 separate segments; the last one must be 0."""
    n = len(data)
    # B: a suffix smaller than its successor; equal bytes take the kind of what follows the run
    rise = data[:-1] < data[1:]
    other = np.flatnonzero(data[:-1] != data[1:])
    following = other[np.minimum(np.searchsorted(other, np.arange(n - 1)), len(other) - 1)] if len(other) else np.zeros(n - 1, int)
    is_b = np.r_[rise[following] if len(other) else np.zeros(n - 1, bool), True]
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    # an A suffix is placed by its successor, so what follows up to the next B takes part
    next_b = np.flatnonzero(is_b)
    until = next_b[np.searchsorted(next_b, starts)]
    span = np.bincount(starts, minlength=n + 1)[:n + 1] - np.bincount(until + 1, minlength=n + 1)[:n + 1]
    part = np.cumsum(span)[:n] > 0
    keys = eights(data, width + 24) if keys is None else keys
    direct = direct_order(data.tobytes(), keys, np.flatnonzero(part & is_b), width)
    part_a = part & ~is_b
    ready: dict[int, list[np.ndarray]] = {}
    heads = data[direct]
    order = []
    for c in range(256):
        waiting = ready.pop(c, [])
        level = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)
        bucket = [level]
        while len(level):  # suffixes that start with a run of c place each other
            before = level[level > 0] - 1
            level = before[part_a[before] & (data[before] == c)]
            bucket.append(level)
        bucket.append(direct[heads == c])
        done = np.concatenate(bucket)
        if not len(done):
            continue
        order.append(done)
        before = done[done > 0] - 1
        before = before[part_a[before] & (data[before] > c)]
        if len(before):
            by = data[before]
            at = np.argsort(by, kind="stable")
            edges = np.flatnonzero(np.r_[True, by[at][1:] != by[at][:-1]])
            for piece in np.split(before[at], edges[1:]):
                ready.setdefault(int(data[piece[0]]), []).append(piece)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return order[wanted[order]]


def repeated(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Those of ``starts`` whose ``width`` bytes also start at another of them."""
    keys = eights(data, width + 24)
    order = suffix_order(data, starts, width, keys)
    if len(order) < 2:
        return order[:0]
    p, q = order[:-1], order[1:]
    same = np.arange(len(p))
    for at in (width - 8, *range(0, width - 8, 8)):  # common prefix of neighbours, by eight bytes
        same = same[keys[p[same] + at] == keys[q[same] + at]]
    hit = np.zeros(len(order), bool)
    hit[same] = hit[same + 1] = True
    return order[hit]


def ranges(x: np.ndarray) -> list[tuple[int, int]]:
    """Sorted whole numbers as half-open ranges."""
    if not len(x):
        return []
    edge = np.flatnonzero(np.diff(x) > 1)
    return list(zip(x[np.r_[0, edge + 1]].tolist(), (x[np.r_[edge, len(x) - 1]] + 1).tolist()))


FOUND = "h bigint, s1 bigint, s2 bigint, found array<struct<a:bigint,b:bigint>>"


def sort_blocks(width: int):
    """Over rows ``h, s1, s2, n, data`` sorted by ``h``: ``FOUND`` rows of windows that recur."""

    def solve(rows):
        raw = b"".join([r[4] + b"\x00\x00" for r in rows])
        # NUL separates; a NUL of the text itself becomes part of a window like any byte
        data = np.frombuffer(raw, np.uint8)
        at = np.cumsum([0] + [len(r[4]) + 2 for r in rows])
        starts = np.concatenate([np.arange(s, s + r[3]) for s, r in zip(at, rows)])
        hit = np.sort(repeated(data, starts, width))
        cuts = np.searchsorted(hit, at)
        out = [(r[0], r[1], r[2], [{"a": a, "b": b} for a, b in ranges(hit[i:j] - s)])
               for r, s, i, j in zip(rows, at, cuts[:-1], cuts[1:]) if j > i]
        return pd.DataFrame(out, columns=["h", "s1", "s2", "found"])

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for r in zip(b["h"], b["s1"], b["s2"], b["n"], b["data"]):
                if size > BLOCK and r[0] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
                last = r[0]
        if rows:
            yield solve(rows)

    return run


def cut_out(width: int):
    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, lists in zip(b["doc_id"], b["text"], b["found"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for a, e in sorted((r["a"], r["b"]) for r in (lists if lists is not None else ())):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e + width - 1)
                    else:
                        spans.append([a, e + width - 1])
                edges = [0, *[x for s in spans for x in s], len(data)]
                kept = b"".join([data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)])
                out.append((doc_id, len(data), len(data) - len(kept), len(spans), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary: the bytes that remain) per row.

    Every byte goes that is covered by a string of ``width`` bytes (at least ``GRAM``) that also
    starts elsewhere in the corpus, the same text included; strings are judged on the input.
    Repeated rows repeat each other.  Null counts as empty; texts shorter than ``width`` stay
    whole; an empty table gives an empty result; other columns are not read.

    Names and segments are aggregated before they are shuffled.  A name whose different segments
    exceed ``MOST`` bytes is not sorted in one task: its windows are told apart by 128-bit digests
    that are counted across all tasks."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    t1, t2 = key_columns(F.col("text"))
    seg, text = ["h", "s1", "s2"], ["t1", "t2"]
    found = settled(runs(rows, width))
    often = found.groupBy("h").agg(F.count("*").alias("c"), F.max("p").alias("p")).where("c > 1 or p > 0").select("h")
    found = settled(found.join(often, "h"))
    # copies of a text are one row from here on
    found = settled(found.groupBy(*seg, *text, "a", "n", "p").agg(F.count("*").alias("m")))
    segs = found.groupBy(*seg).agg(F.sum("m").alias("c"), F.max("p").alias("p"), F.min(F.struct("t1", "t2", "a", "n")).alias("at"))
    segs = settled(segs.select(*seg, "c", "p", "at.*"))
    names = segs.groupBy("h").agg(F.count("*").alias("k"), F.sum(F.col("n") + width - 1).alias("bytes"),
                                  F.max("p").alias("periodic")).where("k > 1 or periodic > 0").drop("periodic")
    unlike = settled(segs.join(names, "h").select(*seg, "n", "bytes", "t1", "t2", "a"))
    everywhere = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b")))
    copied = segs.where("c > 1").select(*seg, everywhere.alias("found"))
    # bytes of the unlike segments, from one text that holds each
    wanted = unlike.groupBy(*text).agg(F.collect_list(F.struct(*seg, "n", "a", "bytes")).alias("list"))
    keyed = rows.where(F.octet_length("text") >= width).withColumn("t1", t1).withColumn("t2", t2)
    owner = keyed.groupBy(*text).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("owner"))
    wanted = wanted.join(owner.select(*text, F.col("owner.doc_id").alias("owner")), text)
    held = lookup(keyed, wanted, text, how="inner").where(F.col("doc_id").eqNullSafe(F.col("owner")))
    held = held.select(F.explode("list").alias("x"), F.col("text").cast("binary").alias("text"))
    held = held.select("x.*", "text").select(
        *seg, "n", "bytes", F.expr(f"substring(text, cast(a + 1 as int), cast(n + {width - 1} as int))").alias("data"))
    held = settled(held.dropDuplicates(seg))
    few = held.where(F.col("bytes") <= MOST).repartition("h").sortWithinPartitions("h", "s1", "s2")
    sorted_ = few.select(*seg, "n", "data").mapInPandas(sort_blocks(width), FOUND)

    def digests(batches, with_place=True):
        import xxhash

        for b in batches:
            for h, s1, s2, n, data in zip(b["h"], b["s1"], b["s2"], b["n"], b["data"]):
                view = memoryview(data)
                w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i:i + width]) for i in range(n)]), np.int64).reshape(-1, 2)
                place = {"h": h, "s1": s1, "s2": s2, "a": np.arange(n)} if with_place else {}
                yield pd.DataFrame(place | {"w1": w[:, 0], "w2": w[:, 1]})

    def in_ranges(batches):
        for b in batches:
            yield b.assign(found=[[{"a": i, "b": j} for i, j in ranges(np.sort(x))] for x in b["found"]])

    # only digests are shuffled to be counted; places are kept of those that recur
    many = held.where(F.col("bytes") > MOST).select(*seg, "n", "data")
    twice = many.mapInPandas(lambda b: digests(b, False), "w1 bigint, w2 bigint").groupBy("w1", "w2") \
        .agg(F.count("*").alias("c")).where("c > 1").drop("c")
    told = lookup(many.mapInPandas(digests, "h bigint, s1 bigint, s2 bigint, a bigint, w1 bigint, w2 bigint"),
                  twice, ["w1", "w2"], how="inner")
    told = told.groupBy(*seg).agg(F.collect_list("a").alias("found")).mapInPandas(in_ranges, FOUND)
    # back to the texts: one list of windows for each different text
    marks = found.join(copied.union(sorted_).union(told), seg).select(*text, "a", F.explode("found").alias("f"))
    marks = marks.select(*text, F.struct((F.col("a") + F.col("f.a")).alias("a"), (F.col("a") + F.col("f.b")).alias("b")).alias("r"))
    marks = marks.groupBy(*text).agg(F.collect_set("r").alias("found"))
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                        T.StructField("kept", T.BinaryType())])
    joined = lookup(rows.withColumn("t1", t1).withColumn("t2", t2), marks, text)
    return joined.select("doc_id", "text", "found").mapInPandas(cut_out(width), out)
