"""Best-fit packing planned over the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens in one pass over the texts.  How many pieces
there are of each length (at most ``capacity`` numbers) is all that planning needs: lengths are
taken from the longest down, and a length's pieces go, all at once, to the sequences with the
least room that still holds one.  Sequences with the same room are one run of consecutive numbers,
so the plan is a list of runs: "the pieces of this length with ranks from a to b lie in the
sequences from s on, so many in each, from this offset on".

The plan's size does not depend on the number of documents.  A length splits at most one run and
opens at most two, so there are at most 3 x capacity runs; a run is filled by at most one slot a
length and by sequences of lengths that differ, whose sum is at most the capacity.  For 1,024 that
is under 3,072 runs x 45 lengths, or 138,240 slots of five numbers (5.5 MB).

Pieces then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_names
from .common import lookup, settled

#: Pieces of a length that are ranked together; a length with more is dealt over several groups.
RANKED = 50_000
#: Longest result batch of a task, in pieces.
SLICE = 1 << 15


class Ids:
    """Token ids of whole texts by the vocabulary file at ``path`` (byte-level BPE in the format of
    the ``tokenizers`` library), special tokens in a text recognised, none added.

    The file's ids are the ranks of its merges, so the faster ``tiktoken`` merges by the same
    ranks; the tests hold its ids against the other library's on every kind of character."""

    #: How byte-level BPE splits a text before merging (fixed value of the format).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        names = byte_names()
        ranks = {bytes(names[c] for c in s): i for s, i in model["model"]["vocab"].items() if all(c in names for c in s)}
        special = {a["content"]: a["id"] for a in model["added_tokens"]}
        self.coder = tiktoken.Encoding("packing", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, allowed_special="all")


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One coder a worker process."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole sequences, what is over comes first."""
    over = n % capacity
    starts = ([0] if over else []) + list(range(over, n, capacity))
    return [(s, over if over and not s else capacity) for s in starts]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit of ``counts[length]`` pieces, longest first: (length, first rank, first sequence,
    pieces in each sequence, offset of the first), by length and rank.

    All pieces of a length go into the open sequences with the least room that holds one, each
    filled with as many as fit before the next is taken, as best fit does one piece at a time."""
    slots, opened = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
    rooms: list[int] = []

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                insort(rooms, space)
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                space = rooms[at]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], rooms[at]
            else:  # new sequences for all that is left
                space, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = space // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, first, each, capacity - space))
                leave(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # one sequence takes what is left
                slots.append((length, rank, first + full, left, capacity - space))
                leave(space - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            leave(space, first + full, n - full)
    return sorted(slots)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of all documents; ids are not kept."""

    def run(batches):
        ids, end = ids_of(path), np.array([end_id], "<u4")
        out: list[list] = [[], [], [], [], []]
        kind = None

        def table():
            return pa.record_batch([pa.array(out[0], kind), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:]]],
                                   names=["doc_id", "piece", "start", "length", "ids_crc32"])

        for batch in batches:
            kind = batch["doc_id"].type
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                all_ids = np.concatenate([ids(text.as_py() or "").astype("<u4"), end])
                for k, (s, n) in enumerate(cuts(len(all_ids), capacity)):
                    for column, value in zip(out, (doc, k, s, n, zlib.crc32(all_ids[s:s + n].tobytes()))):
                        column.append(value)
                if len(out[0]) >= SLICE:
                    yield table()
                    out = [[], [], [], [], []]
        if out[0]:
            yield table()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
         text_col: str = "text", ranked: int = RANKED) -> DataFrame:
    """Pack every whole text, encoded with the vocabulary at ``path`` and closed by ``end_id``, into
    few sequences of at most ``capacity`` tokens.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  Only
    documents longer than a sequence are cut; the first piece holds what is over.  Sequences are
    numbered from 0, their pieces follow each other without a gap.

    A null text counts as empty: one piece, the end id.  Repeated rows are documents each; rows
    that are equal in all columns may swap their slots between runs, which gives the same rows.  A
    null id stays null.  Other columns are not read, so their names do not matter; an empty table
    gives an empty result.

    Texts are encoded once; the pieces are written to the shared folder.  Ranks within a length
    are found in groups of about ``ranked`` pieces, told apart by a hash, so a length that
    holds most pieces makes no large group; the first rank of each group comes from group counts."""
    spark = docs.sparkSession
    rows = settled(pieces(docs, path, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    slots = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    parts = F.array(*[F.lit(-(-counts.get(n, 1) // ranked)) for n in range(1, capacity + 1)])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(parts, F.col("length").cast("int"))))

    groups = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranks = lookup(rows.withColumn("inside", F.row_number().over(inside)), first, ["length", "part"], how="inner")
    ranks = ranks.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("inside") - 1).alias("rank"))

    sent = spark.sparkContext.broadcast(slots)

    def place(batches):
        s = sent.value
        # one ascending key for (length, rank): ranks of a length follow those of shorter lengths
        begin = {int(n): i for n, i in zip(*np.unique(s[:, 0], return_index=True))} if len(s) else {}
        end = {n: i + int(np.sum(s[:, 0] == n)) for n, i in begin.items()}
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            at = np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                of = length == n
                lo, hi = begin[n], end[n]
                at[of] = lo + np.searchsorted(s[lo:hi, 1], rank[of], "right") - 1
            slot = s[at]
            over = rank - slot[:, 1]
            made = {"sequence_id": slot[:, 2] + over // slot[:, 3], "offset": slot[:, 4] + over % slot[:, 3] * length}
            yield pa.record_batch([*b.drop_columns(["rank"]).columns, *map(pa.array, made.values())],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", *made])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = ranks.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("doc_id", id_col)
