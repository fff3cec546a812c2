"""Spelling variants by FM-index search schemes over the vocabulary.

Two words are near if one inserted, deleted or replaced code point turns one into the other.  The
error lies in one half of the shorter word, so the other half occurs unchanged at the same end of
both.  An FM-index holds the delimited words ``$w1$w2$...$`` and another the reversed words: one
extends a pattern to the left, the other to the right, each step turning an interval of suffix
ranks into that of the longer pattern.  A search starts at the delimiter at the end of the half
without an error, takes this half exactly, crosses the other half allowing one error and ends at the
other delimiter, where the rank of the whole delimited word is its place in the sorted vocabulary.
As both schemes start at an end of the word they go one way each, so only the interval of that
way has to be kept.

The vocabulary is dealt over many indexes.  Words meet by a key, the part that a search takes
exactly: (prefix, suffix) with the error between them.  At first that is (first half, "") and ("",
second half).  A key with more than ``MOST`` words is split by the same argument: the error lies in
the first or in the second half of what is between, so the key grows by the other one.  Two words
that are near meet at exactly one key, and a key that leaves one code point open holds few words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Runs of letters (fixed pattern of the contract).
RUN = "[A-Za-zÀ-ÿ]+"
#: Words of a key that go to one index; more are split.
MOST = 20_000
#: Words of an index, about.
INDEX = 40_000
#: Different words that a task counts before it hands the counts on.
COUNTED = 400_000
#: Searches that advance together.
TOGETHER = 1 << 13


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int, typo: int) -> DataFrame:
    """``word, n``: how often each word of ``least`` code points or more occurs in all texts, counted
    first inside tasks."""
    run = re.compile(RUN)

    def table(total):
        return pa.record_batch({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

    def count(batches):
        total: Counter[str] = Counter()
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                if not text.is_valid:
                    continue
                # only A-Z are lowered: bytes know no other case
                words = Counter(run.findall(text.as_buffer().to_pybytes().lower().decode("utf-8", "replace")))
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in words.items():
                    if len(w) < least:
                        continue
                    h = zlib.crc32(w.encode(), start)
                    if h % typo == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < least:
                            continue
                    total[w] += n
                if len(total) > COUNTED:
                    yield table(total)
                    total = Counter()
        if total:
            yield table(total)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """FM-index of delimited words; a step prepends a code point to the pattern."""

    def __init__(self, words: list[str]):
        order = sorted(words)  # by code point
        self.order = order
        text = np.frombuffer(("\0" + "\0".join(order) + "\0").encode("utf-32-le"), "<u4")
        self.letters, code = np.unique(text, return_inverse=True)  # 0 is the delimiter
        n = len(code)
        rank = self._ranks(code.astype(np.int64), len(self.letters))
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        self.before = code[suffixes - 1]  # the code point before each suffix, by rank
        self.n, self.size = n + 1, len(self.letters)
        # C[c] + rank of c up to i, for all c and i, is a place in this sorted list
        self.steps = np.sort(self.before.astype(np.int64) * self.n + np.arange(n))

    @staticmethod
    def _ranks(code: np.ndarray, size: int) -> np.ndarray:
        """Rank of each suffix, compared up to the delimiter after it, then by place: words are
        sorted, so that is the order of what follows.  Prefix doubling from as many code points as
        a 64-bit number holds."""
        n = len(code)
        here = np.arange(n)
        ends = np.flatnonzero(code == 0)
        left = ends[np.minimum(np.searchsorted(ends, here, "right"), len(ends) - 1)] - here + 1
        bits = int(size).bit_length()
        span, key = 62 // bits, code.copy()
        for j in range(1, span):
            key = (key << bits) | np.where(j < left, code[np.minimum(here + j, n - 1)], 0)
        while span < int(left.max()):
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            then = np.where(span < left, rank[np.minimum(here + span, n - 1)] + 1, 0)
            key = rank * (n + 1) + then
            span *= 2
        out = np.empty(n, np.int64)
        out[np.argsort(key, kind="stable")] = here
        return out

    def codes(self, letters: np.ndarray) -> np.ndarray:
        """Codes of code points; -1 for one that no word has."""
        at = np.minimum(np.searchsorted(self.letters, letters), self.size - 1)
        return np.where(self.letters[at] == letters, at, -1)

    def step(self, c, lo, hi):
        """The interval of c + pattern; empty for a code of -1."""
        at = c * self.n
        lo, hi = np.searchsorted(self.steps, at + lo), np.searchsorted(self.steps, at + hi)
        return lo, np.where(c < 0, lo, hi)

    def each(self, lo, hi):
        """(row, code, lo, hi): all steps from each interval that lead anywhere, but the delimiter."""
        wide = hi - lo > 2 * self.size
        found = []
        for some, full in ((np.flatnonzero(~wide), False), (np.flatnonzero(wide), True)):
            if full:
                rows, c = np.repeat(some, self.size - 1), np.tile(np.arange(1, self.size), len(some))
            else:
                width = (hi - lo)[some]
                rows = np.repeat(some, width)
                inside = np.arange(len(rows)) - np.repeat(np.cumsum(width) - width, width)
                pair = np.unique(rows * self.size + self.before[lo[rows] + inside])
                rows, c = pair // self.size, pair % self.size
                rows, c = rows[c > 0], c[c > 0]
            l2, h2 = self.step(c, lo[rows], hi[rows])
            some = l2 < h2
            found.append((rows[some], c[some], l2[some], h2[some]))
        return [np.concatenate(x) for x in zip(*found)]


def searched(index: Index, patterns: list[str], x: np.ndarray, y: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, place in the index's order): all words that come from a pattern by one code point
    replaced at, or inserted before, places ``x`` <= i < ``y`` (inserted at the end too, if ``y`` is the
    pattern's length).  A code point is inserted only before a different one, so each word comes once.

    ``index`` is of the reversed words to read patterns from their beginning, and of the words to
    read them ``backward``."""
    size = np.array([len(p) for p in patterns])
    begin = np.cumsum(size) - size
    flat = index.codes(np.frombuffer("".join(p[::-1] if backward else p for p in patterns).encode("utf-32-le"), "<u4"))
    if backward:  # places count from the end; what goes before place i is read after it
        replace, insert = (size - y, size - x - 1), (np.where(y == size, 0, size - y + 1), size - x)
    else:
        replace, insert = (x, y - 1), (x, np.where(y == size, size, y - 1))
    last = np.maximum(replace[1], insert[1])

    def code(p, i):
        """The code at place i of pattern p; the delimiter behind its end, nothing before its beginning."""
        found = flat[np.clip(begin[p] + i, 0, len(flat) - 1)]
        return np.where(i < 0, -1, np.where(i < size[p], found, 0))

    p = np.arange(len(patterns))
    none = np.zeros(len(p), np.int64)
    lo, hi = index.step(none, none, none + index.n - 1)
    wrong: list[np.ndarray] = [np.empty(0, np.int64)] * 4  # with an error: pattern, place, interval
    hits, at = [(wrong[0], wrong[0])], 0
    while len(p) or len(wrong[0]):
        here = (at >= np.minimum(replace[0], insert[0])[p]) & (at <= last[p])
        rows, c, l2, h2 = index.each(lo[here], hi[here])
        who = p[here][rows]
        for (low, high), step, beside in ((replace, 1, code(who, np.full(len(who), at))),
                                          (insert, 0, code(who, np.full(len(who), at - backward)))):
            some = (at >= low[who]) & (at <= high[who]) & (c != beside)
            made = who[some], np.full(int(some.sum()), at + step), l2[some], h2[some]
            wrong = [np.concatenate(v) for v in zip(wrong, made)]
        # one more code point, or the delimiter at the end
        q, i, l1, h1 = wrong
        l1, h1 = index.step(code(q, i), l1, h1)
        ended = (i == size[q]) & (l1 < h1)
        hits.append((q[ended], l1[ended] - 1))  # before all words comes the last delimiter
        going = (i < size[q]) & (l1 < h1)
        wrong = [q[going], i[going] + 1, l1[going], h1[going]]
        lo, hi = index.step(code(p, np.full(len(p), at)), lo, hi)
        going = (lo < hi) & (at < last[p])
        p, lo, hi = p[going], lo[going], hi[going]
        at += 1
    q, place = (np.concatenate(v) for v in zip(*hits))
    return q, place


def near_in(part: pd.DataFrame) -> pd.DataFrame:
    """``word, near, near_n`` for the near words of one index, both ways."""
    count = dict(zip(part["word"], part["n"]))
    backward = bool(part["bucket"].iloc[0] % 2)
    index = Index([w if backward else w[::-1] for w in count])
    order = np.array([w if backward else w[::-1] for w in index.order], object)
    asked = part[part["asks"]]
    word, near = [], []
    for s in range(0, len(asked), TOGETHER):
        now = asked.iloc[s:s + TOGETHER]
        words = now["word"].to_numpy(object)
        q, place = searched(index, words.tolist(), now["x"].to_numpy(np.int64), now["y"].to_numpy(np.int64), backward)
        for a, b in zip(words[q].tolist(), order[place].tolist()):
            word.append(a)
            near.append(b)
            if len(a) != len(b):  # words of the same length each find the other
                word.append(b)
                near.append(a)
    text = lambda values: pd.Series(values, dtype=object)
    return pd.DataFrame({"word": text(word), "near": text(near), "near_n": np.array([count[b] for b in near], np.int64)})


def keyed(rows: DataFrame) -> DataFrame:
    """``key``: what a search for a word of length ``m`` with its error in ``x`` <= i < ``y`` takes exactly."""
    return rows.withColumn("key", F.expr("concat(substring(word, 1, x), '\0', right(word, m - y))"))


def halves(rows: DataFrame) -> DataFrame:
    """Both parts of what is open in a row, each with the other one closed."""
    parts = F.expr("array(struct(x AS x, x + (y - x) div 2 AS y), struct(x + (y - x) div 2 AS x, y AS y))")
    return keyed(rows.withColumn("part", F.explode(parts)).select(
        "word", "n", "m", "asks", F.col("part.x").cast("int").alias("x"), F.col("part.y").cast("int").alias("y")))


def meeting(words: DataFrame, least: int, most: int) -> tuple[DataFrame, int]:
    """Rows (word, n, m, asks, x, y, key) and how many: a word asks with its own length and is there
    for words of its length and of one code point less.  Keys of more than ``most`` rows are
    split until they fit or leave one code point open."""
    lengths = F.expr(f"filter(array(struct(length(word) AS m, true AS asks), struct(length(word) - 1 AS m, false AS asks)), s -> s.m >= {least})")
    rows = words.withColumn("as", F.explode(lengths)).select("word", "n", "as.*")
    rows = halves(rows.withColumn("x", F.lit(0)).withColumn("y", F.col("m")))
    done, total = [], rows.count()
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("y") - F.col("x")).alias("open"))
        hot = settled(sizes.where((F.col("size") > most) & (F.col("open") > 1)).select("key", F.lit(True).alias("hot")))
        if hot.isEmpty():
            break
        split = F.coalesce("hot", F.lit(False)) & (F.col("y") - F.col("x") > 1)
        rows = rows.join(hot, "key", "left")
        done.append(rows.where(~split).drop("hot"))
        rows = settled(halves(rows.where(split)))
        total += rows.count()
    for d in done:
        rows = rows.unionByName(d)
    return rows, total


def last_of(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form, n``: the word at the end of the chain of forms.

    Occurrences rise at least twofold along a chain, so doubling the steps ends after as many rounds
    as there are bits in the bits of the largest count."""
    top = forms.agg(F.max("n")).first()[0] or 0
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(int(top).bit_length().bit_length()):
        ahead = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = settled(out.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return out


def group(docs: DataFrame, least: int = 7, often: int = 2, typo: int = 31, times: int = 10, id_col: str = "doc_id",
          text_col: str = "text", most: int = MOST, index: int = INDEX) -> DataFrame:
    """Spelling variants among the words of all whole texts.

    Words are runs of letters with only A-Z lowered; a run whose crc32 with its document's id is
    divisible by ``typo`` loses one code point.  Words of ``least`` code points and ``often``
    occurrences stay.  Returns ``word, form, root, n, n_near, form_n``: occurrences, near words, the
    near word with most occurrences (of those the smallest) if it has at least ``times`` (two or
    more) as many, and the end of the chain of forms, the word itself without one.

    A null text has no words; a null id counts as the empty string in the checksum.  Repeated rows
    count each.  Other columns are not read.  An empty table gives an empty result.

    Occurrences are counted inside tasks before they are shuffled.  An index holds about ``index``
    words, a key at most ``most`` until it leaves one code point open (then at most the square of the
    alphabet); memory of a task is bounded by these and one text."""
    words = settled(occurrences(docs, id_col, text_col, least, typo).where(F.col("n") >= often))
    rows, total = meeting(words, least, most)
    where = F.pmod(F.xxhash64("key"), F.lit(-(-total // index) or 1)) * 2 + (F.col("x") < F.col("m") - F.col("y")).cast("int")
    near = rows.select(where.alias("bucket"), "word", "n", "asks", "x", "y").groupBy("bucket") \
        .applyInPandas(near_in, "word string, near string, near_n bigint")
    every = near.withColumn("n", F.lit(None).cast("bigint")).unionByName(words, allowMissingColumns=True)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), "near")))
    found = every.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= F.lit(times) * F.col("n")
    found = settled(found.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"),
                                 F.when(enough, -F.col("best.n")).alias("form_n")))
    roots = last_of(found.where("form IS NOT NULL").select("word", "form", F.col("form_n").alias("n")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
