"""Byte-level BPE: encoding by last-token states on a trie of words, and decoding.

The encoding of a word is the only split of its bytes into tokens in which every two neighbours
are *stable*: byte pair merging of the two tokens' bytes yields just these two.  So the last
token of a prefix is the token that ends it and is stable behind the last token of what comes
before it.  Words with a common beginning share the states of that beginning: distinct words are
inserted into a trie, the trie is walked depth first, and each node (prefix) gets its last token
once.  The encoding of a word is read off backwards from its leaf.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split of byte-level BPE before merging (fixed value of the vocabulary format).
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same for texts of Latin-1 characters only, with classes spelled out.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\x09-\\x0d \\x85\\xa0"
SPLIT_LATIN = (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Trie:
    """Words and the last token of each of their prefixes.

    A trie of more than ``max_nodes`` nodes is emptied before the next text: memory is bounded by
    that and one text, no word is left out.
    """

    def __init__(self, path: str, max_nodes: int = 500_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.ids = {raw(s): i for s, i in model["model"]["vocab"].items()
                    if all(c in names for c in s)}
        self.special = {a["content"]: a["id"] for a in model["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.pair = {(self.ids[a], self.ids[b]): r for (a, b), r in self.rank.items()}
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), r in self.rank.items():
            self.made.setdefault(self.ids[a + b], (r, self.ids[a], self.ids[b]))
        self.never = len(self.rank)
        self.edges: tuple[dict, dict] = {}, {}
        self.whole: dict[int, bool] = {}
        self.tails = {t[i:]: -1 for t in self.ids for i in range(len(t))} | self.ids
        self.max_nodes = max_nodes
        self.stable: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last = [-1]
        self.words: dict[str, str] = {s: str(i) for s, i in self.special.items()}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain byte pair merging; used for pairs of tokens only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            a, b = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that stand at the right (1) or left (0) end of ``token`` while it is being
        merged, with the rank that makes each and the rank that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            known, until = [], self.never
            while True:
                made = self.made.get(token)
                known.append((token, made[0] if made else -1, until))
                if not made:
                    break
                until, token = made[0], made[1 + side]
            self.edges[side][known[0][0]] = known
        return known

    def is_whole(self, token: int) -> bool:
        if token not in self.whole:
            self.whole[token] = self.merged(self.bytes_of[token]) == [self.bytes_of[token]]
        return self.whole[token]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether merging never joins the ends of the two tokens.

        Merges of a token run in the order of their ranks, so an end token exists from the rank
        that makes it to the rank that ends it; two ends join if they exist at once and the rank
        of their pair comes before both are ended (on equal ranks the pair further left wins)."""
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) > 1_000_000:
                self.stable.clear()
            known = self.is_whole(right)
            if known and left >= 0:
                pair = self.pair
                ends, starts = self.edge(left, 1), self.edge(right, 0)
                for a, made_a, until_a in ends:
                    for b, made_b, until_b in starts:
                        if max(made_a, made_b) < min(until_a, until_b):
                            r = pair.get((a, b))
                            if r is not None and r < until_a and r <= until_b:
                                known = False
                                break
                    if not known:
                        break
            self.stable[left, right] = known
        return known

    def add(self, words: list[str]) -> None:
        """Insert words in byte order, which visits the trie depth first, and set new nodes."""
        child, last, tails, of, stable = self.child, self.last, self.tails, self.bytes_of, self.stable
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            node, path = 0, [0]
            for depth, byte in enumerate(data, 1):
                key = node << 8 | byte
                node = child.get(key)
                if node is None:
                    node = child[key] = len(last)
                    ends, start = [], depth - 1
                    while start >= 0:
                        token = tails.get(data[start:depth])
                        if token is None:
                            break
                        if token >= 0:
                            ends.append((last[path[start]], token))
                        start -= 1
                    for pair in reversed(ends):
                        fits = stable.get(pair)
                        if fits or fits is None and self.is_stable(*pair):
                            last.append(pair[1])
                            break
                    else:
                        raise ValueError("a byte of the text is not in the vocabulary")
                path.append(node)
            tokens, at = [], len(data)
            while at:
                token = last[path[at]]
                tokens.append(token)
                at -= len(of[token])
            tokens.reverse()
            self.words[word] = ",".join(map(str, tokens))


class Coder:
    """Encodes texts: special tokens are cut out, the rest is split into words for the trie."""

    def __init__(self, path: str, max_nodes: int = 500_000):
        import re

        import regex

        self.trie = Trie(path, max_nodes)
        self.any = regex.compile(SPLIT)
        self.latin = re.compile(SPLIT_LATIN)
        found = sorted(self.trie.special, key=len, reverse=True)
        self.bytes_of = {str(i): b for i, b in self.trie.bytes_of.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any.findall(text)
        return self.latin.findall(text)

    def pieces(self, text: str) -> list[str]:
        special = self.trie.special
        if self.specials is None or not any(s in text for s in special):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self.split(part)
        return out

    def encode(self, text: str) -> str:
        """The ids of a text, joined by commas."""
        trie = self.trie
        pieces = self.pieces(text)
        found = list(map(trie.words.get, pieces))
        if None in found:
            if len(trie.last) > trie.max_nodes:
                trie.clear()
            trie.add([p for p in dict.fromkeys(pieces) if p not in trie.words])
            found = map(trie.words.__getitem__, pieces)
        return ",".join(found)

    def decode(self, ids: str) -> str:
        """The text of ids joined by commas; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_CODERS: dict[tuple, Coder] = {}


def coder(path: str, max_nodes: int) -> Coder:
    """One coder a worker process: its trie serves all tasks that run there."""
    if (path, max_nodes) not in _CODERS:
        _CODERS[path, max_nodes] = Coder(path, max_nodes)
    return _CODERS[path, max_nodes]


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           max_nodes: int = 500_000, digests: bool = False) -> DataFrame:
    """Encode every whole text with the byte-level BPE vocabulary at ``path``, then decode it.

    Returns the id column, ``n_tokens``, ``ids`` (array of int) and ``decoded``, or with
    ``digests`` their SHA-256 instead.  A null text counts as empty: no ids.  Rows are
    independent: repeated rows give repeated rows, an empty table an empty result, other columns
    are not read.  The path must be readable where tasks run.  Nothing is shuffled.
    """
    schema = SCHEMA if digests else T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *schema.fields[1:]])

    def run(batches):
        own = coder(path, max_nodes)
        for batch in batches:
            out = []
            for source in batch["text"]:
                ids = own.encode(source or "")
                text = own.decode(ids)
                n = ids.count(",") + 1 if ids else 0
                if digests:
                    out.append((n, hashlib.sha256(ids.encode()).hexdigest(),
                                hashlib.sha256(text.encode()).hexdigest()))
                else:
                    out.append((n, [int(i) for i in ids.split(",")] if ids else [], text))
            made = pd.DataFrame(out, columns=schema.names[1:])
            made.insert(0, "doc_id", batch["doc_id"].to_numpy(object))
            yield made

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, schema)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
