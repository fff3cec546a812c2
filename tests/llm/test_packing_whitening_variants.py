"""Best-fit packing, whitening and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesmith.llm import packing, variants, whitening
from seriesmith.llm.queries import QUERIES, vocabulary

DOCS = "doc_id bigint, text string, lang string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, clashing column names."""
    texts = [None, "", "  \n ", "one", "letters " * 9000, "Ünï😀 tïme <|endoftext|>.", "x" * 20000]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(3, "one", "en"), (None, "lost id", "en"), (None, "lost id", "en")]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("piece", "length", "rank", "part", "n", "word", "form", "key", "bucket", "x", "v", "component"):
        df = df.withColumn(name, F.lit("mine"))
    return df


# -- packing ---------------------------------------------------------------------------------


def best_fit(lengths, capacity):
    """Sequences that best fit, longest first, one piece at a time, needs."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def check_layout(rows, capacity):
    """Sequences without gaps or overlaps; returns how many there are."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=150))
def test_plan_is_best_fit(capacity, lengths):
    lengths = [min(n, capacity) for n in lengths]
    counts = Counter(lengths)
    used = {s for _, _, first, each, _ in packing.plan(counts, capacity) for s in [first]}
    slots = packing.plan(counts, capacity)
    by_length = defaultdict(list)
    for n, rank, first, each, offset in slots:
        by_length[n].append((rank, first, each, offset))
    room = defaultdict(list)
    for n, count in counts.items():
        for r in range(count):
            rank, first, each, offset = [s for s in by_length[n] if s[0] <= r][-1]
            room[first + (r - rank) // each].append((offset + (r - rank) % each * n, n))
    for places in room.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(room) == best_fit(lengths, capacity) and used <= set(room)


def test_plan_does_not_grow_with_the_number_of_pieces():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 10 ** 10) for n in range(1, 1025)}
    slots = packing.plan(counts, 1024)
    assert len(slots) < 138_240
    assert packing.plan({}, 1024) == []


def test_ids_equal_the_tokenizers_library_on_every_kind_of_character():
    reference, own = Tokenizer.from_file(vocabulary()), packing.Ids(vocabulary())
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000][::3] + list(range(0x300)) + list(range(0x2000, 0x2070))
    texts = [f"a{chr(c)}b 1{chr(c)}! {chr(c)}{chr(c)}  {chr(c)} x\n{chr(c)}" for c in points]
    texts += ["<|endoftext|> a<|endoftext|><|endoftext|>b", " " * 5000, "\n" * 5000 + "x", "ab" * 5000, "", "it's we'LL  'tis"]
    for text, found in zip(texts, reference.encode_batch_fast(texts, add_special_tokens=False)):
        assert own(text).tolist() == found.ids, text


def test_packing_against_the_library_and_best_fit(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    reference = Tokenizer.from_file(vocabulary())
    rows = QUERIES["op11_packing"](spark, data).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    lengths = []
    for d in docs.collect():
        ids = np.array(reference.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted(got.pop(d.doc_id), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and all(r.length == 1024 for r in mine[1:])
        assert len(mine) == 1 or len(ids) > 1024
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
            lengths.append(r.length)
        assert at == len(ids)
    assert not got
    n = check_layout(rows, 1024)
    assert n == best_fit(lengths, 1024) and n <= 1.02 * -(-sum(lengths) // 1024) + 1


def test_packing_of_awkward_rows_and_many_equal_lengths(spark, odd):
    out = packing.pack(odd, vocabulary()).collect()
    check_layout(out, 1024)
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r.doc_id for r in odd.collect())
    assert [(r.length, r.ids_crc32) for r in out if r.doc_id in (0, 1)] == [(1, zlib.crc32(b"\2\0\0\0"))] * 2
    assert packing.pack(odd.limit(0), vocabulary()).count() == 0
    many = docs_of(spark, ["same"] * 400 + ["other words"] * 30)
    rows = packing.pack(many, vocabulary(), capacity=7, ranked=9).collect()
    assert len(rows) == 430 and check_layout(rows, 7) == best_fit([r.length for r in rows], 7)


# -- whitening -------------------------------------------------------------------------------


def test_whitening_against_numpy(spark, data_small):
    vectors = spark.read.parquet(f"{data_small}/embeddings.parquet")
    vectors = vectors.union(vectors.limit(40))  # copies count once in the fit
    given_ = {r.vec_id: np.floor(256 * np.array(r.embedding, float)) for r in vectors.collect()}
    fit = np.unique(np.stack(list(given_.values())), axis=0)
    n, sums = len(fit), fit.sum(0)
    cov = np.cov(fit.T, bias=True)
    values, units = np.linalg.eigh(cov)
    values, units = values[::-1], units[:, ::-1]
    rows = whitening.whiten(vectors).collect()
    assert len(rows) == 4 * vectors.count()
    side = {}
    for r in rows:
        x, k = given_[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum(int(n * a - b) ** 2 for a, b in zip(x, sums))
        want = (x - sums / n) @ units[:, k] / np.sqrt(values[k])
        if abs(want) > 1e-6:
            side.setdefault(k, np.sign(want) * np.sign(r.whitened))
        assert r.whitened == pytest.approx(side.get(k, 1) * want, abs=1e-9)
        assert r.explained == pytest.approx(values[k] / np.trace(cov), rel=1e-10) and r.identity_error < 1e-9


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 24), st.integers(1, 24), st.integers(0, 10 ** 6))
def test_factor_and_rotations_of_any_rank(d, r, seed):
    rng = np.random.default_rng(seed)
    g = rng.normal(size=(d, min(d, r))) * 10.0 ** rng.uniform(-2, 2, min(d, r))
    a = g @ g.T
    low = whitening.pivoted_cholesky(a)
    assert np.allclose(low @ low.T, a, atol=1e-10 * np.trace(a))
    values, units = whitening.one_sided_jacobi(low)
    assert np.all(np.diff(values) <= 0) and np.allclose(units.T @ units, np.eye(len(values)), atol=1e-12)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:len(values)], atol=1e-12 * np.trace(a))
    assert np.allclose(a @ units, units * values, atol=1e-11 * np.trace(a))


def test_whitening_of_awkward_rows(spark):
    big = 9007199254740993
    rows = [(1, [1.0, 2.0, 0.0]), (big, [2.0, 1.0, 0.0]), (None, [3.0, 3.0, 0.0]), (1, [1.0, 2.0, 0.0]), (4, [1.0, None, 2.0]), (5, None),
            (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, []), (9, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("n", F.lit("mine")).withColumn("x", F.lit(1))
    out = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in out) == {1: 4, big: 2, None: 2}  # rank two: two components
    assert {r.n for r in out} == {3} and max(r.identity_error for r in out) < 1e-12
    for few in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id IN (4, 5)")):
        assert whitening.whiten(few).count() == 0
    huge = spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)]) for i in range(5)], "vec_id bigint, embedding array<float>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {2 ** 63 - 1}


# -- variants --------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_of(rows):
    total = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    n = {w: k for w, k in total.items() if len(w) >= 7 and k >= 2}
    out = {}
    for w in n:
        close = sorted((-n[v], v) for v in n if near(w, v))
        form = close[0][1] if close and -close[0][0] >= 10 * n[w] else None
        out[w] = (form, n[w], len(close), n[form] if form else None)
    final = {}
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        final[w] = (out[w][0], root, *out[w][1:])
    return final


def test_variants_against_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op13_variants"](spark, data).collect()}
    assert got == variants_of(rows) and len(got) > 1000


@pytest.mark.parametrize("most", [3, 40, 20_000])
def test_variants_with_split_keys_chains_and_ties(spark, most):
    """Few letters and one common beginning, so that keys are split many times; chains of forms."""
    rng = random.Random(most)
    words = []
    for _ in range(60):
        w = "aaa" + "".join(rng.choice("abÉé") for _ in range(rng.randint(4, 9)))
        words += [w] * rng.choice([2, 2, 30, 400])
        for _ in range(4):
            at = rng.randrange(len(w))
            words += [rng.choice([w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "z" + w[at + 1:]])] * rng.choice([1, 2, 3, 25])
    words += ["É" * 300] * 25 + ["É" * 299] * 2 + ["Long" * 900] * 2 + ["long" * 899 + "lon"] * 30
    rng.shuffle(words)
    texts = [" ".join(words[i::50]) for i in range(50)] + [None, "", "12 34"]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n)
           for r in variants.group(docs_of(spark, texts), most=most, index=200).collect()}
    want = variants_of(list(enumerate(texts)))
    assert got == want
    assert any(v[1] not in (w, v[0]) for w, v in want.items())  # some root is further than the form


def test_variants_of_awkward_rows(spark, odd):
    got = {(r.word, r.n) for r in variants.group(odd).collect()}
    assert got == {(w, v[2]) for w, v in variants_of([(r.doc_id, r.text) for r in odd.collect()]).items()}
    assert variants.group(odd.limit(0)).count() == 0
