"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.llm import bpe, html, license, mixing, pii, quality, shingles, simhash, suffix, topk, toxicity
from seriesmith.llm.queries import vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, clashing column names."""
    texts = [None, "", "  \n ", "one", "word " * 3000, "Ünï😀 tïme.", "same line.\nsame line.", "x\x00y"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(3, "one", "en", "s", 3), (None, "lost id", "en", "s", 7)]
    rows += rows[-2:]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("kept", F.lit("mine")).withColumn("severity", F.lit("x")).withColumn("host", F.lit(1)).withColumn("fp", F.lit(2))


def test_awkward_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 0), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    ops = [
        license.scan, mixing.plan, mixing.mix, quality.clean, lambda d: bpe.encode(d, vocabulary()), simhash.near_duplicates,
        suffix.remove_repeats, pii.replace_private, lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        lambda d: html.extract(d.select("*", F.col("doc_id").alias("page_id"), F.lit("http://h.example/").alias("url"), F.col("text").alias("html"))),
    ]
    n = odd.count()
    for op in ops:
        got = op(odd)
        if op is not mixing.mix:
            assert got.count() == n
        else:
            assert got.columns == odd.columns
        assert op(odd.limit(0)).count() == 0
    vectors = spark.createDataFrame([(0, [1.0, None]), (50, None), (None, [1.0, 2.0]), (100, [float("nan"), 1.0]), (150, [])],
                                    "vec_id bigint, embedding array<float>")
    assert topk.top_k(vectors).count() == 0 == topk.top_k(vectors.limit(0)).count()


def test_license(spark):
    got = {r.doc_id: (r.licenses, r.n_unknown) for r in license.scan(table(spark, [
        "Text.\nReleased under the MIT License.", "No dot here\n# Licensed under the Apache License,\n# Version 2.0.",
        "Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3.",
        "Permission to sing is sought.", "plain",
        "Licensed under the Apache License, Version 2.0 (the License). You may not use this file except in compliance with the "
        "License. Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."])).collect()}
    assert got == {0: (["MIT"], 0), 1: (["Apache-2.0"], 0), 2: (["GPL-3", "CC-BY-NC-4.0"], 0), 3: ([], 1), 4: ([], 0),
                   5: (["Apache-2.0"], 0)}


def test_html_article_furniture_and_template(spark):
    page = ('<body><header>x</header><div class="cookie-notice">c</div><div id=main><h1>T&eacute;</h1><p>one <b>tw</b>o'
            "<p>three&nbsp;x<br>y<ul><li>a<li>b</ul></div><section id='comments'><p>no</section><p>tail &am")
    assert html.main_text(page) == "Té one two three x y a b tail &am"
    assert html.main_text("<article><p>a</p><nav>b</nav></article><p>c</p>") == "a"
    assert html.main_text(None) == html.main_text("") == html.main_text("<!-- x") == ""
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Our site since 1990.</p></div><div><p>Story {i} is new.</p></div></body>")
            for i in range(8)] + [(8, "http://h.example/8", "<body><div><p>Story 7 is new.</p></div></body>"), (9, None, "<p>q</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert got[0] == ("Story 0 is new.", 15) and got[8] == ("Story 7 is new.", 15) and got[9] == ("q", 1)


def test_html_reads_the_articles_of_the_given_pages(spark, data):
    import html as entities

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in html.extract(spark.read.parquet(f"{data}/pages.parquet")).collect():
        inner = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)


def test_mixing_rates_and_targets(spark):
    rng = random.Random(3)
    texts = [" ".join(["w"] * rng.randint(1, 60)) for _ in range(3000)]
    sources = ["b", "a", None, "c", "c", "c", "c", "é", "Z"]
    docs = table(spark, texts, sources)
    rows = mixing.plan(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.mix_size
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, rest, free = {}, sum(sizes.values()), set(names)
    while free:
        share = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    taken = Counter()
    for r in rows:
        assert r.mix_source_size == sizes[r.source] and r.mix_target == pytest.approx(target[r.source])
        assert 0 <= r.mix_copies <= 3
        taken[r.source] += r.mix_size * r.mix_copies
    for s in names:
        assert abs(taken[s] - target[s]) < 0.15 * target[s]
    assert mixing.mix(docs).count() == sum(r.mix_copies for r in rows)


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    vecs = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(1000 + i, [0.5] * 8) for i in range(60)]
    df = spark.createDataFrame(vecs + vecs[:3], "vec_id bigint, embedding array<double>")
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vecs + vecs[:3]]
    want = set()
    for i, q in vecs:
        if i % 50 == 0:
            q = np.floor(256 * np.array(q)).astype(int)
            best = sorted(((-int(q @ c), j) for j, c in whole if j != i))[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    for block in (8192, 64):
        assert {tuple(r) for r in topk.top_k(df, block=block, query_block=4).collect()} == want
    large = spark.createDataFrame([(50, [1e30, 1.0]), (51, [1e30, 2.0]), (52, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(large).orderBy("rank").collect()] == [51, 52]


def test_quality_measures(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").limit(150).collect()
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + [(10**9, "a b c a b c"), (10**9 + 1, "z z z z")], "doc_id bigint, text string")
    for r in quality.clean(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        grams = Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
        assert r.n_words == len(words) and r.n_repeat_words == len(hit) and r.word_chars == sum(map(len, words))
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text))


def test_bpe_is_the_library_s(spark, data):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    texts += ["a<|endoftext|>b <|endoftext|>", "x\x1c\x1d y\x85z   w  q\n\n  t", "Ⅷ²³½ 3² ٣٤", "日本語 テスト 　x", "don't 'll I'M  a​b",
              "🙂🙃 é é", " lead", "trail ", "\t\t a", "é" * 2000]
    for r in bpe.encode(table(spark, texts), vocabulary(), max_nodes=2000).collect():
        want = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == tok.decode(want, skip_special_tokens=False)


def test_simhash_links(spark):
    rng = random.Random(1)
    fps = {0, 2**64 - 1} | {rng.getrandbits(64) for _ in range(100)}
    for b in list(fps)[:60]:
        x = b
        for _ in range(rng.randint(1, 25)):
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
            x = y if rng.random() < 0.3 else b
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    from seriesmith.llm.components import components

    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for rows in (4096, 16):  # the second splits groups in pairs of parts
        got = {r.node: r.component for r in components(simhash.links(df, group_rows=rows), "a", "b").collect()}
        assert all(got.get(f, f) == find(f) for f in fps)


def test_simhash_fingerprint_and_groups(spark):
    import xxhash

    text = "The quick brown fox jumps over the lazy dog " * 3 + "END"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint_of(text) == want and simhash.fingerprint_of(None) == simhash.fingerprint_of(" ") == 0
    assert simhash.fingerprint_of("Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    docs = spark.createDataFrame([(5, text), (9, text), (2, "other text that stands alone here"), (None, None), (7, "")], "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(5, 5), (9, 5), (2, 2), (None, 7), (7, 7)}


def brute_removal(texts, width):
    seen = Counter()
    for t in texts:
        b = (t or "").encode()
        seen.update(b[i:i + width] for i in range(len(b) - width + 1))
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)


def test_suffix_order_is_sorted():
    rng = random.Random(5)
    for _ in range(30):
        d = bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(20, 300))) * rng.randint(1, 2) + b"\0\0"
        starts = np.arange(len(d) - 12)
        keys = [d[p:p + 10] for p in suffix.suffix_order(np.frombuffer(d, np.uint8), starts, 10)]
        assert keys == sorted(d[p:p + 10] for p in starts)


def test_repeats_go(spark, monkeypatch):
    rng = random.Random(6)
    shared = ["".join(rng.choice("abcdé fgh") for _ in range(rng.randint(30, 200))) for _ in range(12)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choice("xyz wvu") for _ in range(rng.randint(5, 90)))
                     for _ in range(rng.randint(0, 6))) for _ in range(120)]
    texts += texts[:20] + [None, "", "a" * 300, "ab" * 200, "a" * 45]
    want = list(brute_removal(texts, 40))
    for most in (1 << 20, 500):  # the second tells windows of common names apart by digest
        monkeypatch.setattr(suffix, "MOST", most)
        for r in suffix.remove_repeats(table(spark, texts), width=40).collect():
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_surrogates(spark):
    docs = table(spark, [
        "Mail Ann.Lee@corp.example or ann.lee@CORP.example, call +1 (377) 555-0271.", "Again ann.lee@corp.example: 10.1.2.3 and 4111 1111 1111 1111",
        "Frau Müller met Mr. John Smith; г-н; Г-жа Иванова came. SSN 123-45-6789.", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 1 2 3', "clean text"])
    got = {r.doc_id: r for r in pii.replace_private(docs).collect()}
    assert [got[i].pii_entities for i in range(5)] == [3, 3, 4, 1, 0] and got[4].text == "clean text"
    a, b = re.findall(r"\S+@\S+\.com", got[0].text)
    assert a.lower().strip(",") == b.lower().strip(",") and re.search(re.escape(a.lower().strip(",")), got[1].text.lower())
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.$", got[0].text) and "377" not in got[0].text
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", got[1].text)[0].replace(" ", "")
    digits = [int(c) for c in card]
    assert sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0 and card != "4" + "1" * 15
    assert re.match(r"Frau [A-Z][a-z]+ met Mr\. [A-Z][a-z]+ [A-Z][a-z]+; г-н; Г-жа [А-Я][а-я]+ came\. SSN \d{3}-\d{2}-\d{4}\.$", got[2].text)
    first = re.search(r"Mr\. (\w+)", got[2].text)[1]
    assert first in pii.GIVEN["m", "latin"] and "Smith" not in got[2].text
    assert re.search(r'"[0-9a-f]{40}"', got[3].text) and "04dbebab" not in got[3].text


def test_surrogates_differ_when_draws_collide(spark, monkeypatch):
    # a surrogate space of 16 values for 12 entities: draws must collide
    def tiny(kind, canon, attempt, key):
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), canon, attempt.cast("string")), 256), 1, 1), 16, 10)

    monkeypatch.setattr(pii, "surrogate", tiny)
    entities = spark.createDataFrame([("card", f"1{i:03d}") for i in range(10)] + [("card", "3"), ("card", "7")], "kind string, canon string")
    rows = pii.surrogates(entities, "k").collect()
    assert len(rows) == 12 == len({r.sur for r in rows}) and not {r.sur for r in rows} & {"3", "7"}


def test_toxicity_on_held_out_rows(spark, data_small):
    docs = spark.read.parquet(f"{data_small}/documents.parquet")
    labels = spark.read.parquet(f"{data_small}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.where(~held))
    assert model.thresholds == sorted(model.thresholds)
    rows = toxicity.score(docs, model).join(labels.where(held).withColumnRenamed("toxic", "label"), "doc_id").collect()
    right = sum(r.toxic == bool(r.label) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.93
    for r in rows[:20]:
        assert r.severity == pytest.approx(model.severity(r.text))


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = np.searchsorted([-1.0, 0.5, 2.0], x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=4000))
    w, theta = toxicity.cumulative_link(x, y)
    assert np.allclose(w, [2, -1, 0], atol=0.25) and np.allclose(theta, [-1, 0.5, 2], atol=0.3)


def test_pipeline_stages(spark, data, data_small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data_small}/documents.parquet")  # the smaller one has too few labels for a fit
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data_small}/labels.parquet").collect()}
    clean = corpus_pipeline.clean_language(spark, docs, data_small)
    kept = {r.doc_id for r in clean.collect()}
    missed = [i for i, t in labels.items() if t and i in kept]
    lost = [i for i, t in labels.items() if not t and i not in kept]
    assert len(missed) < 0.2 * sum(labels.values()) and len(lost) < 0.03 * len(labels)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one = corpus_pipeline.one_of_each(spark, docs, data)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in one.collect()} == smallest_of_groups(texts)
    assert {tuple(r) for r in one.collect()} <= {tuple(r) for r in docs.collect()}
    rows = corpus_pipeline.run(spark, data)
    assert set(rows.columns) >= {"doc_id", "n_tokens", "ids_sha256"} and rows.count() > 50
    assert hashlib.sha256(b"").hexdigest() not in {r.ids_sha256 for r in rows.collect()}


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def smallest_of_groups(texts):
    """Smallest key of each group of texts linked at a Jaccard similarity of 0.8 of their shingles."""
    keys = sorted(texts)
    sets, root = {k: grams(texts[k]) for k in keys}, {k: k for k in keys}
    for n, i in enumerate(keys):
        for j in keys[:n]:
            if root[i] != root[j] and 4 * len(sets[i]) <= 5 * len(sets[j]) and 4 * len(sets[j]) <= 5 * len(sets[i]) \
                    and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return set(root.values())


def test_pipeline_near_copies_with_shared_passages(spark, data_small):
    """Passages that many unrelated texts share, families below and above 0.8, and the given texts."""
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passages = [rng.choices(words, k=60) for _ in range(2)]
    texts = []
    for n in range(120):
        base = rng.choices(words, k=rng.choice([3, 20, 60, 200, 500])) + passages[n % 2]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 6])):
            t = list(base)
            for _ in range(max(1, int(len(t) * rng.choice([0.005, 0.02, 0.03, 0.05])))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t[: rng.choice([len(t), len(t) * 9 // 10])]))
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, table(spark, texts), None).collect()}
    assert got == smallest_of_groups(dict(enumerate(texts))) and len(got) < len(texts) - 20
    docs = spark.read.parquet(f"{data_small}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, data_small).collect()}
    assert got == smallest_of_groups({r.doc_id: r.text for r in docs.collect()})
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), data_small).count() == 0


def test_parities_never_hide_a_near_pair():
    rng = np.random.default_rng(4)
    for n in (1, 5, 70, 900, 3000):
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        for lost in (0.0, 0.05, 0.11, 0.3):
            b = np.unique(np.r_[a[rng.random(len(a)) >= lost], rng.integers(0, 2 ** 63, int(n * lost / 2)).astype(np.uint64)])
            if len(b):
                near = shingles.similar(a, b)
                assert shingles.may_be_near(shingles.parity(a), len(a), shingles.parity(b), len(b)) or not near


def test_pipeline_near_copies_by_five_word_shingles(spark):
    """Recall against brute force, with copies that lie beyond three bits of a fingerprint."""
    import corpus_pipeline

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(6, 160))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            t = list(base)
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                far += (simhash.fingerprint_of(texts[i]) ^ simhash.fingerprint_of(texts[j])).bit_count() > 3
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert far > 20
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, table(spark, texts), None).collect()}
    assert got == set(root)


def test_license_reports_every_version_of_a_rule(spark):
    gpl = "This work is licensed under the GNU General Public License, version {}."
    apache = "Licensed under the Apache License, Version {}."
    got = {r.doc_id: r.licenses for r in license.scan(table(spark, [
        f"{gpl.format(2)} {gpl.format(3)} {gpl.format(2)}", f"{apache.format('1.1')} Words. {apache.format('2.0')}",
        f"Licensed under CC BY 4.0. {gpl.format(3)} Licensed under CC BY 3.0."])).collect()}
    assert got == {0: ["GPL-2", "GPL-3"], 1: ["Apache-1.1", "Apache-2.0"], 2: ["GPL-3", "CC-BY-4.0", "CC-BY-3.0"]}


def test_pipeline_keeps_groups_with_equal_or_no_ids(spark):
    import corpus_pipeline

    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, "an apple fell from the tree"), (1, "quite another text of seven words"), (None, "lost words without any id"),
            (None, "lost words without any id"), (2, near), (None, f"{near} more"), (3, near)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    got = sorted((r.text, r.doc_id) for r in corpus_pipeline.one_of_each(spark, docs, None).collect())
    assert got == sorted([(rows[0][1], 1), (rows[1][1], 1), (rows[2][1], None), (near, 2)])


def test_toxicity_sample_has_one_row_for_an_id_that_recurs(spark):
    docs = table(spark, ["good words here", "awful insult"]).withColumn("doc_id", F.lit(7).cast("bigint"))
    many = docs.crossJoin(spark.range(500)).drop("id")
    labels = spark.createDataFrame([(7, 1)], "doc_id bigint, toxic int")
    data = toxicity.sample(many, labels, 100, "doc_id", "text")
    digest = min(["good words here", "awful insult"], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert len(data) == 1 and data["words"][0] == digest and data["label"][0] == 1


def test_severity_against_brute_force(spark):
    """Expected grade from the model's own terms and thresholds, computed plainly."""
    import math

    model = toxicity.Model({"bad": 1.5, "worse": 2.5}, [0.5, 2.0, 3.5])
    texts = [None, "", "bad", "Bad worse WORSE", "fine day", "worse " * 300]
    got = [r.severity for r in toxicity.score(table(spark, texts), model).orderBy("doc_id").collect()]
    for text, severity in zip(texts, got):
        counts = Counter(re.findall(toxicity.WORDS.pattern, (text or "").lower()))
        found = toxicity.terms(counts, model.weights)
        eta = sum(model.weights[t] * v for t, v in found.items())
        assert severity == pytest.approx(sum(1 / (1 + math.exp(t - eta)) for t in model.thresholds))
    assert got[2] > got[4] == got[0] and got[3] > got[2]


def test_suffix_query_returns_the_kept_text(spark, data):
    from seriesmith.llm.queries import QUERIES

    rows = QUERIES["op8_suffix"](spark, data).collect()
    assert any(r.n_removed for r in rows)
    for r in rows:
        if not r.n_removed:
            assert len((r.text or "").encode()) == r.n_bytes


def test_license_sql_agrees_on_texts_with_several_versions(spark, tmp_path):
    import duckdb

    from seriesmith.llm.queries import QUERIES, SQL

    gpl, apache = "This work is licensed under the GNU General Public License, version {}.", "Licensed under the Apache License, Version {}."
    texts = [f"{gpl.format(2)} {gpl.format(3)} {gpl.format(2)}", f"{apache.format('1.1')} Words. {apache.format('2.0')}",
             f"Licensed under CC BY 4.0. {gpl.format(3)} Licensed under CC BY 3.0.", None, "", "Released under the MIT License.",
             "Permission to sing is sought.", "No dot\n# Licensed under the Apache License,\n# Version 2.0."]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op1_license"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(SQL["op1_license"])
    order = [rel.columns.index(c) for c in ("doc_id", "sentence_ids", "licenses", "n_unknown")]
    assert got == sorted(tuple(r[k] for k in order) for r in rel.fetchall())


def test_html_keeps_article_parts_whose_class_only_mentions_furniture(spark):
    page = ("<html><body><div class='share-bar'>Top</div><article><p>First.</p><div class='share-of-market'><p>The share grew.</p></div>"
            "<section class='related-work'><p>Others did it.</p></section><p class='notice-of-meeting'>We meet.</p>"
            "<div class='related-posts'><p>More here</p></div><div class='social-share'>Share</div><div class='comments'>Nice!</div>"
            "<div id='newsletter'>Mail us</div></article></body></html>")
    df = spark.createDataFrame([(1, "http://h.example/", page)], "page_id bigint, url string, html string")
    assert html.extract(df).first().text == "First. The share grew. Others did it. We meet."


def test_pipeline_compares_what_fingerprints_link(spark, monkeypatch):
    """Fingerprint groups give the first candidates; the exact check drops those that are not near."""
    import corpus_pipeline

    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    near = [*base[:200], "other", *base[201:]]
    texts = [" ".join(base), " ".join(near), " ".join(f"x{i}" for i in range(30)), "", None, " \n"]
    docs = table(spark, texts)
    pairs, plain = [], shingles.near_texts

    def seen(docs, node, *args, candidates=None, **kwargs):
        found = {r.node: r.text for r in docs.select(node.alias("node"), "text").collect()}
        pairs.extend({found[r.a], found[r.b]} for r in candidates.collect())
        return plain(docs, node, *args, candidates=candidates, **kwargs)

    monkeypatch.setattr(shingles, "near_texts", seen)
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, None).collect()}
    linked = (simhash.fingerprint_of(texts[0]) ^ simhash.fingerprint_of(texts[1])).bit_count() <= 3
    assert linked and {texts[0], texts[1]} in pairs and any(" \n" in p for p in pairs)
    assert got == {0, 2, 3}
    # a wrong candidate links nothing, and none loses a link
    key = shingles.text_key(docs)
    nodes = {r.doc_id: r.node for r in docs.select("doc_id", key.alias("node")).collect()}
    wrong = spark.createDataFrame([(nodes[0], nodes[2])], "a bigint, b bigint")
    got = {r.node for r in plain(docs, key, candidates=wrong).collect()}
    assert {nodes[0], nodes[1]} <= got and nodes[2] not in got


def test_families_of_edited_copies_meet_in_few_pairs(spark, monkeypatch):
    """Copies on both sides of 0.8 from their base, of short and long texts: pairs grow with the texts, no link is lost."""
    import corpus_pipeline

    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for size, edits in ((140, (1, 2, 3, 4, 5)), (420, (4, 6, 9, 11, 13))):
        base = rng.choices(words, k=size)
        texts += [" ".join(base)] * 2
        for n in range(90):
            t = list(base)
            for at in rng.sample(range(size), rng.choice(edits)):
                t[at] = f"x{rng.randrange(10 ** 9)}" if n % 3 else rng.choice(words)
            texts.append(" ".join(t))
        # passages of the base in longer texts, one link across two copies only
        texts += [" ".join(base[:size // 2] + rng.choices(words, k=size // 2)) for _ in range(12)]
        texts.append(" ".join([*texts[-1].split()[:-2], "y", "z"]))
    pairs, plain = [], shingles.verified

    def counted(sets, found, width):
        pairs.append(found.count())
        return plain(sets, found, width)

    monkeypatch.setattr(shingles, "verified", counted)
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, table(spark, texts), None).collect()}
    assert got == smallest_of_groups(dict(enumerate(texts))) and 30 < len(got) < len(texts) - 30
    assert sum(pairs) < 4 * len(texts)
