"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, license, mixing, packing, pii, quality, simhash, suffix, topk, toxicity, variants, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    """Path of the public byte-level vocabulary, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op3_mixing(spark, sf_dir):
    rows = mixing.plan(documents(spark, sf_dir), keep_text=False)
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                       F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


SQL["op3_mixing"] = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1|' || coalesce('=' || doc_id::VARCHAR, '') || '|' || coalesce('=' || md5(text), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
    1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS w
  FROM rows_ GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS n FROM sizes),
prefix AS (
  SELECT *, (SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER before, 0) AS rest,
    (SELECT sum(w) FROM sizes) - coalesce(sum(w) OVER before, 0) AS ws
  FROM ordered WINDOW before AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT min(n) AS n FROM prefix WHERE cap * ws >= w * rest),
targets AS (
  SELECT p.source, p.source_size, CASE WHEN p.n < cut.n OR cut.n IS NULL THEN p.cap::DOUBLE
    ELSE (p.w * c.rest)::DOUBLE / c.ws::DOUBLE END AS target
  FROM prefix p, cut LEFT JOIN prefix c ON c.n = cut.n),
rates AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rates
"""


@query
def op6_bpe(spark, sf_dir):
    return bpe.encode(documents(spark, sf_dir), vocabulary(), digests=True)


@query
def op7_simhash(spark, sf_dir):
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_suffix(spark, sf_dir):
    rows = suffix.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                       F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@query
def op9_pii(spark, sf_dir):
    return pii.replace_private(documents(spark, sf_dir)).select("doc_id", "text", "pii_entities")


@query
def op10_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", "severity", "grade", "toxic")


@query
def op1_license(spark, sf_dir):
    rows = license.scan(documents(spark, sf_dir))
    return rows.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"),
                       F.array_join("licenses", ",").alias("licenses"), "n_unknown")


def _license_sql() -> str:
    """The scan in SQL; sentences and rules are the operator's parameters, the logic is not."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in license.SENTENCES.items())
    steps, left, names = [], "ids", []
    for n, (name, ids) in enumerate(license.RULES.items()):
        v = license.VERSION
        seq = "\\s+".join(i + (f"(:{v})?" if j == 0 else f"(?::{v})?") for j, i in enumerate(ids))
        pattern = quoted(f" {seq} ")
        title = f"replace({quoted(name.strip())}, '{{v}}', substr(coalesce(hit, ''), 2))"
        steps.append(f"s{n} AS (SELECT *, {left} AS l{n}, regexp_replace({left}, {pattern}, ' ', 'g') AS l{n}x, "
                     f"list_transform(regexp_extract_all({left}, {pattern}, 1), lambda hit: {title}) AS h{n} FROM {f's{n - 1}' if n else 'joined'})")
        left = f"l{n}x"
        names.append(f"h{n}")
    last = f"s{len(license.RULES) - 1}"
    cue = "(?i)licen[cs]|redistribut|permission|warrant|public domain|unencumbered"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}.\n]+', ' ', 'g') AS t FROM documents),
sent AS (SELECT rid, unnest(range(len(x))) AS n, unnest(x) AS s FROM (
  SELECT rid, regexp_split_to_array(regexp_replace(t, '\\.+(\\s|$)', chr(1) || '\\1', 'g'), chr(1)) AS x
  FROM docs WHERE regexp_matches(t, '{cue}'))),
parts AS (SELECT rid, n, unnest(range(len(p))) AS k, unnest(p) AS s FROM (
  SELECT rid, n, list_concat(list_concat([s], l), list_transform(list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '{cue}')),
    lambda i: array_to_string(l[i:], chr(10)))) AS p FROM (SELECT *, string_split(s, chr(10)) AS l FROM sent WHERE regexp_matches(s, '{cue}')))),
form AS (SELECT rid, n, k, trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '([0-9])\\.([0-9])', '\\1' || chr(2) || '\\2', 'g'),
  '\\.', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM parts WHERE regexp_matches(s, '{cue}')),
uniq AS (SELECT rid, n, min(k) AS k, replace(s, chr(2), '.') AS s FROM form GROUP BY rid, n, s),
named AS (SELECT u.rid, u.n, u.k, coalesce(a.id, b.id || ':' || regexp_extract(u.s, '[0-9]+(?:\\.[0-9]+)*')) AS id
  FROM uniq u LEFT JOIN known a ON a.sentence = u.s
  LEFT JOIN known b ON b.sentence = regexp_replace(u.s, '[0-9]+(?:\\.[0-9]+)*', '{{v}}', 'g')),
groups AS (SELECT rid, n, count(id) AS found FROM named GROUP BY rid, n),
per AS (SELECT rid, string_agg(id, ',' ORDER BY n, k) AS sentence_ids, ' ' || coalesce(string_agg(id, '  ' ORDER BY n, k), '') || ' ' AS ids
  FROM named GROUP BY rid),
unknown AS (SELECT rid, count(*) FILTER (WHERE found = 0) AS n_unknown FROM groups GROUP BY rid),
joined AS (SELECT d.doc_id, coalesce(p.sentence_ids, '') AS sentence_ids, coalesce(p.ids, '  ') AS ids, coalesce(u.n_unknown, 0)::BIGINT AS n_unknown
  FROM docs d LEFT JOIN per p USING (rid) LEFT JOIN unknown u USING (rid)),
{", ".join(steps)}
SELECT doc_id, sentence_ids, coalesce(found, '') AS licenses, n_unknown FROM (SELECT doc_id, sentence_ids, (SELECT string_agg(x, ',' ORDER BY k) FROM (SELECT x, min(k) AS k FROM (
    SELECT unnest(every) AS x, unnest(range(len(every))) AS k) GROUP BY x)) AS found, n_unknown
  FROM (SELECT *, flatten([{", ".join(names)}]) AS every FROM {last}))
"""


SQL["op1_license"] = _license_sql()


@query
def op5_quality(spark, sf_dir):
    rows = quality.clean(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op5_quality"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (
  SELECT rid, i AS p FROM again UNION ALL SELECT rid, i + 1 FROM again UNION ALL SELECT rid, i + 2 FROM again) GROUP BY rid),
lines AS (SELECT rid, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS symbols, length(x) - length(replace(x, '!', '')) AS marks
  FROM (SELECT rid, unnest(l) AS x FROM d)),
lost AS (SELECT rid, sum(n) AS n FROM lines WHERE
  regexp_matches(lower(x), '{"|".join(quality.BOILERPLATE)}') OR contains(x, '{{') OR contains(x, '}}')
  OR (n > 1 AND (symbols * 4 >= n OR marks * 2 > n)) OR (n > 3 AND NOT regexp_matches(x, '[.!?…。！？]')) GROUP BY rid),
m AS (SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM d LEFT JOIN covered c USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= n_words * {quality.LOSS} AS kept
FROM m
"""


@query
def op2_html(spark, sf_dir):
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op4_topk(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL["op4_topk"] = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM (SELECT DISTINCT * FROM e WHERE vec_id % 50 = 0) q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 5
"""


@query
def op11_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), vocabulary())


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_variants(spark, sf_dir):
    return variants.group(documents(spark, sf_dir))
