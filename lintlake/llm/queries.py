"""The queries of this subpackage and the SQL to compare them with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids, exact, language, licenses, minhash, mixing, packing, passages, resampling, secrets, store, topk, vptree,
)
from .common import documents


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"),
                                  spaced=False, end_id=1, capacity=4096)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), share=1.5, max_repeats=2.0).drop("order_key", "source")


def op8_passage_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir), min_words=50, identity=0.8)


def op9_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.token_store(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                             spaced=True, end_id=0)


def op11_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_centroids(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), clusters=16, rounds=3,
                                       dim=64, scale=64, seed="1")


def op12_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
                               percent=5, least_words=20, seed="42")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_minhash_near_dedup, op2_language_id, op3_exact_dedup, op4_secret_scan, op5_best_fit_packing, op6_license_scan, op7_source_mixing,
        op8_passage_chaining, op9_topk_products, op10_token_store, op11_orchard_clusters, op12_vantage_neighbours,
        op13_importance_resampling)}


def _centroid_rounds(rounds: int) -> str:
    """Assignment to the nearest centroid (squared distance, then number) and new centroids, round by round."""
    return ",\n".join(rf"""near{r} AS MATERIALIZED (SELECT k.r, k.vec_id, min(
        (list_inner_product(k.x, k.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(k.x, c.x))::BIGINT * 16 + c.c) AS m
    FROM kept k CROSS JOIN cent{r} c GROUP BY k.r, k.vec_id),
sums{r} AS (SELECT m % 16 AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept) JOIN near{r} USING (r) GROUP BY ALL),
new{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM sums{r} GROUP BY c),
cent{r + 1} AS MATERIALIZED (SELECT c, coalesce(new{r}.v, cent{r}.v) AS v, coalesce(new{r}.v, cent{r}.v)::DOUBLE[] AS x
    FROM cent{r} LEFT JOIN new{r} USING (c))""" for r in range(rounds)) + f""",
near{rounds} AS MATERIALIZED (SELECT k.r, k.vec_id, min(
        (list_inner_product(k.x, k.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(k.x, c.x))::BIGINT * 16 + c.c) AS m
    FROM kept k CROSS JOIN cent{rounds} c GROUP BY k.r, k.vec_id)"""


_CRC_TABLE = ", ".join(map(str, resampling.crc_step().tolist()))

def _license_phrases() -> str:
    rows = [(label, True, phrase, phrase) for label, phrase in licenses.BASE]
    rows += [(label, False, passage, phrase) for label, passage, phrase in licenses.TEMPLATES]
    return ", ".join(f"({no}, '{label}', {base}, '{passage}', '{phrase}')"
                     for no, (label, base, passage, phrase) in enumerate(rows))


_FREQUENT = ", ".join(f"'{w}'" for w in sorted(licenses.FREQUENT))


ORACLE_SQL: dict[str, str] = {
    # words and 2-word shingles; pairs by shared shingles; smallest id reachable by recursion
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) = 1 THEN w
        ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM words),
items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents
    UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id),
least_ AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least_ USING (doc_id)""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    # places of all templates by counting their words at the same relative start
    "op6_license_scan": rf"""
WITH given(no, label, base, passage, phrase) AS (VALUES {_license_phrases()}),
cut AS (SELECT no, label, base, string_split(passage, ' ') AS w, len(string_split(phrase, ' ')) AS needed,
    len(string_split(passage[:strpos(' ' || passage || ' ', ' ' || phrase || ' ') - 1], ' ')) - 1 AS before FROM given),
each AS (SELECT no, label, base, needed, unnest(w) AS word, generate_subscripts(w, 1) - 1 - before AS place FROM cut),
library AS (SELECT *, place BETWEEN 0 AND needed - 1 AS mandatory FROM each
    WHERE place BETWEEN 0 AND needed - 1 OR word NOT IN ({_FREQUENT})),
templates AS (SELECT no, label, base, count(*) AS n, count(*) FILTER (mandatory) AS needed
    FROM library GROUP BY no, label, base),
split AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM split),
starts AS (SELECT doc_id, no, pos - place AS start, count(*) AS matched, count(*) FILTER (mandatory) AS held
    FROM words JOIN library USING (word) GROUP BY doc_id, no, start),
places AS (SELECT * FROM starts JOIN templates USING (no) WHERE held = needed),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
    max(start) FILTER (base) AS last_word, max(matched / n) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels FROM places GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM split LEFT JOIN found USING (doc_id)""",
    "op7_source_mixing": r"""
WITH sized AS MATERIALIZED (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5(concat(doc_id::VARCHAR, ':', coalesce(text, ''))) AS h FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER ()
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
plan AS (SELECT *, coalesce(least(cap, weight * (SELECT arg_min(level, ratio) FROM levels WHERE ratio > level)), cap)
    AS target FROM levels),
lined AS (SELECT s.*, p.source_size, p.target, p.rank, coalesce(sum(size) OVER (PARTITION BY s.source
    ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
done AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS passes FROM lined),
taken AS (SELECT *, (passes * size + greatest(0, least(size, floor(target) - passes * source_size - before)))::BIGINT
    AS taken, least(1.0::DOUBLE, before / target) AS q FROM done)
SELECT doc_id, size, source_size, target, taken,
    CASE WHEN taken > 0 OR (size = 0 AND before < target) THEN CASE rank % 3
        WHEN 0 THEN (sqrt(2.25::DOUBLE - 2 * q) - 1.5::DOUBLE) / -1.0::DOUBLE WHEN 1 THEN q
        ELSE sqrt(0.25::DOUBLE + 2 * q) - 0.5::DOUBLE END END AS position
FROM taken""",
    "op9_topk_products": """
WITH vectors AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
    FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_orchard_clusters": rf"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, v, v::DOUBLE[] AS x FROM (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
cent0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST) - 1 AS c, v, x FROM kept
    QUALIFY c < 16),
{_centroid_rounds(3)},
placed AS (SELECT vec_id, (m % 16)::INTEGER AS cluster, m // 16 AS distance FROM near3)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM placed JOIN cent3 ON c = cluster""",
    "op12_vantage_neighbours": """
WITH vectors AS MATERIALIZED (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    # the CRC of every distinct feature, byte by byte
    "op13_importance_resampling": rf"""
WITH RECURSIVE texts AS MATERIALIZED (
    SELECT row_number() OVER () AS r, * FROM (
        SELECT false AS target, doc_id, text FROM documents UNION ALL SELECT true, NULL, text FROM benchmark)),
words AS MATERIALIZED (
    SELECT r, target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS MATERIALIZED (
    SELECT r, target, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))],
        [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS f FROM words),
counted AS MATERIALIZED (SELECT r, target, f, count(*) AS n FROM features GROUP BY ALL),
named AS MATERIALIZED (SELECT f, hex(encode(f)) AS h, row_number() OVER () AS id FROM (SELECT DISTINCT f FROM counted)),
crc(id, i, state) AS (
    SELECT id, 0, 4294967295 FROM named
    UNION ALL
    SELECT id, i + 1, xor(state >> 8, [{_CRC_TABLE}][(xor(state & 255,
        (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) + 1)::BIGINT])
    FROM crc JOIN named USING (id) WHERE 2 * i < len(h)),
hashed AS MATERIALIZED (SELECT f, xor(state, 4294967295) % 10000 AS b FROM crc JOIN named USING (id) WHERE 2 * i = len(h)),
totals AS (SELECT b, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t
    FROM counted JOIN hashed USING (f) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000)
    / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000))))::BIGINT AS gain FROM totals),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features
    FROM counted JOIN hashed USING (f) JOIN gains USING (b) WHERE NOT target GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
        / 4294967296::DOUBLE))))::BIGINT AS score
    FROM words LEFT JOIN weights USING (r) WHERE NOT target),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank
FROM placed""",
}
