"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import licenses, mixing, mtree, neardup, packing, quality, secrets, tokencount, toxicity, warc
from lodestack.llm.common import shared_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_report(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_report(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % mtree.QUERY_EVERY == 0)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own, so that every run does the whole work.
    return tokencount.token_counts(table(spark, sf_dir, "documents"), shared_path(spark, "token-cache")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# What SQL can say of operators whose whole result it can't: columns of the same reports.


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_report(table(spark, sf_dir, "documents"), None)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_tokens(spark, sf_dir).select("doc_id", "n_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_toxicity, op3_quality, op4_topk, op5_neardup, op6_mixing, op7_licenses, op8_secrets, op9_tokens, op10_packing, pipeline)
    + (quality_base, license_base, secret_base, token_bytes)
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS payload_digest,
                   octet_length(encode(coalesce(html, ''))) AS payload_bytes
            FROM pages
        ), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN f.first_id IS NOT NULL AND f.first_id IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id IS DISTINCT FROM p.page_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda t: t[1] * t[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5""",
    "op6_mixing": """
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
        ), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), w AS (
            SELECT *, 2.0::DOUBLE * source_size AS lim,
                   CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
            FROM s
        ), o AS (SELECT *, lim / weight AS ratio FROM w
        ), f AS (
            SELECT *, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE
                      - coalesce(sum(lim) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(weight) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
            FROM o
        ), c AS (SELECT *, rest * weight >= lim * weights AS capped FROM f
        ), l AS (SELECT rest AS open_rest, weights AS open_weights FROM c WHERE NOT capped ORDER BY ratio, encode(source) NULLS LAST LIMIT 1
        ), t AS (
            SELECT source, source_size, CASE WHEN capped THEN lim ELSE open_rest * weight / open_weights END AS target
            FROM c LEFT JOIN l ON true
        ), r AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                   CAST(CAST('0x' || substr(sha256('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM r""",
    "quality_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
        w AS (SELECT n, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
        l AS (SELECT n, unnest(string_split(t, chr(10))) AS line FROM d),
        u AS (SELECT n, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS dups FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n),
        g AS (SELECT n, s, array_to_string(w[s:s + 7], ' ') AS k FROM (SELECT n, w, unnest(range(1, len(w) - 6)) AS s FROM w WHERE len(w) >= 8)),
        r AS (SELECT n, s FROM g QUALIFY count(*) OVER (PARTITION BY n, k) > 1),
        c AS (SELECT n, count(DISTINCT s + j) AS repeats FROM (SELECT n, s, unnest(range(0, 8)) AS j FROM r) GROUP BY n),
        b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, CAST(coalesce(repeats, 0) AS BIGINT) AS n_repeat_words
              FROM d JOIN w USING (n) LEFT JOIN u USING (n) LEFT JOIN c USING (n))
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b""",
    "license_base": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i:i + 3] = ['under', 'the', 'mit', 'license']) AS a,
                     list_filter(range(1, len(w) + 1), lambda i: w[i:i + 3] = ['apache', 'license', 'version', '2']) AS b, list_filter(range(1, len(w) + 1), lambda i: w[i:i + 2] = ['cc', 'by', 'nc']) AS c FROM w)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(a) + len(b) + len(c) AS BIGINT) AS n_base,
               CAST(list_min(list_concat(a, b, c)) - 1 AS BIGINT) AS first_word, CAST(list_max(list_concat(a, b, c)) - 1 AS BIGINT) AS last_word,
               array_to_string(list_filter([CASE WHEN len(b) > 0 THEN 'apache-2' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' END, CASE WHEN len(a) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels
        FROM p""",
    "secret_base": r"""
        SELECT doc_id,
               CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
               CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
               CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
        FROM documents""",
    "token_bytes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents",
}
