"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import fit, pii_digest, with_spans

    return pii_digest(with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), fit(spark)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed, mixing_digest

    return mixing_digest(mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import component_digest, near_duplicates

    return component_digest(near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, identify, language_digest

    docs = table(spark, sf_dir, "documents")
    return language_digest(identify(docs.select("doc_id", "text"), fit(docs)))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import fit, judged, url_digest

    return url_digest(judged(table(spark, sf_dir, "pages").select("page_id", "url"), fit(spark)))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import with_next

    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, quality_digest, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_digest(scored(docs, fit(docs, table(spark, sf_dir, "labels"))))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_counts, token_digest

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digest(token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"]))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import read_back, windows

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return read_back(windows(turns.unionByName(odd)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_digest, scan_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(scan_documents(docs, table(spark, sf_dir, "benchmark")))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extracted, html_digest

    return html_digest(extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitening_digest

    return whitening_digest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import alignment_digest

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_urls": op5_urls,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality": op7_quality,
    "op8_tokens": op8_tokens,
    "op9_chat": op9_chat,
    "op10_decontaminate": op10_decontaminate,
    "op11_html": op11_html,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}

#: Mixing, chat formatting and contamination have a SQL form: the others hang on trained models, 64-bit xxHash or merges.
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS lot,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents
), c AS (
  SELECT *, length(bin(size + 1)) * 4 + (((size + 1) >> greatest(length(bin(size + 1)) - 3, 0)) & 3) AS class, h % greatest(8, CAST(ceil((SELECT count(*) FROM documents) / 5000000.0) AS BIGINT)) AS split FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), l AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * w) AS target,
    CAST('0x' || substr(md5('20240229:' || CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM l
), r AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
    row_number() OVER (PARTITION BY c.source ORDER BY class, split, size, doc_id NULLS FIRST, lot) AS nth FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * least(floor(ratio * nth + u) - floor(ratio * (nth - 1) + u), 3) AS BIGINT) AS taken FROM r
""",
    "op9_chat": r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) + 8 AS tokens,
    6 + length(role) + length(regexp_replace(role, '[^\\<:>\n]', '', 'g')) + 4 + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) + 9 AS chars FROM src
), c AS (
  SELECT conv_id, coalesce(max(tokens) FILTER (WHERE tokens <= 256), 1) AS longest, coalesce(max(tokens) FILTER (WHERE i = 1 AND role = 'system' AND tokens <= 256), 0) AS sys, coalesce(max(chars) FILTER (WHERE i = 1 AND role = 'system' AND tokens <= 256), 0) AS sys_chars FROM t GROUP BY conv_id
), p AS (
  SELECT t.*, sys, sys_chars, least(256, longest * 2) AS room, 1024 - sys - least(256, longest * 2) - longest AS cell,
    sum(tokens) OVER (PARTITION BY t.conv_id ORDER BY i) - tokens AS pos, 2 * sum(CASE WHEN tokens > 256 THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id ORDER BY i) - CASE WHEN tokens > 256 THEN 1 ELSE 0 END AS alone
  FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id
), x AS (SELECT *, pos // cell + alone AS win FROM p),
w AS (SELECT conv_id, win, min(i) AS i1, sum(tokens) AS n, min(pos) AS pos, any_value(sys) AS sys, any_value(sys_chars) AS sys_chars, any_value(room) AS room FROM x GROUP BY conv_id, win),
y AS (SELECT *, sys > 0 AND pos > 0 AND n + sys <= 1024 AS has_sys FROM w),
f AS (
  SELECT y.*, least(y.room, 1024 - n - CASE WHEN has_sys THEN y.sys ELSE 0 END) AS free, a.tokens AS t1, a.chars AS c1, a.i AS a1, b.tokens AS t2, b.chars AS c2, b.i AS a2
  FROM y LEFT JOIN x a ON a.conv_id IS NOT DISTINCT FROM y.conv_id AND a.i = y.i1 - 1 LEFT JOIN x b ON b.conv_id IS NOT DISTINCT FROM y.conv_id AND b.i = y.i1 - 2 AND b.win = a.win
), g AS (SELECT *, coalesce(t1 <= free AND NOT (sys > 0 AND a1 = 1), false) AS k1 FROM f),
h AS (
  SELECT conv_id, count(*) AS n_windows, sum(CASE WHEN has_sys THEN sys_chars ELSE 0 END + CASE WHEN k1 THEN c1 ELSE 0 END + CASE WHEN k1 AND coalesce(t2 <= free - t1 AND NOT (sys > 0 AND a2 = 1), false) THEN c2 ELSE 0 END) AS more FROM g GROUP BY conv_id
), o AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars FROM t GROUP BY conv_id
)
SELECT o.conv_id AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(chars + more AS BIGINT) AS formatted_chars, CAST(n_windows AS BIGINT) AS n_windows
FROM o JOIN h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
""",
    "op10_decontaminate": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), items AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS gram
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0)
), grams AS (
  SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)
), met AS (
  SELECT g.r, g.n, g.i, w.item_id FROM grams g JOIN windows w ON g.n = w.n AND g.gram = w.gram
), hit AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT r, n, i FROM met)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""",
}
