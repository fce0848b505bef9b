"""The queries of this subpackage with their production parameters, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import rotate_perspectives
from .common import table
from .decontaminate import contamination
from .embedding_dedup import embedding_duplicates
from .html_text import extract_pages
from .language_id import identify
from .lm_score import score_texts
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .secrets import find_secrets
from .substring_dedup import repeated_windows

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5).select("doc_id", "size", "source_size", "target", "taken")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents"), digest_only=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op3_secret_scan": op3_secret_scan,
    "op4_lm_scores": op4_lm_scores,
    "op5_html_extraction": op5_html_extraction,
    "op6_source_mixing": op6_source_mixing,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

_COMPONENTS = """
, reach AS (
  SELECT {id} AS node, {id} AS seen FROM {nodes}
  UNION
  SELECT reach.node, e.b FROM reach JOIN edges e ON e.a = reach.seen
)
"""

OP1_SQL = (
    """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, coalesce(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END, []) AS s
  FROM words
), grams AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS shared
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (n + m - shared)
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
)"""
    + _COMPONENTS.format(id="doc_id", nodes="sets")
    + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
"""
)

OP2_SQL = """
WITH said AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1) // 256 AS part
  FROM (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)
), who AS (
  SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'
), lines AS (
  SELECT s.conv_id, perspective, part, turn, role, text, role = perspective AS own,
    '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
    text || '<|im_end|>' || chr(10) AS body
  FROM said s JOIN who w ON s.conv_id IS NOT DISTINCT FROM w.conv_id
), placed AS (
  SELECT *, row_number() OVER w AS i, CAST(sum(length(head) + length(body)) OVER w AS BIGINT) AS upto FROM lines
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, part, count(*) AS n_turns, CAST(count(*) FILTER (own) AS BIGINT) AS n_own,
  min(upto - length(head) - length(body)) AS start, string_agg(head || body, '' ORDER BY i) AS text,
  coalesce(string_agg((upto - length(body)) || ':' || upto, ',' ORDER BY i) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""

OP7_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), item_windows AS MATERIALIZED (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 13) AS size, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS MATERIALIZED (
  SELECT doc_id, i, x.size, item FROM doc_windows x JOIN item_windows y ON x.win = y.win AND x.size = y.size
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), once AS MATERIALIZED (
  SELECT DISTINCT doc_id, w FROM d
), wins AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM once)
), later AS (
  SELECT doc_id, i FROM wins QUALIFY row(doc_id, i) > min(row(doc_id, i)) OVER (PARTITION BY win)
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), kept AS (
  SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS line
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM once) x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p
  GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10_SQL = (
    """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS MATERIALIZED (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(x, x) > 0
), edges AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.98
)"""
    + _COMPONENTS.format(id="vec_id", nodes="v")
    + """
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM edges GROUP BY a) c ON c.a = v.vec_id
JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON r.node = v.vec_id
"""
)

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op2_chat_perspectives": OP2_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
