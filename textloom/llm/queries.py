"""Queries opN_<name> over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .url_trust import oracle_sql as url_sql

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(read(spark, sf_dir, "documents"))


def op2_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_trust import url_trust

    out = url_trust(read(spark, sf_dir, "pages"))
    return out.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.col("text").alias("kept_text"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", F.size("draws").alias("draws"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann_forest import nearest_neighbours

    return nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_shards import token_shards

    return token_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_near_dedup, op2_url_trust, op3_toxicity, op4_line_dedup, op5_suffix_dedup, op6_mixing, op7_nearest, op8_token_shards, op9_bpe, op10_exact_dedup)}

SQL: dict[str, str] = {
    "op2_url_trust": url_sql(),
    # A line goes if it lies in a run that occurs at an earlier place: 3 nonblank lines in a row, or 1 or 2 of more than 50
    # words; places by (doc_id, position).
    "op4_line_dedup": r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
nonblank AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM line WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')),
ahead AS (
  SELECT *, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(n, 1) OVER w AS n2
  FROM nonblank WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (
  SELECT doc_id, p, [i] AS spots, [line] AS lines FROM ahead WHERE n > 50
  UNION ALL SELECT doc_id, p, [i, i2], [line, line2] FROM ahead WHERE i2 IS NOT NULL AND n + n2 > 50
  UNION ALL SELECT doc_id, p, [i, i2, i3], [line, line2, line3] FROM ahead WHERE i3 IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY lines ORDER BY doc_id, p) AS nth FROM run),
gone AS (SELECT DISTINCT doc_id, unnest(spots) AS i FROM placed WHERE nth > 1),
kept AS (
  SELECT line.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(line.line, chr(10) ORDER BY line.i) FILTER (WHERE gone.i IS NULL), '') AS kept_text
  FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i GROUP BY line.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept_text FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
""",
    # Texts as hexadecimal digits; a byte goes if a string of 50 bytes over it starts in a document with a smaller doc_id.
    "op5_suffix_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS owner, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS h FROM documents),
gram AS (SELECT row, owner, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT row, owner, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
least AS (SELECT g, min(owner) AS least FROM gram GROUP BY g HAVING count(*) > 1),
lost AS (SELECT row, i, i - lag(i) OVER (PARTITION BY row ORDER BY i) AS step FROM gram JOIN least USING (g) WHERE least < owner),
span AS (SELECT row, min(i) AS a, max(i) + 50 AS b FROM (SELECT row, i, count(*) FILTER (WHERE step IS NULL OR step > 50) OVER (PARTITION BY row ORDER BY i) AS island FROM lost) GROUP BY row, island),
gap AS (SELECT row, lag(b, 1, 0) OVER (PARTITION BY row ORDER BY a) AS x, a AS y FROM span UNION ALL SELECT row, max(b), NULL FROM span GROUP BY row),
kept AS (SELECT row, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, length(h) // 2) - x)), '' ORDER BY x) AS h FROM gap JOIN d USING (row) GROUP BY row),
gone AS (SELECT row, sum(b - a)::BIGINT AS n, count(*) AS spans FROM span GROUP BY row)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone USING (row) LEFT JOIN kept USING (row)
""",
    "op10_exact_dedup": r"""
WITH norm AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
ranked AS (
  SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    row_number() OVER (PARTITION BY text_sha256, doc_id) AS nth, text_sha256
  FROM norm WINDOW g AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND nth = 1 AS kept, text_sha256 FROM ranked
""",
}
