"""Queries that are SQL text over the registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.functions.sql import register
from quillon.plans.registry import query, table


def _sql(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    rows = table(register(spark), sf_dir, name)
    return spark.sql(text, rows=rows)


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(replace(strip_accents(lower(coalesce(text, ''))), 'ß', ' '), '[a-z]{2,}') AS w FROM documents),
n AS (SELECT *, len(w) AS n FROM w WHERE len(w) >= 120),
z AS (SELECT *, CASE WHEN n < 500 THEN greatest(80, n // 3) WHEN n < 1500 THEN 250 ELSE 400 END AS size, CASE WHEN n < 500 THEN greatest(40, n // 6) WHEN n < 1500 THEN 150 ELSE 250 END AS step FROM n),
s AS (SELECT *, unnest(list_filter(range(0, n, step), lambda s, i: i = 1 OR least(size, n - s) >= greatest(80, size / 2.0))) AS s FROM z)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS slice_no, CAST(len(w[s + 1:s + size]) AS INTEGER) AS n_words, CAST(len(list_distinct(w[s + 1:s + size])) AS INTEGER) AS n_types FROM s
""")
def sql_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling slices by a lateral join with their words and types."""
    return _sql(spark, sf_dir, "documents", """
        SELECT d.doc_id, s.slice_no, size(s.words) AS n_words, size(array_distinct(s.words)) AS n_types
        FROM (SELECT doc_id, word_slices(word_list(text)) AS found FROM {rows}) d, LATERAL inline_outer(d.found) s WHERE s.slice_no IS NOT NULL""")  # fmt: skip


@query(r"""
SELECT conv_id, turn, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, nullif(unnest(string_split(text, chr(10))), '') AS text, 2::INTEGER AS n_points FROM conversations
""")
def sql_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as PAGE documents, shredded by the table function."""
    return _sql(spark, sf_dir, "conversations", r"""
        SELECT c.conv_id, c.turn, p.line_no, p.text, p.n_points
        FROM (SELECT *, concat('<PcGts xmlns="http://schema"><Page><TextRegion id="r">', array_join(transform(split(safe, '\n'),
          (x, i) -> concat('<TextLine id="l', i, '"><Coords points="0,0 9,9"/><TextEquiv><Unicode>', x, '</Unicode></TextEquiv></TextLine>')), ''),
          '</TextRegion></Page></PcGts>') AS content FROM (SELECT conv_id, turn, escape_xml(text) AS safe FROM {rows})) c, LATERAL page_rows(c.content) p""")  # fmt: skip


@query(r"""
WITH f AS (SELECT p_partkey, strip_accents(lower(p_name)) AS a, strip_accents(lower(p_brand)) AS b, p_type, p_size FROM part)
SELECT p_partkey, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0 ELSE levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS error,
  CASE WHEN p_size / 10.0 < 1 AND p_size / 10.0 < 2 THEN 'PASS' WHEN p_size / 10.0 < 3 AND p_size / 10.0 < 5 THEN 'COND_PASS' ELSE 'FAIL' END AS disposition,
  CASE WHEN p_size / 50.0::DOUBLE >= 0.9::DOUBLE THEN 'high' WHEN p_size / 50.0::DOUBLE >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END AS tier,
  coalesce(nullif(left(regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 120), ''), 'job') AS id FROM f
""")
def sql_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over parts."""
    return _sql(spark, sf_dir, "part", """
        SELECT p_partkey, round(line_error(fold_text(p_name), fold_text(p_brand)), 6) AS error, disposition(p_size / 10, p_size / 10) AS disposition,
          confidence_tier(p_size / 50) AS tier, safe_id(p_type) AS id FROM {rows}""")  # fmt: skip
