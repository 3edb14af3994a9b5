"""Protocol documents made of the driver's tables, in and out of their controlled vocabulary; passages in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import protocols as P
from quillon.plans.registry import query, table

_TOK = "regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[a-z]{1,}')"


def _pick(n: int, *values: str | None) -> Column:
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.col("doc_id") % n == i, F.lit(v)).otherwise(out)
    return out


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as models write them: drifting vocabulary, with and without the wrapper, some without segments."""
    meta = F.struct(
        _pick(5, "Late Medieval", "19th-Century", "early_modern", "odd era", "null").alias("targetEra"), _pick(4, "Semi-Strict", "academic", "weird", "~").alias("diplomaticProfile"),
        _pick(3, "Normalised", "raw", "none").alias("normalizationMode"), _pick(4, "Latin", "eng", "deu-early_modern", "mixed").alias("targetLanguage"), F.lit("Round-Hand").alias("englishHandwritingModality"),
    )
    segment = F.struct(F.lit(1).alias("segmentId"), F.lit("Main-Body").alias("position"), F.concat(F.lit("a=\n"), F.col("source")).alias("text"), F.lit(" High ").alias("confidence"))
    segments = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<struct<segmentId:int,position:string,text:string,confidence:string>>")).otherwise(F.array(segment))
    body = F.struct(_pick(3, "1.0.0", " v1.1 ", "9").alias("protocolVersion"), meta.alias("metadata"), F.struct(F.lit("proceed").alias("proceedDecision")).alias("preCheck"), segments.alias("segments"))
    whole = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(body.alias("transcriptionOutput")))).otherwise(F.to_json(body))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 13 == 0, '{"other": 1}').otherwise(whole).alias("content"))


@query("""WITH d AS (SELECT *, doc_id % 13 = 0 AS none, CASE doc_id % 5 WHEN 0 THEN 'medieval' WHEN 1 THEN 'nineteenth_century' WHEN 2 THEN 'early_modern' WHEN 3 THEN 'odd era' END AS era FROM documents),
l AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'lat-' || coalesce(era, 'medieval') WHEN 1 THEN 'eng' || coalesce('-' || era, '') WHEN 2 THEN 'deu-early_modern' ELSE 'mixed' END AS language FROM d)
SELECT doc_id, CASE WHEN NOT none THEN CASE doc_id % 3 WHEN 0 THEN '1.0.0' WHEN 1 THEN 'v1.1' ELSE '1.1.0' END END AS version, CASE WHEN NOT none THEN era END AS era,
  CASE WHEN NOT none THEN CASE doc_id % 4 WHEN 0 THEN 'semi_strict' WHEN 1 THEN 'strict' WHEN 2 THEN 'weird' END END AS profile, CASE WHEN NOT none THEN CASE doc_id % 3 WHEN 0 THEN 'normalized' WHEN 1 THEN 'diplomatic' END END AS mode,
  CASE WHEN NOT none THEN language END AS language, CASE WHEN NOT none AND (starts_with(language, 'eng') OR language = 'mixed') THEN 'round_hand' END AS hand,
  CASE WHEN NOT none THEN CASE WHEN doc_id % 7 = 0 THEN 'abort' ELSE 'proceed' END END AS decision, CASE WHEN NOT none AND doc_id % 7 = 0 THEN 'No visible text content.' END AS reason,
  CASE WHEN NOT none AND doc_id % 7 <> 0 THEN 'body/high/' || CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'a=' || chr(10) END || source END AS segment FROM l""")
def protocol_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocol documents in the controlled vocabulary."""
    rows = P.normalized(_documents(spark, sf_dir), ["doc_id"], "content")
    s = F.get("segments", 0)
    return rows.select(
        "doc_id", F.col("protocolVersion").alias("version"), F.col("targetEra").alias("era"), F.col("diplomaticProfile").alias("profile"), F.col("normalizationMode").alias("mode"), F.col("targetLanguage").alias("language"),
        F.col("englishHandwritingModality").alias("hand"), F.col("proceedDecision").alias("decision"), F.col("abortReason").alias("reason"), F.concat(s["position"], F.lit("/"), s["confidence"], F.lit("/"), s["text"]).alias("segment"),
    )


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of segments, many readings uncertain in some."""
    text = F.when(F.col("conv_id") % 3 == 0, F.regexp_replace("text", r"(\S+) (\S+)", "[uncertain: $1 / $2]")).otherwise(F.col("text"))
    part = F.struct(F.col("turn").alias("segmentId"), F.lit(None).cast("int").alias("pageNumber"), F.lit("").alias("lineRange"), F.lit("body").alias("position"), text.alias("text"), F.lit("high").alias("confidence"), F.lit("").alias("notes"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("segments"))
    k = F.col("conv_id")
    return rows.select("conv_id", F.col("segments").cast(P.SEGMENTS).alias("segments"), F.when(k % 2 == 0, "a note of more than twenty characters").alias("notes"), F.when(k % 5 == 0, "Latn").alias("script"), F.when(k % 4 != 0, F.array().cast("array<string>")).alias("mismatches"), F.when(k % 9 == 0, "{}").alias("summary"))


@query(r"""WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN regexp_replace(text, '(\S+) (\S+)', '[uncertain: \1 / \2]', 'g') ELSE text END AS text FROM conversations), j AS (SELECT conv_id, array_to_string(list(coalesce(text, '') ORDER BY turn), ' ') AS x FROM t GROUP BY conv_id),
n AS (SELECT conv_id, len(regexp_extract_all(x, '(?i)\[uncertain:')) AS u, len(regexp_extract_all(regexp_replace(x, '\[uncertain:[^\]]*\]', ' u ', 'g'), '\S+')) AS w FROM j)
SELECT conv_id, CAST(u AS BIGINT) AS n_uncertain, CAST(w AS BIGINT) AS n_words, CASE WHEN conv_id % 9 = 0 THEN '{}' WHEN conv_id % 4 <> 0 THEN '{"passCount":2,"segmentsAltered":0}' END AS pass_summary,
  CASE WHEN conv_id % 2 = 0 THEN 'a note of more than twenty characters' WHEN w > 0 AND u / w > 0.30 THEN 'More than three in ten words could not be read for sure (script: ' || CASE WHEN conv_id % 5 = 0 THEN 'Latn' ELSE 'not named' END || '); they are marked and left as they stand.' END AS notes FROM n""")
def protocol_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary stubs, and notes where uncertain readings flood a document without one."""
    rows = P.fix_up(_turns(spark, sf_dir), "segments", "notes", "script", "mismatches", "summary")
    return rows.select("conv_id", "n_uncertain", "n_words", "pass_summary", "notes")


@query(r"""SELECT conv_id, coalesce(array_to_string(list(regexp_replace(text, '^\s+|\s+$', '', 'g') ORDER BY turn) FILTER (regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''), chr(10) || chr(10)), '') AS text FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id""")
def protocol_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of documents of segments."""
    return _turns(spark, sf_dir).where("conv_id % 3 <> 0").select("conv_id", P.plain_text(F.col("segments")).alias("text"))


@query("""WITH p AS (SELECT conv_id, turn, 'backend ' || turn AS b, CASE WHEN turn % 4 = 3 THEN '[backend ' || turn || '] gave nothing: no model' WHEN trim(text) <> '' THEN '[backend ' || turn || '] ' || len(string_split(text, chr(10))) || ' lines, sure: ' || CASE WHEN turn % 2 = 0 THEN 'high' ELSE '?' END || chr(10) || CASE WHEN length(trim(text)) > 60 THEN left(trim(text), 60) || chr(10) || '(cut here)' ELSE trim(text) END END AS part FROM conversations)
SELECT conv_id, 'Readings by machine, to compare with:' || chr(10) || array_to_string(list(part ORDER BY b), chr(10)) AS hint FROM p WHERE part IS NOT NULL GROUP BY conv_id""")
def draft_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine drafts of a page as one hint, cut at sixty characters."""
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", F.concat(F.lit("backend "), turn.cast("string")).alias("b"), "text", F.size(F.split("text", "\n")).alias("n"), F.when(turn % 2 == 0, "high").alias("tier"), F.when(turn % 4 == 3, "no model").alias("error")
    )
    return P.hints(rows, "conv_id", "b", "text", "n", "tier", "error", 60)


@query(f"""WITH i AS (SELECT item_id, array_to_string({_TOK}, ' ') AS t FROM benchmark WHERE len({_TOK}) >= 5), d AS (SELECT doc_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS w FROM documents)
SELECT item_id, min(doc_id) AS best, count(*) AS n_texts FROM i JOIN d ON contains(w, ' ' || t || ' ') GROUP BY item_id""")
def consensus_passage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the whole passage of a benchmark item."""
    return P.passage_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
