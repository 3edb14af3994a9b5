"""Record joins and projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import records as R
from quillon.plans.registry import query, table
from quillon.sources import files


@query("""
WITH l AS (SELECT DISTINCT p_brand AS stem FROM part), r AS (SELECT DISTINCT 'Brand#' || (s_suppkey % 23) AS r_stem, 'gt/' || (s_suppkey % 23) AS path FROM supplier),
e AS (SELECT stem, path, 'exact' AS how FROM l JOIN r ON stem = r_stem),
p AS (SELECT stem, min(path) AS path, 'prefix' AS how FROM l JOIN r ON starts_with(stem, r_stem) OR starts_with(r_stem, stem) WHERE stem NOT IN (SELECT stem FROM e) GROUP BY stem)
SELECT * FROM e UNION ALL SELECT * FROM p
""")
def stem_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "part").select(F.col("p_brand").alias("stem")).distinct()
    number = (F.col("s_suppkey") % 23).cast("string")
    right = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), number).alias("stem"), F.concat(F.lit("gt/"), number).alias("path")).distinct()
    return R.match_stems(left, right, "stem", "path")


@query("""
WITH h AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT o_orderkey, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(h.o_orderkey, r.o_orderkey) AS o_orderkey, CASE WHEN h.v IS NULL THEN 'append' WHEN r.v IS NULL THEN 'delete' ELSE 'update' END AS action, r.v AS v
FROM h FULL JOIN r ON h.o_orderkey = r.o_orderkey
""")
def correction_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    refs = orders.where("o_orderkey % 5 <> 0").withColumn("v", F.col("v") + 1)
    return R.corrections(orders.where("o_orderkey % 3 <> 0"), refs, "o_orderkey", "v")


@query("""
SELECT doc_id, lang, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM documents WHERE length(text) >= 200) WHERE p <= 40
""")
def reference_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty long enough texts of every language."""
    found = files.first_per_label(table(spark, sf_dir, "documents"), "lang", "doc_id", "text")
    return found.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"))


@query("""
WITH p AS (SELECT doc_id, source || CASE doc_id % 4 WHEN 0 THEN '/Train/' WHEN 1 THEN '/test/x/' WHEN 2 THEN '/val/train/' ELSE '/misc/' END || doc_id AS path FROM documents)
SELECT doc_id, path, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'val' END AS split FROM p
""")
def split_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    folder = F.when(k == 0, "/Train/").when(k == 1, "/test/x/").when(k == 2, "/val/train/").otherwise("/misc/")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", folder, F.col("doc_id").cast("string")).alias("path"))
    return rows.withColumn("split", files.split_from_path(F.col("path")))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each kind and user."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type")
    return rows.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations)
SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) AS segment_id FROM l
""")
def merge_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode_outer(F.split("text", "\n")).alias("n", "line"))
    return R.renumber(rows, "conv_id", ["turn", "n"]).drop("n")


@query("""
WITH l AS (SELECT page_id, unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10))) AS line FROM pages), c AS (
SELECT page_id, count(*) AS before, count(*) FILTER (length(trim(line)) > 0) AS after FROM l GROUP BY page_id)
SELECT page_id, before, after, round(1 - after / before, 6) AS drop_ratio, after > 0 AS kept FROM c
""")
def keep_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text between the tags of raw pages, blank lines dropped."""
    lines = F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n")
    return R.keep_with_text(table(spark, sf_dir, "pages").select("page_id", F.explode_outer(lines).alias("line")), "page_id", "line")


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a successful result."""
    jobs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return R.pending(jobs, table(spark, sf_dir, "labels"), "doc_id", F.expr("quality = 1 AND toxic = 0"))


@query("""
SELECT manifest, count(*) AS n FROM (
  SELECT 'all' AS manifest FROM documents UNION ALL SELECT 'english' FROM documents WHERE lang = 'en' UNION ALL SELECT 'long' FROM documents WHERE n_chars > 2000
  UNION ALL SELECT 'long_english' FROM documents WHERE lang = 'en' AND n_chars > 2000) GROUP BY manifest
""")
def phased_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of overlapping subsets."""
    english, long = F.col("lang") == "en", F.col("n_chars") > 2000
    rules = {"all": F.lit(True), "english": english, "long": long, "long_english": english & long}
    rows = R.phases(table(spark, sf_dir, "documents").select("lang", "n_chars"), rules)
    return rows.groupBy("manifest").agg(F.count("*").alias("n"))


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share, round(max(value), 4) AS longest FROM events GROUP BY event_type
""")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage sums, their share of the whole, and the longest."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("t"), F.max("value").alias("m"))
    whole = rows.agg(F.sum("t")).first()[0] or 1.0
    return rows.select("event_type", "n", F.round("t", 4).alias("total"), F.round(F.col("t") / whole, 6).alias("share"), F.round("m", 4).alias("longest"))


@query("""
WITH l AS (SELECT page_id, unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10))) AS line FROM pages), c AS (
SELECT page_id, count(*) AS before, count(*) FILTER (length(trim(line)) > 0) AS after FROM l GROUP BY page_id)
SELECT page_id % 7 AS folder, count(*) AS n_files, count(*) FILTER (after > 0) AS n_kept, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after, round(1 - sum(after) / sum(before), 6) AS drop_ratio FROM c GROUP BY 1
""")
def folder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept by folder, seven made-up folders of raw pages."""
    rows = keep_with_text(spark, sf_dir)
    return R.folder_stats(rows.withColumn("folder", F.col("page_id") % 7), "folder")


@query("""SELECT conv_id, count(*) AS n_pages, string_agg('== page ' || turn || ' ==' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS document,
coalesce(string_agg('== page ' || turn || ' ==' || chr(10) || reverse(text), chr(10) || chr(10) ORDER BY turn) FILTER (turn % 2 = 0), '') AS translated FROM conversations GROUP BY conv_id""")
def translated_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, with the twin of the turns that have a made-up translation."""
    rows = table(spark, sf_dir, "conversations").withColumn("tr", F.when(F.col("turn") % 2 == 0, F.reverse("text")))
    return R.combined(rows, "conv_id", "turn", "text", "tr")


@query("""SELECT s_suppkey AS name, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 0.1::DOUBLE END, CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE END) AS a, CASE WHEN s_suppkey % 2 = 0 THEN 0.25::DOUBLE END AS b FROM supplier""")
def merged_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rates of two corpora, one of them measured again for some models."""
    k, rows = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    old = F.when(k % 2 == 0, F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.25)))
    fresh = rows.select(k.alias("name"), F.lit("a").alias("corpus"), F.when(k % 3 == 0, 0.1).alias("rate"))
    merged = R.merge_rates(rows.select(k.alias("name"), old.alias("per_corpus")), fresh, "name", "corpus", "rate")
    return merged.select("name", F.col("per_corpus")["a"].alias("a"), F.col("per_corpus")["b"].alias("b"))


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS page, l_linenumber - 1 AS hyp_no FROM lineitem WHERE l_linenumber <= 4), r AS (SELECT DISTINCT l_orderkey AS page, l_linenumber - 1 AS ref_no FROM lineitem),
p AS (SELECT page, hyp_no, hyp_no + 1 AS ref_no FROM h WHERE hyp_no % 2 = 0 AND (page, hyp_no + 1) IN (SELECT page, ref_no FROM r)),
b AS (SELECT coalesce(h.page, r.page) AS page, hyp_no, r.ref_no FROM (SELECT h.*, p.ref_no FROM h LEFT JOIN p USING (page, hyp_no)) h FULL JOIN r ON h.page = r.page AND h.ref_no = r.ref_no)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY hyp_no NULLS LAST, ref_no) - 1 AS line_no, CASE WHEN hyp_no IS NULL THEN 'append' ELSE 'update' END AS action, 'r' || ref_no AS points FROM b WHERE ref_no IS NOT NULL""")
def line_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of made-up pages after correction by their references."""
    lines, n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct(), F.col("l_linenumber") - 1
    hyps = lines.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("page"), n.alias("line_no"))
    refs = lines.select(F.col("l_orderkey").alias("page"), n.alias("line_no"), F.concat(F.lit("r"), n.cast("string")).alias("points"))
    there = refs.select("page", F.col("line_no").alias("ref_no"))
    pairs = hyps.where("line_no % 2 = 0").select("page", F.col("line_no").alias("hyp_no"), (F.col("line_no") + 1).alias("ref_no")).join(there, ["page", "ref_no"])
    rows = R.corrected_lines(pairs, hyps, refs, "page")
    return rows.select("page", F.col("line_no").cast("long").alias("line_no"), "action", "points")
