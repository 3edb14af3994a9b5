"""Curation over documents, labels, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import curate as C
from quillon.plans.registry import query, table

_REASON_SQL = """
CASE WHEN NOT lang IN ('en', 'de', 'fr') THEN 'language' WHEN NOT length(text) >= 200 THEN 'too_short' WHEN quality IS NULL THEN 'unrated'
  WHEN NOT quality >= 1 THEN 'low_quality' WHEN NOT toxic = 0 THEN 'toxic' ELSE 'ok' END"""


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    checks = [
        ("language", F.col("lang").isin("en", "de", "fr")),
        ("too_short", F.length("text") >= 200),
        ("unrated", F.col("quality").isNotNull()),
        ("low_quality", F.col("quality") >= 1),
        ("toxic", F.col("toxic") == 0),
    ]
    return docs.select("doc_id", C.first_failing_reason(checks).alias("reason"))


@query(f"SELECT doc_id, {_REASON_SQL} AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def profile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(spark, sf_dir)


@query(f"""SELECT {_REASON_SQL} AS reason, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id)
WHERE {_REASON_SQL} <> 'ok' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reject_histogram(_profiled(spark, sf_dir), "reason")


_PRIORITY = {"src0": 1, "src1": 2, "src2": 3}


@query("""
WITH r AS (SELECT sha256(text) AS k, CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 WHEN 'src2' THEN 3 ELSE 4 END AS rank, doc_id FROM documents)
SELECT arg_min(doc_id, (rank, doc_id)) AS doc_id, CAST(min(rank) AS BIGINT) AS rank, count(*) AS copies FROM r GROUP BY k
""")
def priority_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return C.priority_dedupe(docs, F.sha2("text", 256), _PRIORITY, "source", "doc_id")


@query("SELECT min(doc_id) AS doc_id, 1::BIGINT AS rank, count(*) AS copies FROM documents GROUP BY sha256(text)")
def first_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.priority_dedupe(table(spark, sf_dir, "documents"), F.sha2("text", 256), {}, "source", "doc_id")


_PLACE = "row_number() OVER (PARTITION BY source ORDER BY md5('{seed}|' || doc_id), doc_id)"


@query(f"""
WITH r AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, {_PLACE.format(seed='s1')} AS p FROM documents)
SELECT source, doc_id, CASE WHEN p <= CASE WHEN n > 1 THEN least(greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT)), n - 1) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM r
""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_rows(table(spark, sf_dir, "documents"), "source", "doc_id", 0.1, seed="s1", singletons="train")


@query(f"""
WITH r AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, {_PLACE.format(seed='s2')} AS p FROM documents)
SELECT source, doc_id, CASE WHEN p <= greatest(1, CAST(floor(n * 0.05::DOUBLE) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM r
""")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_rows(table(spark, sf_dir, "documents"), "source", "doc_id", 0.05, seed="s2", singletons="val")


@query("""
SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr
FROM documents GROUP BY source
""")
def manifest_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count()
    return counts.na.fill(0)


@query("SELECT ch, count(*) AS count FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def char_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.char_coverage(table(spark, sf_dir, "documents"), "text")


@query(r"""
WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' AND NOT regexp_matches(ch, '^\s*$') GROUP BY ALL)
SELECT ch, CAST(unicode(ch) AS BIGINT) AS code_point, CAST(sum(n) AS BIGINT) AS n_chars,
  array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 8), ',') AS examples
FROM c GROUP BY ch HAVING sum(n) < 500
""")
def rare_char_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rare_char_rows(table(spark, sf_dir, "documents"), "doc_id", "text", 500)


@query("""
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
""")
def review_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(done, "doc_id", "left_anti")


@query("""
SELECT doc_id, 'label' AS origin FROM labels WHERE quality = 1
UNION ALL SELECT doc_id, 'rule' FROM documents WHERE length(text) >= 1000 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
""")
def adjudicated_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("label").alias("origin"))
    sure = table(spark, sf_dir, "documents").where(F.length("text") >= 1000).select("doc_id", F.lit("rule").alias("origin"))
    return C.adjudicated_union(decided, sure, ["doc_id"])


@query("""
WITH a AS (SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS best_run, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst_run,
  round(max(o_totalprice) - min(o_totalprice), 4) AS gap, count(*) AS n_runs FROM orders GROUP BY o_custkey)
SELECT *, CASE WHEN gap >= 50000 THEN 'high' WHEN gap >= 5000 THEN 'medium' ELSE 'low' END AS priority FROM a
""")
def best_worst_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_worst(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@query("""
WITH r AS (SELECT user_id, event_type, ts, event_id, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, event_type, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM r)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS length FROM i GROUP BY user_id, island
""")
def segments_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.islands(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
SELECT event_id, user_id, anchor FROM (
  SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM events
) WHERE event_type = 'purchase'
""")
def asof_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every purchase the user's last view before it."""
    events = table(spark, sf_dir, "events")
    found = C.asof_last(events, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "view", "event_id")
    return found.select("event_id", "user_id", "anchor")


@query("""
WITH p AS (SELECT CAST(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS BIGINT) AS d FROM lineitem),
c AS (SELECT d, count(*) AS n FROM p GROUP BY d),
i AS (SELECT o_orderkey, CAST(date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) AS BIGINT) AS lo FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, CAST(sum(n) AS BIGINT) AS n_points FROM i JOIN c ON d BETWEEN lo AND lo + 2 GROUP BY o_orderkey
""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped within three days of each filled order."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    points = table(spark, sf_dir, "lineitem").select(day("l_shipdate").alias("d"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", day("o_orderdate").alias("lo"))
    return C.interval_counts(points, orders.withColumn("hi", F.col("lo") + 2), "d", "o_orderkey", "lo", "hi", 32)


@query("""
WITH r AS (SELECT l_orderkey, l_discount * 1000 AS s, l_discount * 1000 + l_quantity AS e FROM lineitem),
q AS (SELECT l_orderkey, quantile_cont(s, 0.25) AS q1, quantile_cont(e, 0.75) AS q3, quantile_cont(e - s, 0.5) AS mid, count(*) AS n FROM r GROUP BY l_orderkey)
SELECT l_orderkey, count(*) AS n_items, count(*) FILTER (n >= 4 AND e - s < 0.35::DOUBLE * mid AND (e < q1 OR s > q3)) AS n_margin FROM r JOIN q USING (l_orderkey) GROUP BY l_orderkey
""")
def margin_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order taken as page lines from the discount on, as long as the quantity."""
    start = F.col("l_discount") * 1000
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("s"), (start + F.col("l_quantity")).alias("e"))
    return C.margin_outliers(rows, "l_orderkey", "s", "e")


@query("""
SELECT conv_id, count(*) AS n_pages, string_agg('== page ' || turn || ' ==' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) AS document FROM conversations GROUP BY conv_id
""")
def combined_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined in order under page headers."""
    page = F.concat(F.lit("== page "), F.col("turn").cast("string"), F.lit(" ==\n"), F.col("text"))
    pages = F.array_sort(F.collect_list(F.struct("turn", "text", page.alias("page"))))
    joined = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_pages"), pages.alias("p"))
    return joined.select("conv_id", "n_pages", F.array_join(F.transform("p", lambda x: x["page"]), "\n\n").alias("document"))
