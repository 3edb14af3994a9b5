"""Listings, formats, manifests and catalogue pages over stand-ins made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import query, table
from quillon.sources import catalogues as S
from quillon.sources import layout as L


@query("""SELECT 'page' AS kind, 'page' AS format, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'alto', 'alto', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'tei', 'tei', count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'html', CASE WHEN regexp_matches(html, '^\\s*<') THEN 'xml' ELSE 'path' END, count(*) FROM pages GROUP BY ALL""".replace("\\\\", "\\"))
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of documents that were made in three of them, and of raw pages."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit("body").alias("position"))
    made = {
        "page": L.build_page(turns, ["conv_id"], "turn", "text").select("content"), "alto": L.build_alto(turns, ["conv_id"], "turn", "text").select("content"),
        "tei": L.render_tei(turns, ["conv_id"], "turn", "position", "text").select(F.col("tei").alias("content")), "html": table(spark, sf_dir, "pages").select(F.col("html").alias("content")),
    }
    rows = None
    for kind, df in made.items():
        part = df.select(F.lit(kind).alias("kind"), S.sniff(F.col("content")).alias("format"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("kind", "format").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, doc_id % 10 AS folder FROM documents)
SELECT folder, 'd' || doc_id AS stem, 'f' || folder || '/d' || doc_id || '.xml' AS path, NULL::VARCHAR AS text_path FROM d WHERE folder IN (0, 1) AND doc_id % 4 < 2
UNION ALL SELECT folder, 'd' || doc_id, 'f' || folder || '/d' || doc_id || '.png', 'f' || folder || '/d' || doc_id || '.gt.txt' FROM d WHERE folder NOT IN (0, 1) AND doc_id % 3 <> 0""")
def ground_truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with XML documents, and folders of images with texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).alias("folder"))
    k, xml = F.col("doc_id"), F.col("folder").isin(0, 1)
    endings = F.array_compact(F.array(F.when(xml & (k % 4 < 2), ".xml"), F.lit(".png"), F.when(k % 3 != 0, ".gt.txt")))
    name = F.concat(F.lit("d"), k.cast("string"), F.col("e"))
    files = d.withColumn("e", F.explode(endings)).select("folder", name.alias("name"), F.concat(F.lit("f"), F.col("folder").cast("string"), F.lit("/"), name).alias("path"), F.regexp_extract("e", r"([^.]*)$", 1).alias("ext"))
    return S.ground_truth(files, "folder")


@query("""SELECT 'l' || doc_id AS stem, 'p/l' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.nrm.png' WHEN doc_id % 3 = 1 THEN '.bin.png' ELSE '.png' END AS path FROM documents""")
def preferred_line_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line images in up to three forms, the normalised one first."""
    k = F.col("doc_id")
    forms = F.when(k % 3 == 0, F.array(F.lit(".bin.png"), F.lit(".nrm.png"))).when(k % 3 == 1, F.array(F.lit(".png"), F.lit(".bin.png"))).otherwise(F.array(F.lit(".png"), F.lit(".txt")))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("l"), k.cast("string")).alias("s"), F.explode(forms).alias("e"))
    name = F.concat("s", "e")
    return S.line_images(rows.select(name.alias("name"), F.concat(F.lit("p/"), name).alias("path")))


@query(r"""WITH f AS (SELECT 'MS ' || source || '-' || lang AS ms_id, '/alto/MS ' || source || '-' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.xml' AS path FROM documents WHERE lang IS NOT NULL)
SELECT ms_id, regexp_replace(lower(ms_id), '[^\w]', '_', 'g') AS slug, CAST(row_number() OVER (PARTITION BY ms_id ORDER BY path) - 1 AS INT) AS page_idx, path FROM f""")
def alto_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of manuscript folders, numbered."""
    ms = F.concat(F.lit("MS "), "source", F.lit("-"), "lang")
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return S.alto_index(rows.select(F.concat(F.lit("/alto/"), ms, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".xml")).alias("path")), "path")


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS page_no, 'f. ' || turn AS name, 'http://x/' || conv_id || '/' || turn AS url FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3""")
def manifest_canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three canvases of manifests of either version, made of conversations."""
    url = F.concat(F.lit("http://x/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    name = F.concat(F.lit("f. "), F.col("turn").cast("string"))
    old = F.struct(name.alias("label"), F.array(F.struct(F.struct(url.alias("@id")).alias("resource"))).alias("images"))
    new = F.struct(F.create_map(F.lit("none"), F.array(name)).alias("label"), F.array(F.struct(F.array(F.struct(F.struct(url.alias("id")).alias("body"))).alias("items"))).alias("items"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", old.alias("old"), new.alias("new")).groupBy("conv_id")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", F.to_json(c).alias("j")))), lambda x: x["j"])
    joined = rows.agg(listed("old").alias("o"), listed("new").alias("n"))
    two = F.concat(F.lit('{"sequences":[{"canvases":['), F.array_join("o", ","), F.lit("]}]}"))
    three = F.concat(F.lit('{"items":['), F.array_join("n", ","), F.lit("]}"))
    docs = joined.select("conv_id", F.when(F.col("conv_id") % 2 == 0, two).otherwise(three).alias("content"))
    return S.manifest_canvases(docs, ["conv_id"], "content", 3)


@query(r"""WITH l AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS x FROM pages)
SELECT page_id, CAST(len(x) AS BIGINT) AS n_items, array_to_string(x, '|') AS items FROM l""")
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items of raw pages."""
    rows = table(spark, sf_dir, "pages").select("page_id", S.list_items(F.col("html")).alias("x"))
    return rows.select("page_id", F.size("x").cast("long").alias("n_items"), F.array_join("x", "|").alias("items"))


@query(r"""SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/?([A-Za-z0-9_/-]+)', 1)) AS slug FROM pages""")
def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets of raw pages."""
    return S.slugs(table(spark, sf_dir, "pages"), "html", 'href="/?([A-Za-z0-9_/-]+)')


@query("""SELECT s_suppkey AS id, s_name AS shelfmark, CAST(s_nationkey AS INT) AS nation, 'catalogue' AS origin FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, 'local' FROM customer""")
def catalogue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("shelfmark"), F.col("s_nationkey").cast("int").alias("nation"))
    return S.catalogue(remote, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("shelfmark")))


@query(r"""WITH w AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, count(*) AS n_pages, array_to_string(list(trim(text) ORDER BY 't' || lpad(CAST(turn AS VARCHAR), 4, '0')), chr(10) || chr(10)) AS text FROM w WHERE n >= 12 GROUP BY conv_id""")
def book_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as job folders, turns of twelve words or more as pages."""
    rows = table(spark, sf_dir, "conversations").withColumn("path", F.concat(F.lit("t"), F.lpad(F.col("turn").cast("string"), 4, "0")))
    return S.book_texts(rows, "conv_id", "path", "text", 12)


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'val' END AS split FROM documents""")
def shard_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.when(k % 4 == 0, "train").when(k % 4 == 1, "test").when(k % 4 == 2, "validation").otherwise("README")
    return table(spark, sf_dir, "documents").select("doc_id", S.split_of_shard(F.concat(F.lit("/hub/train-set/"), name, F.lit("-00001.parquet"))).alias("split"))
