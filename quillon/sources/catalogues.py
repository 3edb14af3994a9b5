"""What lies where: formats, ground truth, ALTO directories, manifests of images, catalogue pages, registries, job folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import squeeze
from quillon.operators.ordered import numbered


def sniff(head: Column) -> Column:
    """Format of a document by its first characters: page, alto, tei, xml, or path for anything else."""
    start = F.left(F.coalesce(head, F.lit("")), F.lit(4096))
    return (
        F.when(start.rlike(r"(?i)<(?:\w+:)?PcGts|/PAGE/gts/"), "page").when(start.rlike(r"(?i)<(?:\w+:)?alto\b|/alto/"), "alto")
        .when(start.rlike(r"<(?:\w+:)?TEI\b|tei-c\.org"), "tei").when(start.rlike(r"^\s*<"), "xml").otherwise("path")
    )


def ground_truth(files: DataFrame, folder: str) -> DataFrame:
    """``folder, stem, path, text_path``: a folder's XML documents if it has any, else its images with a ``.gt.txt`` of their stem.

    ``files`` has ``folder, path, name, ext``.
    """
    short = files.withColumn("stem", F.regexp_replace("name", r"(\.gt\.txt|\.[^.]*)$", ""))
    xml = short.where("ext = 'xml'").select(folder, "stem", "path", F.lit(None).cast("string").alias("text_path"))
    texts = short.where(F.col("name").endswith(".gt.txt")).groupBy(folder, "stem").agg(F.min("path").alias("text_path"))
    images = short.where(F.col("ext").isin("png", "jpg", "jpeg", "tif", "tiff")).groupBy(folder, "stem").agg(F.min("path").alias("path"))
    pairs = images.join(texts, [folder, "stem"]).join(xml.select(folder).distinct(), folder, "left_anti")
    return xml.unionByName(pairs.select(folder, "stem", "path", "text_path"))


def line_images(files: DataFrame, order: tuple[str, ...] = (".nrm.png", ".bin.png", ".png")) -> DataFrame:
    """``stem, path``: the preferred image of every line, by the ending of its name; ``files`` has ``name, path``."""
    rank, stem = F.lit(None).cast("int"), F.col("name")
    for i, ending in reversed(list(enumerate(order))):
        rank = F.when(F.col("name").endswith(ending), i).otherwise(rank)
        stem = F.when(F.col("name").endswith(ending), F.left("name", F.length("name") - len(ending))).otherwise(stem)
    rows = files.select(stem.alias("stem"), rank.alias("r"), "path").where("r IS NOT NULL")
    return rows.groupBy("stem").agg(F.min(F.struct("r", "path"))["path"].alias("path"))


def alto_index(files: DataFrame, path: str) -> DataFrame:
    """``ms_id, slug, page_idx, path`` of the XML files of manuscript folders, pages numbered from 0 by path; the slug is the folder's
    name in lower case with other than word characters as underscores."""
    ms = F.regexp_extract(path, r"([^/]+)/[^/]+\.xml$", 1)
    rows = files.select(ms.alias("ms_id"), path).where("ms_id != ''")
    placed = numbered(rows, ["ms_id"], [path], "place")
    return placed.select("ms_id", F.regexp_replace(F.lower("ms_id"), r"[^\w]", "_").alias("slug"), (F.col("place") - 1).cast("int").alias("page_idx"), path)


def manifest_canvases(docs: DataFrame, keys: list[str], content: str, most: int | None = None) -> DataFrame:
    """``keys, page_no, name, url`` of the canvases of presentation manifests of version 2 or 3, in order; the first image of each.
    ``most`` is the feature that takes the first canvases of every manifest."""
    two = F.from_json(content, "sequences array<struct<canvases:array<struct<label:string,images:array<struct<resource:struct<`@id`:string>>>>>>>")
    three = F.from_json(content, "items array<struct<label:map<string,array<string>>,items:array<struct<items:array<struct<body:struct<id:string>>>>>>>")
    name = lambda label: F.get(F.get(F.map_values(label), 0), 0)
    old = F.transform(F.flatten(F.transform(two["sequences"], lambda s: F.coalesce(s["canvases"], F.array()))), lambda c: F.struct(c["label"].alias("name"), c["images"][0]["resource"]["@id"].alias("url")))
    new = F.transform(three["items"], lambda c: F.struct(name(c["label"]).alias("name"), c["items"][0]["items"][0]["body"]["id"].alias("url")))
    pages = F.filter(F.coalesce(old, new, F.array().cast("array<struct<name:string,url:string>>")), lambda p: p["url"].isNotNull())
    pages = F.slice(pages, 1, most) if most is not None else pages
    return docs.select(*keys, F.posexplode(pages).alias("page_no", "p")).select(*keys, "page_no", "p.name", "p.url")


def list_items(html: Column) -> Column:
    """Plain texts of the list items of a page, in order; blank ones are left out."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: squeeze(F.regexp_replace(x, r"<[^>]*>", " "))), lambda x: x != "")


def slugs(pages: DataFrame, html: str, pattern: str) -> DataFrame:
    """Distinct link targets of pages that match a pattern with one group, in order."""
    found = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))).alias("slug"))
    return found.distinct().orderBy("slug")


def catalogue(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Items of a catalogue and local witnesses together; columns that one side lacks are null there."""
    return remote.withColumn("origin", F.lit("catalogue")).unionByName(local.withColumn("origin", F.lit("local")), allowMissingColumns=True)


def book_texts(files: DataFrame, book: str, path: str, text: str, least_words: int = 50) -> DataFrame:
    """``book, n_pages, text``: the pages of a job folder that have enough words, in the order of their names, as one text."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    kept = files.where(words >= least_words).groupBy(book)
    joined = kept.agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.trim(text).alias("t")))).alias("pages"))
    return joined.select(book, F.size("pages").cast("long").alias("n_pages"), F.array_join(F.transform("pages", lambda p: p["t"]), "\n\n").alias("text"))


def split_of_shard(path: Column) -> Column:
    """Split of a dataset shard by its name: ``train-*``, ``test-*`` and ``validation-*`` files, others null."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.startswith("train-"), "train").when(name.rlike("^(test|val|validation)-"), "val")


def image_lines(rows: DataFrame, keys: list[str], image: str, *lines: str) -> DataFrame:
    """``keys, n_bytes, n_lines, lines`` of rows with image bytes (``image.bytes``) and the first line column that is there; rows
    without an image are left out."""
    kept = rows.where(F.octet_length(F.col(f"{image}.bytes")) > 0)
    found = F.coalesce(*[F.col(c) for c in lines])
    return kept.select(*keys, F.octet_length(F.col(f"{image}.bytes")).cast("long").alias("n_bytes"), F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_lines"), found.alias("lines"))


def registry(spark: SparkSession, path: str, schema: str, glob: str = "*.y*ml") -> DataFrame:
    """Rows of a folder of small YAML records under a given schema, with their ``source_path``; malformed ones are left out."""
    from quillon.operators.protocols import yaml_to_json

    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    rows = files.select(F.col("_metadata.file_path").alias("source_path"), F.from_json(yaml_to_json(F.col("value")), schema).alias("r"))
    return rows.where("r IS NOT NULL").select("r.*", "source_path")
