"""Files by listing: images, pairs by stem, manifests, sidecars, reference texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_GLOB = "*.{png,jpg,jpeg,tif,tiff,PNG,JPG,JPEG,TIF,TIFF}"


def listing(spark: SparkSession, path: str, glob: str = "*", recurse: bool = True) -> DataFrame:
    """``path, name, stem, ext, modified, size`` of files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recurse).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        "path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"),
    )


def images(spark: SparkSession, path: str, recurse: bool = True) -> DataFrame:
    return listing(spark, path, IMAGE_GLOB, recurse)


def preferred(files: DataFrame, order: list[str], key: str = "stem", kind: str = "ext") -> DataFrame:
    """One file per key: of the earliest kind in ``order`` (others are left out), then the smallest path."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    ranked = files.where(F.col(kind).isin(order)).groupBy(key)
    return ranked.agg(F.min(F.struct(rank.alias("r"), F.col("path")))["path"].alias("path"))


def latest(files: DataFrame, key: str = "stem") -> DataFrame:
    """The newest file of each key, backup folders aside."""
    kept = files.where(~F.lower("path").rlike(r"/(backup|bak|old)[^/]*/"))
    return kept.groupBy(key).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def pair_by_stem(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stem, path, other`` of files with a partner, and the stems that have none."""
    r = right.select("stem", F.col("path").alias("other"))
    return left.select("stem", "path").join(r, "stem"), left.select("stem").join(r, "stem", "left_anti")


def name_index(files: DataFrame) -> DataFrame:
    """First path of every lower-cased file name."""
    return files.groupBy(F.lower("name").alias("name")).agg(F.min("path").alias("path"))


def checksum_names(lines: DataFrame, column: str) -> DataFrame:
    """``digest, name`` of the lines of a checksum sidecar."""
    parts = F.split(F.col(column), r"\s{2,}| \*", 2)
    return lines.select(parts[0].alias("digest"), F.trim(F.get(parts, 1)).alias("name")).where("name IS NOT NULL")


def first_per_label(texts: DataFrame, label: str, order: str, text: str, most: int = 40, least_chars: int = 200) -> DataFrame:
    """The first ``most`` texts of each label, in order, that are long enough (the rank is limited before the shuffle)."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return texts.where(F.length(text) >= least_chars).withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def manifest_images(docs: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``keys, page_no, url`` of the images of presentation manifests, version 2 (canvases) or 3 (items)."""
    two = F.from_json(content, "sequences array<struct<canvases:array<struct<images:array<struct<resource:struct<`@id`:string>>>>>>>")
    three = F.from_json(content, "items array<struct<items:array<struct<items:array<struct<body:struct<id:string>>>>>>>")
    old = F.transform(two["sequences"][0]["canvases"], lambda c: c["images"][0]["resource"]["@id"])
    new = F.transform(three["items"], lambda c: c["items"][0]["items"][0]["body"]["id"])
    urls = F.filter(F.coalesce(old, new, F.array().cast("array<string>")), lambda u: u.isNotNull())
    return docs.select(*keys, F.posexplode(urls).alias("page_no", "url"))


def split_from_path(path: Column) -> Column:
    """``val`` for test and val folders, ``train`` for train folders, else null; test and val win."""
    parts = F.split(F.lower(path), "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return F.when(has("test", "testing", "val", "valid", "validation", "dev"), "val").when(has("train", "training"), "train")


def resolve_split(mode: Column, upstream: Column) -> Column:
    """Split of a corpus: its fixed mode, what upstream says, or pending until the holdout is drawn."""
    return (
        F.when(mode == "train", "train").when(mode == "val_only", "val")
        .when((mode == "upstream") & upstream.isNotNull(), upstream).otherwise("holdout_pending")
    )


def excluded(path: Column, folders: list[str], tokens: list[str]) -> Column:
    """Whether a path has a skipped folder or token."""
    hit = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders))) if folders else F.lit(False)
    for token in tokens:
        hit = hit | F.lower(path).contains(token)
    return hit
