"""Joins and projections over document records: stem matches, corrections, first texts, renumbering, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordered import numbered


def match_stems(left: DataFrame, right: DataFrame, stem: str, path: str) -> DataFrame:
    """Every left stem with the right path of the same stem, else of the smallest path whose stem starts with it or
    with which it starts; left stems without either are dropped.

    The prefix rule is an equi-join: each side gives all its prefixes, from the shortest stem on.
    """
    r = right.groupBy(F.col(stem).alias("r_stem")).agg(F.min(path).alias(path))
    exact = left.join(r, left[stem] == r["r_stem"]).select(left[stem], path, F.lit("exact").alias("how"))
    rest = left.join(r, left[stem] == r["r_stem"], "left_anti")
    least = F.lit(1)
    prefixes = lambda c: F.explode_outer(F.transform(F.sequence(least, F.length(c)), lambda n: F.left(c, n)))
    down = rest.select(stem, prefixes(F.col(stem)).alias("p")).join(r, F.col("p") == F.col("r_stem")).select(stem, path)
    up = r.select("r_stem", path, prefixes(F.col("r_stem")).alias("p")).join(rest, F.col("p") == F.col(stem)).select(stem, path)
    near = down.unionByName(up).groupBy(stem).agg(F.min(path).alias(path), F.lit("prefix").alias("how"))
    return exact.unionByName(near.select(stem, path, "how"))


def corrections(hypotheses: DataFrame, references: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer correction: matched rows take the reference, lone hypotheses go, lone references are added."""
    h = hypotheses.select(F.col(key), F.col(value).alias("old"))
    r = references.select(F.col(key), F.col(value).alias("new"))
    action = F.when(F.col("old").isNull(), "append").when(F.col("new").isNull(), "delete").otherwise("update")
    return h.join(r, key, "full_outer").select(key, action.alias("action"), F.col("new").alias(value))


def first_text(*columns: Column) -> Column:
    """The first column that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def language_union(*columns: Column) -> Column:
    """Distinct trimmed lower-case codes of array columns, sorted."""
    whole = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns])
    return F.array_sort(F.array_distinct(F.filter(F.transform(whole, lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def renumber(rows: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """``segment_id`` from 1 through all pages of a document."""
    return numbered(rows, [doc], order, "segment_id")


def keep_with_text(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """Lines before and after blank ones are dropped, with the drop ratio; documents left without lines are not kept."""
    full = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    agg = rows.groupBy(doc).agg(F.count("*").alias("before"), F.count_if(full).alias("after"))
    ratio = F.round(1 - F.col("after") / F.col("before"), 6)
    return agg.select(doc, "before", "after", ratio.alias("drop_ratio"), (F.col("after") > 0).alias("kept"))


def pending(jobs: DataFrame, results: DataFrame, key: str, ok: Column) -> DataFrame:
    """Jobs without a successful result."""
    return jobs.join(results.where(ok).select(key).distinct(), key, "left_anti")


def phases(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per manifest that a row belongs to (subsets may overlap)."""
    names = F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("manifest", F.explode_outer(names)).where(F.col("manifest").isNotNull())


def regions_with_text(regions: Column) -> Column:
    """Regions (structs with an array ``TextLine`` of structs with ``TextEquiv.Unicode``) with their blank lines dropped, and
    without those that have none left."""
    full = lambda t: F.length(F.trim(F.coalesce(t["TextEquiv"]["Unicode"], F.lit("")))) > 0
    kept = F.transform(regions, lambda r: r.withField("TextLine", F.filter(F.coalesce(r["TextLine"], F.array()), full)))
    return F.filter(kept, lambda r: F.size(r["TextLine"]) > 0)


def folder_stats(files: DataFrame, folder: str) -> DataFrame:
    """Totals of :func:`keep_with_text` rows by folder: files, kept files, lines before and after, and the share dropped (0 without
    lines)."""
    rows = files.groupBy(folder).agg(F.count("*").alias("n_files"), F.count_if("kept").alias("n_kept"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    return rows.withColumn("drop_ratio", F.when(F.col("before") > 0, F.round(1 - F.col("after") / F.col("before"), 6)).otherwise(F.lit(0.0)))


def combined(pages: DataFrame, doc: str, page: str, text: str, translation: str | None = None) -> DataFrame:
    """``doc, n_pages, document`` with pages in order under their headers, and the twin ``translated`` of those that have a
    translation."""
    part = lambda c: F.concat(F.lit("== page "), F.col(page).cast("string"), F.lit(" ==\n"), F.col(c))
    sides = [F.struct(F.col(page).alias("o"), part(c).alias("x")) for c in ([text, translation] if translation else [text])]
    lists = [F.array_sort(F.collect_list(F.when(s["x"].isNotNull(), s))).alias(n) for s, n in zip(sides, ("d", "t"), strict=False)]
    rows = pages.groupBy(doc).agg(F.count("*").alias("n_pages"), *lists)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["x"]), "\n\n")
    twin = [joined("t").alias("translated")] if translation else []
    return rows.select(doc, "n_pages", joined("d").alias("document"), *twin)


def usable_pairs(pages: DataFrame, key: str, n_baselines: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages that have a baseline and an image, and the largest number of lines on one of them (1 at least), as one row."""
    rows = pages.where(F.col(n_baselines) >= 1).join(images.select(key).distinct(), key, "left_semi")
    return rows, rows.agg(F.greatest(F.lit(1), F.coalesce(F.max(n_baselines), F.lit(1))).cast("long").alias("max_lines"))


def merge_rates(registry: DataFrame, measured: DataFrame, name: str, corpus: str, rate: str) -> DataFrame:
    """Registry rows (``name, per_corpus`` map) with newly measured rates put in; a corpus that could not be measured keeps its old
    rate."""
    fresh = measured.where(F.col(rate).isNotNull()).groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct(corpus, rate))).alias("_fresh"))
    none = F.create_map().cast("map<string,double>")
    old, new = F.coalesce("per_corpus", none), F.coalesce("_fresh", none)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return registry.join(fresh, name, "left").withColumn("per_corpus", F.map_concat(kept, new)).drop("_fresh")


def corrected_lines(pairs: DataFrame, hypotheses: DataFrame, references: DataFrame, page: str) -> DataFrame:
    """Lines of a page after correction: matched hypotheses (``pairs``: ``page, hyp_no, ref_no``) take the reference's points and keep
    their number, others go, references without a match are added behind in their order. ``page, line_no, action, points``."""
    h = hypotheses.select(page, F.col("line_no").alias("hyp_no")).join(pairs, [page, "hyp_no"], "left")
    r = references.select(page, F.col("line_no").alias("ref_no"), "points")
    both = h.join(r, [page, "ref_no"], "full_outer")
    action = F.when(F.col("hyp_no").isNull(), "append").when(F.col("ref_no").isNull(), "delete").otherwise("update")
    rows = both.select(page, action.alias("action"), "hyp_no", "ref_no", "points").where("action != 'delete'")
    place = F.row_number().over(Window.partitionBy(page).orderBy(F.col("hyp_no").asc_nulls_last(), "ref_no")) - 1
    return rows.select(page, place.alias("line_no"), "action", "points")
