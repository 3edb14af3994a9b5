"""Corpus curation: profile filters with reasons, deduplication by priority, splits, coverage, tiers, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import ordered


def first_failing_reason(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that a row fails (nulls fail), else ``ok``."""
    reason = F.lit(None).cast("string")
    for name, passes in reversed(checks):
        reason = F.when(~F.coalesce(passes, F.lit(False)), name).otherwise(reason)
    return F.coalesce(reason, F.lit("ok"))


def reject_histogram(rows: DataFrame, reason_col: str, top: int = 8) -> DataFrame:
    """Counts of the reasons over all rows, most frequent first (then by name), at most ``top``."""
    counts = rows.where(F.col(reason_col) != "ok").groupBy(reason_col).count()
    return counts.orderBy(F.desc("count"), reason_col).limit(top)


def priority_dedupe(rows: DataFrame, key: Column, priorities: dict[str, int], class_col: str, order_col: str) -> DataFrame:
    """One row per key: of the best class (unknown classes last), then of the smallest ``order_col``.

    The winner is an aggregate, so copies are combined before the shuffle and a hot key cannot fill one task.
    """
    rank = F.lit(len(priorities) + 1)
    for name, value in priorities.items():
        rank = F.when(F.col(class_col) == name, value).otherwise(rank)
    keyed = rows.select(key.alias("dedupe_key"), rank.alias("rank"), F.col(order_col).alias("first"))
    best = keyed.groupBy("dedupe_key").agg(F.min(F.struct("rank", "first")).alias("best"), F.count("*").alias("copies"))
    return best.select(F.col("best.first").alias(order_col), F.col("best.rank").cast("long").alias("rank"), "copies")


def hash_order(seed: str, key: Column) -> Column:
    """A shuffled order that any engine reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def split_rows(rows: DataFrame, group_col: str, key_col: str, fraction: float, *, seed: str, singletons: str, least: int = 1) -> DataFrame:
    """``group, key, split`` with per-group validation rows drawn in hash order.

    ``singletons`` names the split of one-row groups. With ``train`` the size is max(least, half-even round of n * fraction), below
    n; with ``val`` it is max(1, whole part of n * fraction).
    """
    order = hash_order(seed, F.col(key_col))
    keyed = rows.select(group_col, key_col, order.alias("_order"), F.left(order, F.lit(2)).alias("_part"))
    # a group is ranked in 256 parts of its hash order, so a large one is many small tasks
    counts = keyed.groupBy(group_col, "_part").count()
    whole = Window.partitionBy(group_col)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select(
        F.col(group_col).alias("_group"),
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"),
        F.sum("count").over(whole).alias("_n"),
    )
    place = F.row_number().over(Window.partitionBy(group_col, "_part").orderBy("_order", key_col))
    n = F.col("_n")
    if singletons == "train":
        size = F.when(n > 1, F.least(F.greatest(F.lit(least), F.bround(n * fraction, 0).cast("long")), n - 1)).otherwise(0)
    else:
        size = F.greatest(F.lit(1), F.floor(n * fraction))
    ranked = keyed.withColumn("_place", place)
    met = ranked.join(parts, ranked[group_col].eqNullSafe(parts["_group"]) & (ranked["_part"] == parts["_p"]))
    return met.select(group_col, key_col, F.when(F.col("_place") + F.col("_before") <= size, "val").otherwise("train").alias("split"))


def char_coverage(docs: DataFrame, text_col: str) -> DataFrame:
    """Count of every character."""
    letters = docs.select(F.explode_outer(F.split(F.coalesce(F.col(text_col), F.lit("")), "")).alias("ch")).where("ch != ''")
    return letters.groupBy("ch").count()


def rare_char_rows(docs: DataFrame, id_col: str, text_col: str, below: int, examples: int = 8) -> DataFrame:
    """Characters (blanks aside) seen less than ``below`` times: code point, count and first example ids.

    Each row first gives its distinct characters, so a frequent character is combined before the shuffle; ids are
    gathered for rare ones only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    per = docs.select(id_col, text.alias("t"), F.explode_outer(F.array_distinct(F.split(text, ""))).alias("ch"))
    per = per.where(~F.col("ch").rlike(r"^\s*$")).select(id_col, "ch", (F.length("t") - F.length(F.replace("t", F.col("ch"), F.lit("")))).alias("n"))
    rare = per.groupBy("ch").agg(F.sum("n").alias("n_chars")).where(F.col("n_chars") < below)
    found = per.join(rare, "ch").groupBy("ch").agg(
        F.max("n_chars").cast("long").alias("n_chars"), F.slice(F.sort_array(F.collect_list(id_col)), 1, examples).alias("ids")
    )
    return found.select("ch", F.ascii("ch").cast("long").alias("code_point"), "n_chars", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("examples"))


def adjudicated_union(decided: DataFrame, confident: DataFrame, keys: list[str]) -> DataFrame:
    """Decided rows, and confident rows whose key nobody decided on."""
    return decided.unionByName(confident.join(decided.select(*keys).distinct(), keys, "left_anti"))


def best_worst(rows: DataFrame, case_col: str, run_col: str, score_col: str) -> DataFrame:
    """Best and worst run per case (ties by run), their gap and a priority class."""
    s = F.struct(F.col(score_col), F.col(run_col))
    top = F.min(F.struct((-F.col(score_col)).alias("s"), F.col(run_col).alias("r")))
    agg = rows.groupBy(case_col).agg(top.alias("b"), F.min(s).alias("w"), F.count("*").alias("n_runs"))
    gap = F.round(-F.col("b.s") - F.col(f"w.{score_col}"), 4)
    return agg.select(
        case_col,
        F.col("b.r").alias("best_run"),
        F.col(f"w.{run_col}").alias("worst_run"),
        gap.alias("gap"),
        F.when(gap >= 50000, "high").when(gap >= 5000, "medium").otherwise("low").alias("priority"),
        "n_runs",
    )


def islands(rows: DataFrame, group_col: str, order_cols: list[str], value_col: str) -> DataFrame:
    """Maximal runs of equal values in order: ``group, island, value, length`` (from 1)."""
    marked = ordered.runs(rows.select(group_col, *order_cols, value_col), [group_col], order_cols, F.col(value_col), "island")
    return marked.groupBy(group_col, "island").agg(F.first(value_col).alias(value_col), F.count("*").alias("length"))


def asof_last(rows: DataFrame, group_col: str, order_cols: list[str], is_anchor: Column, is_source: Column, value_col: str) -> DataFrame:
    """For every anchor row the value of the last source row before it, or null."""
    return ordered.last_known(rows, [group_col], order_cols, F.when(is_source, F.col(value_col)), "anchor").where(is_anchor)


def interval_counts(points: DataFrame, intervals: DataFrame, point_col: str, key_col: str, low: str, high: str, width: int) -> DataFrame:
    """Number of points in each closed integer interval, by buckets of ``width``: intervals meet only the points of the
    buckets they overlap."""
    p = points.select(F.col(point_col).alias("p"), F.floor(F.col(point_col) / width).alias("bucket"))
    p = p.groupBy("bucket", "p").count()
    spans = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    i = intervals.select(key_col, low, high, F.explode_outer(spans).alias("bucket"))
    met = i.join(p, "bucket").where((F.col("p") >= F.col(low)) & (F.col("p") <= F.col(high)))
    return met.groupBy(key_col).agg(F.sum("count").alias("n_points"))


def margin_outliers(rows: DataFrame, group_col: str, start_col: str, end_col: str, least: int = 4, short: float = 0.35) -> DataFrame:
    """Per group: items shorter than ``short`` of the median length and wholly outside the inner quartile column."""
    length = F.col(end_col) - F.col(start_col)
    stats = rows.groupBy(group_col).agg(
        F.percentile(start_col, F.lit(0.25)).alias("q1"),
        F.percentile(end_col, F.lit(0.75)).alias("q3"),
        F.percentile(length, F.lit(0.5)).alias("mid"),
        F.count("*").alias("n"),
    )
    outside = (F.col(end_col) < F.col("q1")) | (F.col(start_col) > F.col("q3"))
    tagged = (F.col("n") >= least) & (length < short * F.col("mid")) & outside
    return rows.join(stats, group_col).groupBy(group_col).agg(F.count("*").alias("n_items"), F.count_if(tagged).alias("n_margin"))
