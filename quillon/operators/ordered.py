"""Ordered scans of groups of any size: numbers, last known values, runs.

A window over a group sorts the whole group in one task. Here the rows are cut into parts by split points of (group, order), which
come from a bounded sample and are constants of the plan, so every attempt of a task cuts alike. A scan goes through each part on its
own; a second, small scan goes over one row a group and part (count, last value, runs) and tells each part what came before it.
Most groups lie in one part; one that holds all rows is as many tasks as there are parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a table, and the rows of smallest hash whose keys are sorted to cut it.
PARTS, SAMPLE = 64, 4096
_PART, _BEFORE = "_quillon_part", "_quillon_before"


def _whole(values: list[Column]) -> Column:
    return F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)])


def cut(rows: DataFrame, group: list[str], order: list[str], parts: int = PARTS, sample: int = SAMPLE) -> DataFrame:
    """``rows`` with the number of their part; rows of equal group and order share a part."""
    keys = [*group, *order]
    drawn = rows.select(*keys).orderBy(F.xxhash64(*keys)).limit(sample)
    points = drawn.orderBy(*keys).collect()
    step = max(1, -(-len(points) // parts))
    points = points[step::step]
    kinds = [rows.schema[k].dataType for k in keys]
    points = [_whole([F.lit(v).cast(t) for v, t in zip(p, kinds, strict=True)]) for p in points]

    def part(low: int, high: int) -> Column:
        """How many points are not above the key, known to lie from ``low`` to ``high``."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(_whole([F.col(k) for k in keys]) < points[mid], part(low, mid)).otherwise(part(mid + 1, high))

    return rows.withColumn(_PART, part(0, len(points)))


def _carried(rows: DataFrame, group: list[str], summary: list[Column], carry: Callable[[DataFrame, Window], DataFrame]) -> DataFrame:
    """``rows`` (cut) with what ``carry`` makes of the summaries of their group's parts, one row a group and part."""
    sums = rows.groupBy(*group, _PART).agg(*summary)
    told = carry(sums, Window.partitionBy(*group).orderBy(_PART))
    told = told.select(*[F.col(g).alias(f"_quillon_{g}") for g in group], F.col(_PART).alias("_quillon_p"), _BEFORE)
    same = F.col(_PART) == F.col("_quillon_p")
    for g in group:
        same = same & rows[g].eqNullSafe(told[f"_quillon_{g}"])
    return rows.join(told, same).drop("_quillon_p", *[f"_quillon_{g}" for g in group])


def _earlier(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, **how) -> DataFrame:
    """``rows`` with their place (from 1) in the order of their group; rows of equal order are numbered in any order."""
    own = Window.partitionBy(*group, _PART).orderBy(*order)
    placed = cut(rows, group, order, **how).withColumn(name, F.row_number().over(own).cast("long"))
    told = _carried(placed, group, [F.count("*").alias("n")], lambda sums, w: sums.withColumn(_BEFORE, F.coalesce(F.sum("n").over(_earlier(w)), F.lit(0))))
    return told.withColumn(name, F.col(name) + F.col(_BEFORE)).drop(_BEFORE, _PART)


def last_known(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str, **how) -> DataFrame:
    """``rows`` with the last value that is not null of the rows before them in their group (null where there is none)."""
    marked = cut(rows, group, order, **how).withColumn("_quillon_value", value)
    own = Window.partitionBy(*group, _PART).orderBy(*order)
    found = marked.withColumn(name, F.last("_quillon_value", ignorenulls=True).over(_earlier(own)))
    by = F.struct(*order)
    last = F.max_by("_quillon_value", F.when(F.col("_quillon_value").isNotNull(), by)).alias("v")
    told = _carried(found, group, [last], lambda sums, w: sums.withColumn(_BEFORE, F.last("v", ignorenulls=True).over(_earlier(w))))
    return told.withColumn(name, F.coalesce(name, _BEFORE)).drop(_BEFORE, _PART, "_quillon_value")


def runs(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str, **how) -> DataFrame:
    """``rows`` with the number (from 1) of their run: a stretch of equal values (nulls are equal) in the order of their group."""
    marked = cut(rows, group, order, **how).withColumn("_quillon_value", value)
    own = Window.partitionBy(*group, _PART).orderBy(*order)
    first = F.row_number().over(own) == 1
    changes = (~first & ~F.col("_quillon_value").eqNullSafe(F.lag("_quillon_value").over(own))).cast("long")
    marked = marked.withColumn("_quillon_change", changes).withColumn("_quillon_runs", F.sum("_quillon_change").over(own))
    by = F.struct(*order)
    held = F.struct(F.col("_quillon_value").alias("v"))  # so that a null is a value too
    summary = [F.sum("_quillon_change").alias("n"), F.min_by(held, by).alias("head"), F.max_by(held, by).alias("tail")]

    def carry(sums: DataFrame, w: Window) -> DataFrame:
        last = F.lag("tail").over(w)
        goes_on = last.isNotNull() & last["v"].eqNullSafe(F.col("head")["v"])  # a part's first run may be the last of the part before
        opened = sums.withColumn("opens", (~goes_on).cast("long"))
        return opened.withColumn(_BEFORE, F.coalesce(F.sum("n").over(_earlier(w)), F.lit(0)) + F.sum("opens").over(w))

    out = _carried(marked, group, summary, carry).withColumn(name, F.col("_quillon_runs") + F.col(_BEFORE))
    return out.drop(_BEFORE, _PART, "_quillon_value", "_quillon_change", "_quillon_runs")
