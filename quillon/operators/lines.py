"""Geometry of baselines in column expressions: sampling by arc length, distances, one-to-one matching as a fold.

A line is an array of points (structs of x and y); the lines of a page are one array, since a page is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.stylometry import let

SAMPLES = 32


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _mean(values: Column) -> Column:
    return _sum(values) / F.size(values)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def centroid(points: Column) -> Column:
    """The mean point; null of a line without points."""
    mean = lambda k: _mean(F.transform(points, lambda p: p[k]))
    return F.when(F.size(points) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def arc_lengths(points: Column) -> Column:
    """The length of the line up to each of its points."""
    steps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: distance(F.get(points, i), F.get(points, i - 1)))
    grown = F.aggregate(steps, F.array(F.lit(0.0)), lambda sums, s: F.concat(sums, F.array(F.element_at(sums, -1) + s)))
    return F.when(F.size(points) > 1, grown).otherwise(F.array(F.lit(0.0)))


def sample(points: Column, n: int = SAMPLES) -> Column:
    """``n`` points at equal arc lengths (copies of the first where the line has no length; no points of no line)."""

    def at(sums: Column, t: Column) -> Column:
        k = F.greatest(F.lit(0), F.least(F.size(F.filter(sums, lambda c: c < t)) - 1, F.size(points) - 2))

        def between(k: Column) -> Column:
            a, b, low, high = F.get(points, k), F.get(points, k + 1), F.get(sums, k), F.get(sums, k + 1)
            share = F.when(high > low, (t - low) / (high - low)).otherwise(F.lit(0.0))
            part = lambda axis: F.when(share == 0, a[axis]).otherwise((1 - share) * a[axis] + share * b[axis])
            return F.struct(part("x").alias("x"), part("y").alias("y"))

        return let(k, between)

    def spread(sums: Column) -> Column:
        total = F.element_at(sums, -1)
        targets = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, total).otherwise(i * (total / (n - 1))))
        return F.when(total > 0, F.transform(targets, lambda t: at(sums, t))).otherwise(F.array_repeat(F.get(points, F.lit(0)), n))

    return F.when(F.size(points) > 0, let(arc_lengths(points), spread)).otherwise(F.slice(points, 1, F.lit(0)))


def chamfer(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Mean of the two directed mean distances from sampled points to the nearest of the other line; null without points."""

    def of(p: Column, q: Column) -> Column:
        toward = lambda x, y: _mean(F.transform(x, lambda u: F.array_min(F.transform(y, lambda v: distance(u, v)))))
        return (toward(p, q) + toward(q, p)) / 2

    both = F.struct(sample(a, n).alias("p"), sample(b, n).alias("q"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), let(both, lambda s: of(s["p"], s["q"])))


def match(refs: Column, hyps: Column, radius: float) -> Column:
    """Pairs ``ref, hyp`` (places) of two arrays of lines.

    References from top to bottom (then left) by their centroid each take the nearest free hypothesis strictly within the radius,
    the first on ties: a fold over the sorted references with the array of pairs so far.
    """
    placed = lambda lines: F.filter(F.transform(lines, lambda p, i: F.struct(centroid(p).alias("c"), i.alias("i"))), lambda s: s["c"].isNotNull())
    ordered = lambda s: F.array_sort(F.transform(s, lambda r: F.struct(r["c"]["y"].alias("y"), r["c"]["x"].alias("x"), r["i"].alias("i"))))

    def fold(free: Column) -> Column:
        def step(pairs: Column, r: Column) -> Column:
            taken = F.transform(pairs, lambda p: p["hyp"])
            gaps = F.transform(free, lambda h: F.struct(distance(r, h["c"]).alias("gap"), h["i"].alias("i")))
            best = F.array_min(F.filter(gaps, lambda g: (g["gap"] < radius) & ~F.array_contains(taken, g["i"])))
            return let(best, lambda b: F.when(b.isNull(), pairs).otherwise(F.concat(pairs, F.array(F.struct(r["i"].alias("ref"), b["i"].alias("hyp"))))))

        return F.aggregate(ordered(placed(refs)), F.array().cast("array<struct<ref:int,hyp:int>>"), step)

    return let(placed(hyps), fold)


def compare_lines(refs: DataFrame, hyps: DataFrame, page_col: str, radius: float = 120.0, samples: int = SAMPLES) -> DataFrame:
    """Baselines (``page, line_no, points``) of reference and hypothesis, matched per page: ``n_ref, n_hyp, n_matched, recall,
    precision`` (1 for an empty side) and the mean ``chamfer`` distance of the matches. Lines without points are counted, not matched."""
    side = lambda df, name: df.groupBy(page_col).agg(F.array_sort(F.collect_list(F.struct("line_no", "points"))).alias(name))
    none = F.array().cast(dict(refs.dtypes)["points"].join(("array<", ">")))
    lines = lambda c: F.coalesce(F.transform(c, lambda s: s["points"]), none)
    pages = side(refs, "r").join(side(hyps, "h"), page_col, "full_outer").select(page_col, lines("r").alias("r"), lines("h").alias("h"))
    pages = pages.withColumn("pairs", match(F.col("r"), F.col("h"), radius))
    gaps = F.transform("pairs", lambda p: chamfer(F.get("r", p["ref"]), F.get("h", p["hyp"]), samples))
    # rounded twice: sums in another order differ in the last bits, which must not decide a half of the sixth place
    n, share = F.size("pairs"), lambda c: F.when(F.size(c) > 0, F.size("pairs") / F.size(c)).otherwise(F.lit(1.0))
    return pages.select(
        page_col, F.size("r").cast("long").alias("n_ref"), F.size("h").cast("long").alias("n_hyp"), n.cast("long").alias("n_matched"),
        share("r").alias("recall"), share("h").alias("precision"), F.when(n > 0, F.round(F.round(_mean(gaps), 9), 6)).alias("chamfer"),
    )
