"""Ranked lookups: model registry with wildcards, exact nearest neighbours by an index of pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordered import numbered

#: Pivots of an index, the rows they are chosen from, and the most rows and queries that one task compares at a time.
PIVOTS, SAMPLE, PART, BLOCK = 64, 4096, 20_000, 2048


def covers(values: Column, wanted: Column) -> Column:
    """Whether a comma list is empty, has a star, or holds the value."""
    parts = F.split(values, ",")
    return (values == "") | F.array_contains(parts, "*") | F.array_contains(parts, wanted)


def rank_models(models: DataFrame, wanted: DataFrame) -> DataFrame:
    """Models ranked for each job: criteria covered, language named, era named, later round (``r<number>``, others 0),
    lower error, name. Every job meets every model; the places are those of an ordered scan, so a job's models are many tasks."""
    number = F.when(F.col("round").rlike("^r[0-9]+$"), F.expr("substr(round, 2)").cast("int")).otherwise(0)
    named = lambda c, v: F.array_contains(F.split(c, ","), F.col(v)).cast("int")
    both = (covers(F.col("languages"), F.col("lang")) & covers(F.col("eras"), F.col("era"))).cast("int")
    last = lambda c: -F.coalesce(c, F.lit(-1))  # noqa: E731 (the largest first, nulls last)
    dealt = models.repartition(models.sparkSession.sparkContext.defaultParallelism)  # a small file would be one task of all pairs
    rows = dealt.crossJoin(wanted).select("job_id", last(both).alias("both"), last(named("languages", "lang")).alias("nl"), last(named("eras", "era")).alias("ne"), (-number).alias("number"), "cer", "name")
    return numbered(rows, ["job_id"], ["both", "nl", "ne", "number", "cer", "name"], "rank").select("job_id", "name", "rank")


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column (a zero vector stays zero)."""
    rows = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices of unit vectors."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0.0))


class PivotIndex:
    """Rows of vectors in the cells of pivots.

    Pivots are spread over a sample of at most ``sample`` rows (the rows of smallest hash, so any run takes the same): each is the
    sampled row farthest from those before it. Every row goes to the cell of its nearest pivot, whatever the sample; of each
    cell the distances to its pivot are known from the least to the largest. Cells are cut into parts of some ``part`` rows, so that one
    that holds a third of all rows is many tasks.
    """

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, *, pivots: int = PIVOTS, sample: int = SAMPLE, part: int = PART):
        self.id_col, self.vector_col, self.part = id_col, vector_col, part
        source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
        least = source.orderBy(F.xxhash64("v"), "id").limit(sample).select("v").toArrow()
        self.pivots = _spread(_matrix(least.column("v").combine_chunks()), pivots)
        self.rows = source.mapInArrow(self._placed(), "id long, v array<double>, cell int, far double")
        stats = self.rows.groupBy("cell").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).collect()
        self.cells = {r["cell"]: (r["lo"], r["hi"], r["n"]) for r in stats}  # one row a pivot
        self.parts = {c: max(1, -(-n // part)) for c, (_, _, n) in self.cells.items()}

    def _placed(self):
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    gaps = _gaps(_matrix(batch.column("v")), pivots)
                    cell = gaps.argmin(1)
                    extra = [pa.array(cell, pa.int32()), pa.array(gaps[np.arange(len(cell)), cell], pa.float64())]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *extra], names=["id", "v", "cell", "far"])

        return run

    def _asked(self, queries: DataFrame, digits: int, home_only: bool = False) -> DataFrame:
        """``q, v, known, cell, home`` of the cell of the query's nearest pivot, and of every other that can hold a row at least as
        similar as ``known`` (null: all cells)."""
        pivots, slack = self.pivots, 10.0**-digits
        number = np.array(sorted(self.cells), np.int64)
        low, high = (np.array([self.cells[c][k] for c in number]) for k in (0, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(number):
                    continue
                gaps = _gaps(_matrix(batch.column("v")), pivots)[:, number]
                under = np.maximum(np.maximum(gaps - high, low - gaps), 0.0)  # no row of the cell is nearer than that
                known = np.array([-2.0 if x is None else x for x in batch.column("known").to_pylist()])
                asked = 1 - under**2 / 2 >= known[:, None] - slack - 1e-9
                home = gaps.argmin(1)
                own = np.arange(len(number)) == home[:, None]
                for name, mask in ((True, own), (False, asked & ~own))[: 1 if home_only else 2]:
                    i, c = np.nonzero(mask)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("q").take(pa.array(i)), batch.column("v").take(pa.array(i)), batch.column("known").take(pa.array(i)), pa.array(number[c], pa.int32()), pa.array([name] * len(i), pa.bool_())],
                        names=["q", "v", "known", "cell", "home"],
                    )

        return queries.mapInArrow(run, "q long, v array<double>, known double, cell int, home boolean")

    def _search(self, asked: DataFrame, k: int, digits: int) -> DataFrame:
        """``q, id, similarity``: of every query the best ``k`` of each part of the cells it asks."""
        pivots = self.pivots
        asking = {r["cell"]: max(1, -(-r["n"] // BLOCK)) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a pivot
        of = lambda sizes: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in sizes.items() for x in item]), F.col("cell")), F.lit(1)) if sizes else F.lit(1)
        parts, blocks = of(self.parts), of(asking)
        split = lambda key, by: F.pmod(F.xxhash64(key), by).cast("int")
        # a part of a cell meets a block of those who ask it: both are bounded, whatever the cell holds and whoever asks
        held = self.rows.where(F.col("cell").isin(list(asking))).withColumn("part", split("id", parts)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        asks = asked.withColumn("block", split("q", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
            if left.num_rows and right.num_rows:
                q, own = left.column("q").to_numpy(), right.column("id").to_numpy()
                want, have = (_matrix(t.column("v").combine_chunks()) for t in (left, right))
                order = np.argsort(own, kind="stable")
                own, have = own[order], have[order]
                # rows whose distance to their pivot tells that they are farther than what is known
                cell, far = right.column("cell")[0].as_py(), right.column("far").to_numpy()[order]
                known = np.array([-2.0 if x is None else x for x in left.column("known").to_pylist()])
                apart = np.abs(_gaps(want, pivots[cell : cell + 1]) - far)
                scores = np.round(want @ have.T, digits)
                out_of = (own == q[:, None]) | (1 - apart**2 / 2 < known[:, None] - 10.0**-digits - 1e-9)
                # ids ascend, so one whole number tells similarity, then the smaller id
                n, most = len(own), min(k, len(own))
                key = np.where(out_of, np.iinfo(np.int64).min, np.rint(scores * 10**digits).astype(np.int64) * n + (n - 1 - np.arange(n)))
                best = np.argpartition(key, n - most, axis=1)[:, n - most :].ravel()
                i = np.repeat(np.arange(len(q)), most)
                good = ~out_of[i, best]
                i, best = i[good], best[good]
                out = [pa.array(q[i]), pa.array(own[best]), pa.array(scores[i, best])]
            return pa.table(out, names=["q", "id", "similarity"])

        keys = ["cell", "part", "block"]
        return asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(compare, "q long, id long, similarity double")

    def nearest(self, queries: DataFrame, k: int, digits: int = 5) -> tuple[DataFrame, DataFrame]:
        """``q, id, similarity, rank`` of the ``k`` most similar rows of every query (ties by id; a query does not find its own id), and
        ``q, n_cells, n_skipped``.

        First a query asks the cell of its own nearest pivot; its ``k``-th similarity there bounds what the others must reach. By the
        triangle inequality a row is at least as far from the query as the distances of both to the pivot differ, which leaves
        out cells, and rows of cells. Similarities are rounded, so the bound gives way by one unit of the last digit.
        """
        asks = queries.select(F.col(self.id_col).cast("long").alias("q"), F.col(self.vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
        home = self._search(self._asked(asks.withColumn("known", F.lit(None).cast("double")), digits, home_only=True), k, digits)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "id"))
        first = home.withColumn("rank", place).where(F.col("rank") <= k)
        bound = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("known"))
        asked = self._asked(asks.join(bound, "q", "left"), digits)
        rest = self._search(asked.where("NOT home"), k, digits)
        found = first.drop("rank").unionByName(rest).withColumn("rank", place.cast("long")).where(F.col("rank") <= k)
        visits = asked.groupBy("q").agg(F.lit(len(self.cells)).cast("long").alias("n_cells"), (F.lit(len(self.cells)) - F.count("*")).cast("long").alias("n_skipped"))
        return found, visits


def _spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before."""
    if not len(sample):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    taken, gap = [0], np.full(len(sample), np.inf)
    while len(taken) < min(pivots, len(sample)):
        gap = np.minimum(gap, _gaps(sample, sample[taken[-1] :][:1])[:, 0])
        if gap.max() <= 1e-9:
            break
        taken.append(int(gap.argmax()))
    return sample[taken]


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, digits: int = 5, **how) -> DataFrame:
    """Exact cosine top ``k`` of every query among all rows but itself (``query_id, id, similarity, rank``; ties by id)."""
    found, _ = PivotIndex(rows, id_col, vector_col, **how).nearest(queries, k, digits)
    return found.select(F.col("q").alias("query_id"), F.col("id").alias(id_col), "similarity", "rank")


def pruning(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, **how) -> DataFrame:
    """Per query ``query_id, n_cells, n_skipped``: the cells of the index and how many of them a search leaves out."""
    _, visits = PivotIndex(rows, id_col, vector_col, **how).nearest(queries, k)
    return visits.withColumnRenamed("q", "query_id")
