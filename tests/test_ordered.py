"""Ordered scans over parts, and nearest neighbours by pivots, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import ordered, search


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    made = [(g, i, rnd.choice(["a", "a", "a", "b", None])) for g, n in (("big", 3000), ("one", 1), (None, 40), ("mid", 200)) for i in range(n)]
    rnd.shuffle(made)
    return spark.createDataFrame(made, "g string, i long, v string").repartition(5)


def held(df, name):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["i"]):
        out.setdefault(r["g"], []).append((r["v"], r[name]))
    return out


@pytest.mark.parametrize("how", [{}, {"parts": 7, "sample": 50}, {"parts": 1}])
def test_scans_of_groups_in_parts(rows, how):
    for g, found in held(ordered.numbered(rows, ["g"], ["i"], "n", **how), "n").items():
        assert [n for _, n in found] == list(range(1, len(found) + 1)), g
    for g, found in held(ordered.last_known(rows, ["g"], ["i"], F.col("v"), "n", **how), "n").items():
        last = None
        for v, n in found:
            assert n == last, g
            last = v if v is not None else last
    for g, found in held(ordered.runs(rows, ["g"], ["i"], F.col("v"), "n", **how), "n").items():
        run, before = 0, object()
        for v, n in found:
            run, before = run + (v != before), v
            assert n == run, g


def test_one_group_with_all_rows_is_many_tasks(rows):
    big = ordered.cut(rows.where("g = 'big'"), ["g"], ["i"])
    counts = [r["count"] for r in big.groupBy(ordered._PART).count().collect()]
    assert len(counts) > 40 and max(counts) < 3000 / 20


def test_scans_of_an_empty_table(rows):
    none = rows.where("i < 0")
    assert ordered.numbered(none, ["g"], ["i"], "n").collect() == [] and ordered.runs(none, ["g"], ["i"], F.col("v"), "n").collect() == []


def test_nearest_by_pivots(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 16)) * 3
    made = np.concatenate([c + rnd.normal(size=(60 if i else 700, 16)) * 0.2 for i, c in enumerate(centres)] + [np.zeros((2, 16)), np.repeat(rnd.normal(size=(1, 16)), 5, 0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)] + [(-1, None)], "id long, v array<double>")
    asking = df.where("id % 20 = 0")
    unit = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-300)
    for how in ({"pivots": 16}, {"pivots": 8, "part": 100, "sample": 200}, {"pivots": 1}):
        got = {}
        for r in search.nearest(df, asking, "id", "v", 4, **how).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["similarity"]))
        for q in range(0, len(made), 20):
            scores = np.round(unit @ unit[q], 5)
            want = sorted((j for j in range(len(made)) if j != q), key=lambda j: (-scores[j], j))[:4]
            assert [(i, s) for _, i, s in sorted(got[q])] == [(j, pytest.approx(scores[j], abs=1e-5)) for j in want], (q, how)
    skipped = search.pruning(df, asking, "id", "v", 4, pivots=16).agg((F.sum("n_skipped") / F.sum("n_cells")).alias("s")).first()["s"]
    assert skipped > 0.5
