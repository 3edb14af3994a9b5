import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import curate as C
from quillon.operators import evaluate as E
from quillon.operators import lines as G
from quillon.operators import stylometry as S


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_edits(spark):
    rnd = random.Random(4)
    pairs = [("a b c", "a x c d"), ("", "a"), (None, "a b"), ("a  b", " a b "), ("", "")]
    pairs += [(" ".join(rnd.choice("abcdé") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 30))), " ".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 30)))) for _ in range(60)]
    many = [f"w{i}" for i in range(70_000)]  # more words than letters of two bytes
    pairs.append((" ".join(many[:300] + many[-300:]), " ".join(many[1:300] + ["x"] + many[-300:])))
    df = spark.createDataFrame(pairs, "truth string, guess string")
    got = df.select(E.word_distance(E.words_of(F.col("truth")), E.words_of(F.col("guess"))).alias("d"), E.word_errors("truth", "guess").alias("e")).collect()
    for (t, g), r in zip(pairs, got, strict=True):
        a, b = (t or "").split(), (g or "").split()
        assert r["d"] == plain_edits(a, b)
        assert r["e"]["wer"] == (round(100 * r["d"] / len(a), 4) if a else 0.0)
        ops = difflib.SequenceMatcher(None, a, b).get_opcodes()
        assert (r["e"]["adds"], r["e"]["omits"]) == (sum(m - k for op, _, _, k, m in ops if op == "insert"), sum(j - i for op, i, j, _, _ in ops if op == "delete"))


def test_edits_of_long_texts_by_bits(spark):
    rnd = random.Random(6)
    pairs = [("".join(rnd.choice("abc漢") for _ in range(rnd.randint(0, 90))), "".join(rnd.choice("abc漢") for _ in range(rnd.randint(0, 90)))) for _ in range(80)]
    for a, b in pairs:
        assert E._bit_distance(a, b) == plain_edits(a, b)
    df = spark.createDataFrame([*pairs, (None, "a")], "a string, b string")
    for side in (5, 4096):
        got = [r[0] for r in df.select(E.edit_distance(F.col("a"), F.col("b"), side)).collect()]
        assert got == [plain_edits(a, b) for a, b in pairs] + [None]


def test_dispositions(spark):
    cases = spark.createDataFrame([(0.99, 1.99), (1.0, 1.0), (2.99, 4.99), (3.0, 0.0)], "c double, w double")
    got = [r[0] for r in cases.select(E.disposition(F.col("c"), F.col("w"))).collect()]
    assert got == ["PASS", "COND_PASS", "COND_PASS", "FAIL"]


def test_line_cer_edges(spark):
    rows = spark.createDataFrame([("", ""), ("abc", ""), ("abc", "abc")], "a string, b string")
    assert [r[0] for r in rows.select(E.line_cer(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0]


def plain_samples(line, n=32):
    steps = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))]) if len(line) > 1 else np.zeros(1)
    if steps[-1] == 0:
        return np.repeat(line[:1], n, axis=0)
    return np.column_stack([np.interp(np.linspace(0, steps[-1], n), steps, line[:, k]) for k in (0, 1)])


def plain_match(refs, hyps, radius):
    centre = lambda line: line.mean(axis=0)
    free, pairs = [j for j in range(len(hyps)) if len(hyps[j])], []
    for i in sorted((i for i in range(len(refs)) if len(refs[i])), key=lambda i: (centre(refs[i])[1], centre(refs[i])[0])):
        gap, best = min(((float(np.hypot(*(centre(refs[i]) - centre(hyps[j])))), j) for j in free), default=(radius, -1))
        if gap < radius:
            pairs.append((i, best))
            free.remove(best)
    return pairs


POINTS = "array<struct<x:double,y:double>>"


def test_lines_sampled_compared_and_matched(spark):
    rnd = np.random.default_rng(7)
    draw = lambda: [tuple(map(float, p)) for p in rnd.integers(0, 60, (rnd.integers(0, 6), 2))]
    pages = [([draw() for _ in range(rnd.integers(0, 7))], [draw() for _ in range(rnd.integers(0, 7))]) for _ in range(60)]
    pages += [([[(5.0, 5.0), (5.0, 5.0)]], [[(5.0, 5.0)]]), ([[(0.0, 10.0)], [(0.0, 0.0)]], [[(0.0, 4.0)]]), ([[(0.0, 0.0)]], [[(0.0, 30.0)]])]
    df = spark.createDataFrame(pages, f"r array<{POINTS}>, h array<{POINTS}>")
    got = df.select(G.match(F.col("r"), F.col("h"), 30.0).alias("m"), F.transform("r", lambda line: G.sample(line)).alias("s"), G.chamfer(F.get("r", F.lit(0)), F.get("h", F.lit(0))).alias("c")).collect()
    for (refs, hyps), row in zip(pages, got, strict=True):
        a, b = ([np.array(x, float).reshape(-1, 2) for x in side] for side in (refs, hyps))
        assert [tuple(p) for p in row["m"]] == plain_match(a, b, 30.0)
        for line, found in zip(a, row["s"], strict=True):
            assert len(found) == (32 if len(line) else 0)
            assert not len(line) or np.allclose([tuple(p) for p in found], plain_samples(line))
        if a and b and len(a[0]) and len(b[0]):
            p, q = plain_samples(a[0]), plain_samples(b[0])
            gaps = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
            assert abs(row["c"] - (gaps.min(1).mean() + gaps.min(0).mean()) / 2) < 1e-9
        else:
            assert row["c"] is None


def test_compare_lines_empty_side(spark):
    schema = "page long, line_no long, points array<struct<x:double,y:double>>"
    a = spark.createDataFrame([(1, 0, [(0.0, 0.0), (9.0, 0.0)])], schema)
    b = spark.createDataFrame([(2, 0, [(0.0, 0.0), (9.0, 0.0)])], schema)
    got = {r["page"]: (r["recall"], r["precision"]) for r in E.compare_lines(a, b, "page").collect()}
    assert got == {1: (0.0, 1.0), 2: (1.0, 0.0)}


def test_points(spark):
    got = spark.createDataFrame([("1,2 x,3 4,5 6",)], "t string").select(E.parse_points(F.col("t"))).first()[0]
    assert [tuple(p) for p in got] == [(1.0, 2.0), (4.0, 5.0)]


def test_gate(spark):
    schema = "name string, held_out_ready boolean, held_out_cer double, held_out_wer double, val_accuracy double, val_word_accuracy double, per_corpus map<string,double>"
    rows = [("a", True, 0.1, 0.4, None, None, None), ("b", False, 0.1, 0.1, None, None, None), ("c", True, None, None, 0.8, 0.9, None), ("d", True, None, None, None, None, {"x": 0.1, "y": 0.12})]
    got = {r["name"]: (r["reason"], r["allowed"]) for r in E.correct_gate(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("ok", True), "b": ("not held out", False), "c": ("character errors", False), "d": ("no error rate", False)}  # a missing word error rate does not pass


def test_splits(spark):
    rows = [(g, f"{g}{i}") for g, n in (("a", 1), ("b", 2), ("c", 5), ("d", 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k string")
    count = lambda s: {r["g"]: r["n"] for r in s.groupBy("g").agg(F.count_if(F.col("split") == "val").alias("n")).collect()}
    assert count(C.split_rows(df, "g", "k", 0.1, seed="x", singletons="train")) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert count(C.split_rows(df, "g", "k", 0.1, seed="x", singletons="val")) == {"a": 1, "b": 1, "c": 1, "d": 2}


def test_priority_dedupe(spark):
    df = spark.createDataFrame([("k", "low", 1), ("k", "high", 5), ("k", "high", 3), ("m", "other", 7)], "stem string, corpus string, ord long")
    got = {(r["ord"], r["rank"]) for r in C.priority_dedupe(df, F.col("stem"), {"high": 1, "low": 2}, "corpus", "ord").collect()}
    assert got == {(3, 1), (7, 3)}


def test_first_failing_reason(spark):
    df = spark.createDataFrame([("en", 5), ("xx", 5), ("en", None)], "lang string, n int")
    reason = C.first_failing_reason([("lang", F.col("lang") == "en"), ("size", F.col("n") > 1)])
    assert [r[0] for r in df.select(reason).collect()] == ["ok", "lang", "size"]


def test_intervals_by_buckets_match_brute_force(spark):
    rng = random.Random(1)
    points = [rng.randint(0, 200) for _ in range(300)]
    spans = [(i, a, a + rng.randint(0, 60)) for i, a in enumerate(rng.randint(0, 200) for _ in range(40))]
    got = C.interval_counts(
        spark.createDataFrame([(p,) for p in points], "p long"), spark.createDataFrame(spans, "k long, lo long, hi long"), "p", "k", "lo", "hi", 16
    )
    want = {k: n for k, lo, hi in spans if (n := sum(lo <= p <= hi for p in points))}
    assert {r["k"]: r["n_points"] for r in got.collect()} == want


def test_margins(spark):
    page = [(1, 100.0, 900.0)] * 3 + [(1, 10.0, 50.0), (1, 950.0, 990.0)] + [(2, 100.0, 900.0)] * 2 + [(2, 10.0, 50.0)]
    df = spark.createDataFrame(page, "p long, s double, e double")
    assert {r["p"]: r["n_margin"] for r in C.margin_outliers(df, "p", "s", "e").collect()} == {1: 2, 2: 0}


def test_delta_finds_the_own_label_and_survives_constant_features(spark):
    rows = [("x", "r1", "a", 0.5), ("x", "r1", "b", 0.1), ("y", "r2", "a", 0.1), ("y", "r2", "b", 0.1)]
    refs = spark.createDataFrame(rows, "label string, ref string, feature string, freq double")
    target = spark.createDataFrame([("t", "a", 0.45), ("t", "b", 0.1)], "t string, feature string, freq double")
    best = S.delta_ranking(target, refs, "t").where("rank = 1").first()
    assert (best["label"], best["nearest"]) == ("x", "r1")


def test_heaps_of_a_short_text(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, None)], "id long, text string")
    assert {(r["id"], r["k"], r["beta"], r["r2"]) for r in S.heaps_fit(df, "id", "text").collect()} == {(1, 1.0, 0.5, 0.0), (2, 1.0, 0.5, 0.0)}
