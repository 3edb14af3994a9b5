"""Streams: state per job over a restart, files that fail, windows and joins with late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.streaming import events as V
from quillon.streaming import jobs, watcher

SCHEMA = "job string, page long, text string"


def test_due_after_the_last_run():
    runs, last = [], 0
    for n in (3, 7, 16, 17, 26, 60):
        if jobs.due(n, last):
            last = n
            runs.append(n)
    assert runs == [7, 17, 60]  # ten pages after the last run, not at fixed levels


def test_state_of_several_jobs_over_a_restart(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    seen = []

    def aggregate(pages):
        seen.append({r["job"] for r in pages.select("job").distinct().collect()})
        return pages.groupBy("job").agg(F.count("*").alias("held"))

    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        jobs.watch_jobs(spark, folder, spark.createDataFrame([], SCHEMA).schema, aggregate, out, checkpoint, files_per_batch=1).awaitTermination()
        return {r["job"]: (r["n_pages"], r["n_words"], r["run"]) for r in spark.read.parquet(out).collect()} if seen else {}

    blank = ["[illegible: two lines] <gap/>", " ", None]
    assert add([("a", i, "two words") for i in range(4)] + [("b", i, "one") for i in range(6)] + [("a", 10 + i, t) for i, t in enumerate(blank)]) == {"b": (6, 6, 1)}
    assert add([("a", 4, "x y [gap] z")]) == {"b": (6, 6, 1), "a": (5, 11, 1)}  # a restart knows both jobs
    assert add([("b", i, "one") for i in range(6, 15)]) == {"b": (6, 6, 1), "a": (5, 11, 1)}  # nine more pages are not enough
    assert add([("b", 15, "one")]) == {"b": (16, 16, 2), "a": (5, 11, 1)}
    assert seen == [{"b"}, {"a"}, {"b"}]  # only jobs that are due are read again


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b", "bad", "c", "crash", "flaky"):
        (tmp_path / "in" / f"{name}.txt").write_text(name)
    return tmp_path


def test_bad_files_do_not_stop_the_watcher(spark, folder):
    worked = []

    def work(files):
        rows = files.select("path", F.decode("content", "UTF-8").alias("text")).collect()
        worked.extend(r["text"] for r in rows)
        if any(r["text"] == "crash" for r in rows):
            raise RuntimeError("it crashed")
        flaky = worked.count("flaky") < 2
        made = [(r["path"], r["text"].upper(), "bad file" if r["text"] == "bad" or (r["text"] == "flaky" and flaky) else None) for r in rows]
        return spark.createDataFrame(made, "path string, text string, error string")

    pauses = []
    w = watcher.Watcher(spark, str(folder / "in"), str(folder / "out"), work, pattern="*.txt", files_per_batch=4, attempts=3)
    rounds = w.run(str(folder / "cp"), idle_rounds=2, pause=5.0, sleep=pauses.append)
    name = lambda r: r["path"].rsplit("/", 1)[1]
    assert sorted(r["text"] for r in w.done().collect()) == ["A", "B", "C", "FLAKY"]
    assert {name(r): (r["attempts"], r["error"]) for r in w.poison().collect()} == {"bad.txt": (3, "bad file"), "crash.txt": (3, "it crashed")}
    assert len(pauses) == rounds - 1 and pauses[0] == 5.0
    before, tried = sorted(map(str, w.done().collect())), len(worked)
    again = watcher.Watcher(spark, str(folder / "in"), str(folder / "out"), work, pattern="*.txt", files_per_batch=4, attempts=3)
    again.run(str(folder / "another"), idle_rounds=1, pause=0.0)  # without its checkpoint all files come again
    assert sorted(map(str, again.done().collect())) == before and len(worked) == tried
    (folder / "in" / "d.txt").write_text("d")
    again.run(str(folder / "another"), idle_rounds=1, pause=0.0)
    assert again.done().count() == 5


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def played(spark, tmp_path, name, batches, schema, build):
    """Rows of a memory sink after batches of rows, one file each."""
    folder = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b{i}")
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        query = build(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_sliding_windows_and_late_rows(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    batches = [[("a", at(5), 1.0), ("a", at(50), 2.0)], [("a", at(200), 4.0)], [("a", at(6), 8.0)], [("a", at(400), 1.0)]]
    got = played(spark, tmp_path, "sliding", batches, schema, lambda s: V.sliding(s, "ts", "v", "k", "1 hour", "30 minutes", "20 minutes"))
    held = {r["window_start"].strftime("%d %H:%M"): r["total"] for r in got.collect()}
    assert held == {"31 23:30": 1.0, "01 00:00": 3.0, "01 00:30": 2.0, "01 03:00": 4.0, "01 02:30": 4.0}  # the row of minute 6 came too late


def test_duplicates_within_the_watermark(spark, tmp_path):
    schema = "k string, ts timestamp"
    batches = [[("a", at(0)), ("b", at(1))], [("a", at(3)), ("c", at(60))], [("a", at(61))]]
    got = played(spark, tmp_path, "first", batches, schema, lambda s: V.first_of_each(s, ["k"], "ts", "10 minutes"))
    assert sorted((r["k"], r["ts"].minute) for r in got.collect()) == [("a", 0), ("a", 1), ("b", 1), ("c", 0)]  # minutes 60 and 61 of a later hour
    table = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted((r["k"], r["ts"].minute) for r in V.first_of_each(table, ["k"], "ts", "10 minutes").collect()) == [("a", 0), ("b", 1), ("c", 0)]


def test_causes_and_effects_on_streams(spark, tmp_path):
    schema = "kind string, k long, ts timestamp"
    batches = [[("view", 1, at(0)), ("buy", 1, at(10)), ("view", 2, at(5))], [("buy", 2, at(20)), ("buy", 1, at(55))], [("view", 9, at(500)), ("buy", 9, at(501))], [("buy", 2, at(21)), ("view", 9, at(900)), ("buy", 9, at(990))]]

    def build(stream, how):
        side = lambda kind: stream.where(F.col("kind") == kind).select("k", "ts")
        return V.followed_by(side("view"), side("buy"), "k", "ts", "30 minutes", "10 minutes", how)

    pairs = played(spark, tmp_path, "inner", batches, schema, lambda s: build(s, "inner"))
    assert sorted((r["k"], (r["effect_ts"] - r["ts"]).seconds // 60) for r in pairs.collect()) == [(1, 10), (2, 15), (9, 1)]  # minute 21 was late
    alone = played(spark, tmp_path, "outer", batches + [[("view", 7, at(2000)), ("buy", 7, at(2001))]], schema, lambda s: build(s, "left_outer"))
    assert sorted(r["k"] for r in alone.where("effect_ts IS NULL").collect()) == [9]
