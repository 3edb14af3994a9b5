import os
import time

from pyspark.sql import functions as F

from quillon.operators import records as R
from quillon.sources import files


def test_listing_pairs_and_preference(spark, tmp_path):
    for name in ("a.png", "a.xml", "b.PNG", "c.nrm.png", "backup_1/a.png", "note.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    found = files.images(spark, str(tmp_path))
    assert sorted(r["name"] for r in found.collect()) == ["a.png", "a.png", "b.PNG", "c.nrm.png"]
    everything = files.listing(spark, str(tmp_path))
    paired, missing = files.pair_by_stem(files.listing(spark, str(tmp_path), "*.png", False), files.listing(spark, str(tmp_path), "*.xml"))
    assert [r["stem"] for r in paired.collect()] == ["a"] and [r["stem"] for r in missing.collect()] == ["c.nrm"]
    best = {r["stem"]: r["path"] for r in files.preferred(everything, ["xml", "png"]).collect()}
    assert best["a"].endswith("a.xml") and "note" not in best
    assert {r["name"] for r in files.name_index(everything).collect()} >= {"b.png", "note.txt"}


def test_latest_wins_and_skips_backups(spark, tmp_path):
    for folder, age in (("one", 100), ("two", 50), ("backup_x", 0)):
        path = tmp_path / folder / "doc.yaml"
        path.parent.mkdir()
        path.write_text("x")
        os.utime(path, (time.time() - age, time.time() - age))
    assert files.latest(files.listing(spark, str(tmp_path))).first()["path"].endswith("two/doc.yaml")


def test_checksums_and_manifests(spark):
    lines = spark.createDataFrame([("abc  pic.png",), ("bad",)], "l string")
    assert [tuple(r) for r in files.checksum_names(lines, "l").collect()] == [("abc", "pic.png")]
    two = '{"sequences":[{"canvases":[{"images":[{"resource":{"@id":"u1"}}]},{"images":[{"resource":{"@id":"u2"}}]}]}]}'
    three = '{"items":[{"items":[{"items":[{"body":{"id":"v1"}}]}]}]}'
    docs = spark.createDataFrame([(1, two), (2, three), (3, "{}"), (4, "not json")], "k long, c string")
    assert sorted(map(tuple, files.manifest_images(docs, ["k"], "c").collect())) == [(1, 0, "u1"), (1, 1, "u2"), (2, 0, "v1")]


def test_paths_and_splits(spark):
    rows = spark.createDataFrame([("a/train/x", "upstream"), ("a/TEST/train/x", "upstream"), ("a/x", "upstream"), ("a/x", "val_only")], "p string, m string")
    got = rows.select(files.resolve_split(F.col("m"), files.split_from_path(F.col("p")))).collect()
    assert [r[0] for r in got] == ["train", "val", "holdout_pending", "val"]
    assert [r[0] for r in rows.select(files.excluded(F.col("p"), ["train"], ["skip"])).collect()] == [True, True, False, False]


def test_stem_match_rules(spark):
    left = spark.createDataFrame([("p1",), ("p10_x",), ("zz",)], "stem string")
    right = spark.createDataFrame([("p1", "g/1"), ("p10", "g/10"), ("q", "g/q")], "stem string, path string")
    got = {tuple(r) for r in R.match_stems(left, right, "stem", "path").collect()}
    assert got == {("p1", "g/1", "exact"), ("p10_x", "g/1", "prefix")}


def test_small_projections(spark):
    df = spark.createDataFrame([(" ", "b", ["EN ", "la"], None), (None, None, None, ["la", ""])], "a string, b string, x array<string>, y array<string>")
    assert [r[0] for r in df.select(R.first_text(F.col("a"), F.col("b"))).collect()] == ["b", None]
    assert [r[0] for r in df.select(R.language_union(F.col("x"), F.col("y"))).collect()] == [["en", "la"], ["la"]]
