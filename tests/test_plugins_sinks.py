import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon import plugins
from quillon.operators import fingerprint
from quillon.sources import catalogues, sinks


def test_backends_by_script_and_failed_pages(spark):
    def shout(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["page"] == 3).any():
            raise ValueError("no ink")
        return pd.DataFrame({"text": batch["image"].str.upper(), "n_lines": 1, "confidence": 0.75})

    pages = spark.createDataFrame([(1, "abc", ["latin"]), (2, "def", ["greek"]), (3, "x", ["latin"])], "page long, image string, scripts array<string>")
    backends = plugins.Backends()
    with pytest.raises(ValueError):
        backends.recognise(pages, "page")
    backends.register("latin reader", shout, {"latin"})
    backends.register("any reader", shout)
    got = {(r["page"], r["backend"]): (r["text"], r["error"]) for r in backends.recognise(pages, "page").collect()}
    assert got == {
        (1, "latin reader"): ("ABC", None), (3, "latin reader"): (None, "no ink"), (1, "any reader"): ("ABC", None), (2, "any reader"): ("DEF", None), (3, "any reader"): (None, "no ink"),
    }


def test_callables_by_import_string():
    assert plugins.load_callable("json:dumps")([1]) == "[1]"
    for bad, error in (("json", ValueError), (":x", ValueError), ("json:nothing", TypeError)):
        with pytest.raises(error):
            plugins.load_callable(bad)


def test_masks_lines_and_expansion(spark):
    mask = np.zeros((5, 4))
    mask[2:5, 1] = 1
    mask[0, 3] = 0.6
    assert plugins.mask_points(mask) == ([1.0, 3.0], [3.0, 0.0])
    assert len(plugins.mask_points(np.ones((3, 2000)))[0]) == 500
    pages = spark.createDataFrame([(1,)], "page long")
    lines = plugins.draw_lines(pages, lambda b: pd.DataFrame({"page": b["page"], "line_no": 0, "xs": [[0.0, 5.0]], "ys": [[1.0, 2.0]]}), "page").first()
    assert [tuple(p) for p in lines["points"]] == [(0.0, 1.0), (5.0, 2.0)]
    text = spark.createDataFrame([(1, "dns"), (2, "et")], "line long, text string")
    out = plugins.expand_lines(text, lambda b: b.assign(text=b["text"].str.replace("dns", "dominus")), ["line"], "text").orderBy("line").collect()
    assert [(r["expanded"], r["changed"]) for r in out] == [("dominus", True), ("et", False)]


def test_steps_run_where_they_apply(spark):
    class Step:
        def __init__(self, name, column):
            self.name, self.column = name, column

        def applies(self, rows):
            return self.column in rows.columns

        def run(self, rows):
            return rows.withColumn(self.name, F.length(self.column))

    rows, taken = plugins.run_steps(spark.createDataFrame([("abc",)], "text string"), [Step("n", "text"), Step("m", "missing")])
    assert taken == ["n"] and rows.first()["n"] == 3


def test_manifests_splits_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1.xml", "train"), ("a", "2.xml", "val"), ("b", None, "train")], "corpus string, xml string, part string")
    sinks.write_manifests(rows.where("xml IS NOT NULL"), f"{tmp_path}/m")
    assert {r["value"]: r["part"] for r in spark.read.option("basePath", f"{tmp_path}/m/list").text(f"{tmp_path}/m/list/*").collect()} == {"1.xml": "train", "2.xml": "val"}
    assert spark.read.json(f"{tmp_path}/m/stats").collect()[0].asDict() == {"corpus": "a", "train": 1, "val": 1}
    with pytest.raises(ValueError):
        sinks.write_split(rows, f"{tmp_path}/training/x", "xml", "part")
    sinks.write_phases(rows, f"{tmp_path}/p", {"all": F.lit(True), "a": F.col("corpus") == "a"}, {"one": ("base", "all")})
    assert spark.read.text(f"{tmp_path}/p/list").groupBy("manifest").count().count() == 2
    log = spark.createDataFrame([(1, 1, "edit"), (1, 2, "accept"), (2, 1, "reject")], "line long, at long, action string")
    sinks.append_decisions(log.where("at = 1"), f"{tmp_path}/log")
    sinks.append_decisions(log.where("at = 2"), f"{tmp_path}/log")
    last = sinks.latest_decisions(spark.read.json(f"{tmp_path}/log"), ["line"], "at").collect()
    assert {r["line"]: r["action"] for r in last} == {1: "accept", 2: "reject"}
    report = sinks.batch_rows(log.select("line"), log.select("line", F.lit("x").alias("error")), log.limit(0).select("line"), "line")
    assert report.groupBy("status").count().count() == 2


def test_fingerprints_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, 0, "the cat and the dog " * 10), (1, 1, None), (2, 0, "")], "book long, page long, text string")
    made = fingerprint.fingerprints(pages, "book", "page", "text", ["the", "and"], ["th"], ["the"])
    sinks.save_fingerprints(made, f"{tmp_path}/f")
    back = sinks.load_fingerprints(spark, f"{tmp_path}/f")
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect())) and back.count() == 2
    pair = fingerprint.compare_all(back, "book", ["the", "and"]).collect()
    assert [(r["a"], r["b"], r["vector_cosine"]) for r in pair] == [(1, 2, 1.0)]


def test_registry_of_yaml_records(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: x\nlanguages: [lat]\n")
    (tmp_path / "b.yml").write_text(": : :\n-")
    got = catalogues.registry(spark, str(tmp_path), "name string, languages array<string>").collect()
    assert [(r["name"], r["languages"]) for r in got] == [("x", ["lat"])]
