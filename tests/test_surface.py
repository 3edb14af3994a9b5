"""The data source, counts on the way of a write, and calls of models that fail."""

import json
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon import plugins
from quillon.functions import sql
from quillon.operators import curate as C
from quillon.operators import metrics
from quillon.sources import datasource
from quillon.sources import layout as L

PAGE = '<PcGts xmlns="http://x"><Page><TextRegion id="r"><TextLine id="a" custom="structure {type:margin;}"><Coords points="0,0 5,5"/></TextLine><TextLine id="b"><Coords points="1,2 30,4 q,9"/><TextEquiv><Unicode>x &amp; y</Unicode></TextEquiv></TextLine><TextLine id="c"/></TextRegion></Page></PcGts>'
ALTO = '<alto xmlns="http://x"><Layout><Page><TextLine ID="t" HPOS="1" VPOS="2" WIDTH="3" HEIGHT="4"><String CONTENT="one"/><String CONTENT="two"/></TextLine></Page></Layout></alto>'
TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>h</title></teiHeader><text><body><p>one <b>two</b></p></body></text></TEI>'


@pytest.fixture
def folder(tmp_path):
    deep = tmp_path / "deep"
    deep.mkdir()
    for name, content in (("a.xml", PAGE), ("deep/b.xml", ALTO), ("c.xml", TEI), ("bad.xml", "<PcGts><Page>"), ("none.xml", "<PcGts/>"), ("note.txt", "x")):
        (tmp_path / name).write_text(content)
    v2 = {"sequences": [{"canvases": [{"label": "1r", "images": [{"resource": {"@id": "u1"}}]}]}]}
    v3 = {"items": [{"label": {"en": ["1v"]}, "items": [{"items": [{"body": {"id": "u2"}}]}]}]}
    for name, content in (("m2.json", json.dumps(v2)), ("m3.json", json.dumps(v3)), ("m4.json", "{")):
        (tmp_path / name).write_text(content)
    return tmp_path


def test_documents_by_format(spark, folder):
    datasource.register(spark)
    rows = spark.read.format("layout").load(str(folder))
    got = {(r["path"].rsplit("/", 1)[1], r["line_no"]): (r["kind"], r["text"], r["x0"], r["y1"], r["error"]) for r in rows.collect()}
    assert got == {
        ("a.xml", 1): ("page", "x & y", 1, 4, None), ("b.xml", 0): ("alto", "one two", 1, 6, None), ("c.xml", 0): ("tei", "one", None, None, None), ("c.xml", 1): ("tei", "two", None, None, None),
        ("bad.xml", None): ("page", None, None, None, "malformed"), ("none.xml", None): ("page", None, None, None, "no Page"),
    }
    flat = spark.read.format("layout").option("recursive", "false").option("bytesPerPartition", 1).load(str(folder))
    assert flat.rdd.getNumPartitions() == 4 and flat.where("kind = 'alto'").isEmpty()
    manifests = spark.read.format("layout").option("pattern", "*.json").load(str(folder))
    assert sorted((str(r["line_id"]), str(r["text"]), str(r["error"])) for r in manifests.collect()) == [("1r", "u1", "None"), ("1v", "u2", "None"), ("None", "None", "malformed")]
    with pytest.raises(Exception, match="unknown kind"):
        spark.read.format("layout").option("kind", "pdf").load(str(folder)).collect()


def test_the_source_equals_the_shredders(spark, folder, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").limit(40).select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where("trim(text) <> ''")
    pages = L.build_page(turns, ["conv_id", "turn"], "line_no", "text").collect()
    for r in pages:
        (folder / "deep" / f"p{r['conv_id']}_{r['turn']}.xml").write_text(r["content"])
    datasource.register(spark)
    own = spark.read.format("layout").load(str(folder / "deep")).where("kind = 'page'").select("line_no", "line_id", "text", "x0", "y0", "x1", "y1", "error")
    shredded = L.page_lines(L.read_documents(spark, str(folder / "deep")).where("path LIKE '%/deep/p%'"), ["path"], "content")
    want = shredded.select("line_no", "line_id", "text", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", "error")
    assert sorted(map(str, own.collect())) == sorted(map(str, want.collect())) and own.count() > 50


def test_counts_come_with_the_write(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    reason = C.first_failing_reason([("lang", F.col("lang").isin("en", "de")), ("short", F.length("text") > 200)])
    judged = docs.withColumn("reason", reason)
    rows, seen = metrics.kept(judged, "reason", ["lang", "short"])
    rows.write.parquet(str(tmp_path / "out"))
    want = {r["reason"]: r["count"] for r in C.reject_histogram(judged, "reason").collect()}
    assert {k: seen.get[k] for k in ("lang", "short", "other")} == {"lang": 0, "short": 0, "other": 0} | want
    assert (seen.get["before"], seen.get["after"]) == (docs.count(), spark.read.parquet(str(tmp_path / "out")).count())
    assert metrics.drop_ratio(seen.get) == round(1 - seen.get["after"] / docs.count(), 6) and metrics.drop_ratio({"before": 0, "after": 0}) == 0.0


def test_progress_of_a_stream(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "in"))
    records = []
    log = metrics.ProgressLog(records.append)
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("seen", F.count("*").alias("n"), F.count_if(F.col("id") > 4).alias("large"))
        stream.writeStream.format("noop").queryName("q").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if any(r["event"] == "end" for r in records):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    batches = [r for r in records if r["event"] == "batch" and r["rows"]]
    assert sum(r["seen"]["n"] for r in batches) == 10 and sum(r["seen"]["large"] for r in batches) == 5 and records[0]["event"] == "start"


def test_flaky_models_and_poison_rows():
    lock, calls, pauses, live = threading.Lock(), [], [], [0, 0]

    def model(rows):
        with lock:
            calls.append(list(rows["id"]))
            live[0] += 1
            live[1] = max(live)
            n = sum(c == list(rows["id"]) for c in calls)
        time.sleep(0.01)
        with lock:
            live[0] -= 1
        if 7 in set(rows["id"]):
            raise ValueError("poison")
        if n == 1 and rows["id"].iloc[0] == 0:
            raise RuntimeError("busy")
        return pd.DataFrame({"twice": rows["id"] * 2})

    how = plugins.Calls(rows=4, concurrent=2, attempts=3, pause=0.5, sleep=pauses.append)
    parts = [pd.DataFrame({"id": range(i, i + 4)}) for i in (0, 4, 8)]
    pace = plugins._Pace(None)
    with plugins.ThreadPoolExecutor(how.concurrent) as pool:
        found = [x for part in pool.map(lambda p: plugins._answers(model, p, ["twice"], how, pace), parts) for x in part]
    assert [x[0] for x in found] == [0, 2, 4, 6, 8, 10, 12, None, 16, 18, 20, 22]
    assert found[7][1] == "poison" and all(x[1] is None for i, x in enumerate(found) if i != 7)
    assert found[0][2] == 2 and found[8][2] == 1 and live[1] <= 2
    assert pauses.count(0.5) >= 2 and 1.0 in pauses  # pauses grow
    assert sum(c == [7] for c in calls) == 3


def test_models_in_a_job(spark):
    def model(rows):
        if (rows["text"] == "bad").any():
            raise ValueError("no")
        return pd.DataFrame({"n": rows["text"].str.len(), "marks": [["x"]] * len(rows)})

    rows = spark.createDataFrame([(i, "bad" if i == 3 else "a" * i) for i in range(10)], "id long, text string").coalesce(1)
    got = {r["id"]: (r["n"], r["marks"], r["error"]) for r in plugins.call_model(rows, model, ["id"], "n long, marks array<string>", plugins.Calls(rows=4, pause=0.0)).collect()}
    assert got == {i: (None, None, "no") if i == 3 else (i, ["x"], None) for i in range(10)}


def test_calls_keep_their_pace():
    waits, pace = [], plugins._Pace(10.0)
    for _ in range(5):
        pace.wait(waits.append)
    assert len(waits) == 4 and 0.25 < waits[-1] <= 0.4


def test_sql_functions_on_nulls_and_bad_documents(spark):
    sql.register(spark)
    row = spark.sql("SELECT canonical_text(' Ünvj-2 '), word_list(NULL), line_error('', ''), line_error('abc', ''), safe_id('..'), size(word_slices(array('a')))").first()
    assert tuple(row) == ("unui 2", [], 0.0, 1.0, "job", 0)
    got = spark.sql("SELECT * FROM VALUES ('<PcGts><Page>'), ('<x/>'), (NULL) AS v(c), LATERAL page_rows(c) p").collect()
    assert sorted(r["error"] for r in got) == ["malformed", "no Page"]
