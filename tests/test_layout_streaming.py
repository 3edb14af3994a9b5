from pyspark.sql import functions as F

from quillon.sources import layout as L
from quillon.streaming import events as V


def test_page_errors_margins_and_round_trip(spark):
    good = '<PcGts xmlns="http://x"><Page imageFilename="p"><TextRegion id="r"><TextLine id="a" custom="structure {type:margin;}"><Coords points="0,0 5,5"/></TextLine><TextLine id="b"><Coords points="1,2 30,4 q,9"/><TextEquiv><Unicode>x &amp; y</Unicode></TextEquiv></TextLine><TextLine id="c"/></TextRegion></Page></PcGts>'
    docs = spark.createDataFrame([(1, good), (2, "<PcGts><Page>"), (3, "<other/>")], "id long, content string")
    rows = L.page_lines(docs, ["id"], "content").collect()
    lines = [(r["id"], r["line_id"], r["text"], tuple(r["bbox"])) for r in rows if r["error"] is None]
    assert lines == [(1, "b", "x & y", (1, 2, 30, 4))]
    assert {r["id"]: r["error"] for r in rows if r["error"]} == {2: "malformed", 3: "no Page"}
    gate = {r["id"]: (r["n_lines"], r["error"]) for r in L.page_gate(docs, ["id"], "content").collect()}
    assert gate == {1: (3, None), 2: (0, "malformed"), 3: (0, "no Page")}


def test_tei_body_only_and_malformed(spark):
    tei = "<TEI><teiHeader><title>head</title></teiHeader><text><body><p>one <b>two</b></p></body></text></TEI>"
    df = spark.createDataFrame([(tei,), ("<TEI>",), (None,)], "x string")
    assert [r[0] for r in df.select(L.tei_text(F.col("x"))).collect()] == ["one\ntwo", None, None]
    assert df.select(L.tei_text(F.col("x"), True)).first()[0] == "head\none\ntwo"


def test_csv_pads_and_quotes(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b,c"]), (1, 0, ["h"])], "t long, o long, cells array<string>")
    row = L.table_csv(df, ["t"], "o", "cells").first()
    assert (row["n_columns"], row["csv"]) == (2, 'h,\na,"b,c"')


def test_numbered_lines(spark):
    df = spark.createDataFrame([(1, "# c\n001: one\n12: no\n0002: two")], "k long, c string")
    assert [(r["number"], r["text"]) for r in L.numbered_lines(df, ["k"], "c").collect()] == [(1, "one"), (2, "two")]


def test_protected_folder(spark, tmp_path):
    try:
        L.write_jsonl(spark.range(1), str(tmp_path / "train" / "x"))
    except ValueError:
        pass
    else:
        raise AssertionError


def test_stream_windows(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = (
        V.tumbling(stream, "ts", "value", "event_type", "1 hour", "365 days").writeStream.outputMode("update").format("memory")
        .queryName("tumbled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    )
    query.awaitTermination()
    batch = {(r[0], r[1]): r["n"] for r in V.tumbling(events, "ts", "value", "event_type", "1 hour").collect()}
    streamed = {(r[0], r[1]): r["n"] for r in spark.sql("SELECT * FROM tumbled").orderBy("n").collect()}
    assert streamed == batch
