"""Layout documents made of conversations, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import layout as L
from quillon.streaming import events as V
from quillon.plans.registry import query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of every conversation turn, blanks squeezed."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    text = F.trim(F.regexp_replace("raw", r"\s+", " "))
    return turns.select("conv_id", "turn", "line_no", text.alias("text")).where("text <> ''")


_LINES = r"""l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM conversations),
t AS (SELECT conv_id, turn, CAST(line_no AS BIGINT) AS line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM l), k AS (SELECT * FROM t WHERE text <> '')"""


@query(f"WITH {_LINES} SELECT conv_id, turn, 'l' || line_no AS line_id, text, line_no * 40 AS y0, line_no * 40 + 40 AS y1 FROM k")
def page_xml_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn written as a PAGE document and read back line by line."""
    pages = L.build_page(_lines(spark, sf_dir), ["conv_id", "turn"], "line_no", "text")
    rows = L.page_lines(pages, ["conv_id", "turn"], "content")
    y = lambda k: F.col(f"bbox.{k}").cast("long").alias(k)
    return rows.select("conv_id", "turn", "line_id", "text", y("y0"), y("y1"))


@query(f"WITH {_LINES} SELECT conv_id, turn, count(*) AS n_lines, 1::BIGINT AS n_regions, NULL::VARCHAR AS error FROM k GROUP BY conv_id, turn")
def page_xml_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = L.build_page(_lines(spark, sf_dir), ["conv_id", "turn"], "line_no", "text")
    return L.page_gate(pages, ["conv_id", "turn"], "content")


@query(f"WITH {_LINES} SELECT conv_id, turn, line_no * 40 AS y0, text FROM k")
def alto_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = L.build_alto(_lines(spark, sf_dir), ["conv_id", "turn"], "line_no", "text")
    rows = L.alto_lines(pages, ["conv_id", "turn"], "content")
    return rows.select("conv_id", "turn", F.col("bbox.y0").cast("long").alias("y0"), "text")


@query(f"""
WITH {_LINES}, s AS (SELECT conv_id, turn, string_agg(text, chr(10) ORDER BY line_no) AS text FROM k GROUP BY conv_id, turn)
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM s GROUP BY conv_id
""")
def tei_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered as TEI (user turns as body, answers as margins) and their text read back."""
    lines = _lines(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    position = F.when(F.col("turn") % 2 == 0, "body").otherwise("margin_left")
    segments = lines.select("conv_id", "turn", position.alias("position"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    tei = L.render_tei(segments, ["conv_id"], "turn", "position", "text")
    return tei.select("conv_id", L.tei_text(F.col("tei")).alias("text"))


@query("""
WITH r AS (SELECT conv_id, turn, list_transform(string_split(text, ','), lambda x: trim(x, chr(10) || ' ')) AS c FROM conversations),
w AS (SELECT *, max(len(c)) OVER (PARTITION BY conv_id) AS n FROM r),
p AS (SELECT conv_id, turn, n, list_transform(list_concat(c, list_transform(range(n - len(c)), lambda i: '')), lambda v: CASE WHEN regexp_matches(v, '[",' || chr(10) || ']') THEN '"' || replace(v, '"', '""') || '"' ELSE v END) AS c FROM w)
SELECT conv_id, any_value(n) AS n_columns, string_agg(array_to_string(c, ','), chr(10) ORDER BY turn) AS csv FROM p GROUP BY conv_id
""")
def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns taken as rows of cells between commas, one padded table per conversation."""
    cells = F.transform(F.split("text", ","), lambda x: F.trim(x, F.lit("\n ")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", cells.alias("cells"))
    return L.table_csv(rows, ["conv_id"], "turn", "cells")


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.tumbling(table(spark, sf_dir, "events"), "ts", "value", "event_type", "1 hour")


@query("""
SELECT b - to_minutes(CAST(15 * k AS BIGINT)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events), (SELECT unnest(range(4)) AS k) GROUP BY ALL
""")
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every hour that begins at a quarter."""
    return V.sliding(table(spark, sf_dir, "events"), "ts", "value", "event_type", "1 hour", "15 minutes")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY user_id, event_type")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind and user."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return V.first_of_each(rows, ["user_id", "event_type"], "ts", "1 hour").select("user_id", "event_type", "event_id", "ts")


@query("""
SELECT v.user_id, v.event_id, v.ts, p.event_id AS effect_event_id, p.ts AS effect_ts FROM events v JOIN events p ON p.user_id = v.user_id AND p.event_type = 'purchase'
  AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 12 HOUR WHERE v.event_type = 'view'
""")
def followed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and the purchases of the same user in the twelve hours after them."""
    rows = table(spark, sf_dir, "events")
    side = lambda kind: rows.where(F.col("event_type") == kind).select("user_id", "event_id", "ts")
    return V.followed_by(side("view"), side("purchase"), "user_id", "ts", "12 hours")


@query("""
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS new FROM events),
s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, new DESC) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_last, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")


@query(f"WITH {_LINES}, m AS (SELECT conv_id, turn, line_no, text FROM k) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY line_no) - 1 AS place, text, line_no * 40 AS y0, line_no * 40 + 20 AS base FROM m")
def alto_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as ALTO, turned into PAGE and read back."""
    keys = ["conv_id", "turn"]
    pages = L.alto_to_page(L.build_alto(_lines(spark, sf_dir), keys, "line_no", "text"), keys, "content")
    rows = L.page_lines(pages, keys, "content")
    return rows.select(*keys, F.col("line_no").cast("long").alias("place"), "text", F.col("bbox.y0").cast("long").alias("y0"), F.get("baseline", 0)["y"].cast("long").alias("base"))


@query("""SELECT p_partkey, p_name AS text, 10 + p_size AS right_edge, least(p_size - 1, CAST(round_even(p_size * 0.8, 0) AS INT)) AS base FROM part""")
def line_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line images of made-up sizes as PAGE documents, read back."""
    page = L.strip_page((F.col("p_size") + 10).cast("int"), F.col("p_size").cast("int"), F.col("p_name"), F.lit("a & b.png"))
    rows = L.page_lines(table(spark, sf_dir, "part").select("p_partkey", page.alias("content")), ["p_partkey"], "content")
    return rows.select("p_partkey", "text", F.col("bbox.x1").alias("right_edge"), F.get("baseline", 0)["y"].cast("int").alias("base"))


@query(r"""WITH s AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN 'table_header' WHEN 1 THEN 'table_row' WHEN 2 THEN 'table_row' WHEN 3 THEN 'margin_left' ELSE 'body' END AS p FROM events),
i AS (SELECT *, p LIKE 'table%' AS t, coalesce(lag(p LIKE 'table%') OVER w, false) AS b, coalesce(lead(p LIKE 'table%') OVER w, false) AS a FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
x AS (SELECT user_id, event_id, CASE WHEN t THEN CASE WHEN NOT b THEN '<table>' ELSE '' END || CASE WHEN p = 'table_header' THEN '<row role="label">' ELSE '<row>' END || '<cell>' || event_id || '</cell><cell>&lt;x&gt;</cell></row>' || CASE WHEN NOT a THEN '</table>' ELSE '' END
  ELSE CASE WHEN p = 'body' THEN '<p rend="body">' ELSE '<add place="margin_left">' END || '<lb n="' || (event_id % 9) || '"/>' || event_id || ' | &lt;x&gt;' || CASE WHEN p = 'body' THEN '</p>' ELSE '</add>' END END AS h FROM i)
SELECT user_id, md5('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>' || array_to_string(list(h ORDER BY event_id), '') || '</body></text></TEI>') AS tei FROM x GROUP BY user_id""")
def tei_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as TEI: runs of table rows as tables, lines numbered from a range."""
    k = F.col("event_id") % 5
    position = F.when(k == 0, "table_header").when(k <= 2, "table_row").when(k == 3, "margin_left").otherwise("body")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", position.alias("p"), F.concat(F.col("event_id").cast("string"), F.lit(" | <x>")).alias("t"), F.concat((F.col("event_id") % 9).cast("string"), F.lit("-12")).alias("r"))
    tei = L.render_tei_tables(rows, ["user_id"], "event_id", "p", "t", "r")
    return tei.select("user_id", F.md5("tei").alias("tei"))
