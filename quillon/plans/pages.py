"""Ground truth, boxes, figures, margins, tables and model reports over stand-in pages made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import evaluate as E
from quillon.operators import pages as P
from quillon.plans.evaluation import _BOX, _boxes
from quillon.plans.registry import query, table
from quillon.sources import layout as L

_B = "bx AS (SELECT vec_id, vec_id // 20 AS page, CAST(vec_id % 20 AS INT) AS line_idx, label, " + _BOX.format(v="CAST(embedding AS DOUBLE[])") + " AS box FROM embeddings)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    return rows.select("vec_id", F.floor(F.col("vec_id") / 20).alias("page"), (F.col("vec_id") % 20).cast("int").alias("line_idx"), "label", "box")


def _sql_iou(a: str, b: str) -> str:
    inter = f"greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0)"
    return f"CASE WHEN {inter} > 0 THEN {inter} / (({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0) + ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0) - {inter}) ELSE 0.0 END"


@query(f"""WITH {_B}, h AS (SELECT * FROM bx WHERE vec_id % 3 <> 0), r AS (SELECT page, line_idx, {{'x0': box.x0 + 4, 'y0': box.y0, 'x1': box.x1 + 4, 'y1': box.y1}} AS box, 'line ' || vec_id AS text FROM bx WHERE vec_id % 4 <> 0),
j AS (SELECT h.vec_id, r.line_idx, r.text, {_sql_iou('h.box', 'r.box')} AS s FROM h JOIN r ON h.page = r.page), b AS (SELECT vec_id, arg_max({{'i': line_idx, 't': text, 's': s}}, (s, -line_idx)) AS m FROM j WHERE s >= 0.3::DOUBLE GROUP BY vec_id)
SELECT h.page, h.line_idx, CASE WHEN m IS NOT NULL THEN 'iou' WHEN r.text IS NOT NULL THEN 'order' END AS method, coalesce(m.i, r.line_idx) AS ref_idx, round(m.s, 6) AS iou, coalesce(m.t, r.text) AS text
FROM h LEFT JOIN b USING (vec_id) LEFT JOIN r ON r.page = h.page AND r.line_idx = h.line_idx""")
def best_box_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page against the same page moved and thinned out: best overlap from 0.3 on, else the line of that number."""
    rows = _lines(spark, sf_dir)
    moved = F.struct((F.col("box.x0") + 4).alias("x0"), F.col("box.y0").alias("y0"), (F.col("box.x1") + 4).alias("x1"), F.col("box.y1").alias("y1"))
    refs = rows.where("vec_id % 4 <> 0").select("page", "line_idx", moved.alias("box"), F.concat(F.lit("line "), F.col("vec_id").cast("string")).alias("text"))
    return P.best_boxes(rows.where("vec_id % 3 <> 0").select("page", "line_idx", "box"), refs, ["page"])


@query(f"""WITH {_B} SELECT vec_id, greatest(0, least(box.x0 - 6, 90)) AS x0, greatest(0, least(box.y0 - 6, 120)) AS y0, greatest(0, least(box.x1 + 6, 90)) AS x1, greatest(0, least(box.y1 + 6, 120)) AS y1 FROM bx""")
def padded_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop boxes with a margin of six, within a page of 90 x 120."""
    box = P.padded_box(F.col("box"), F.lit(90), F.lit(120))
    return _lines(spark, sf_dir).select("vec_id", box.alias("b")).select("vec_id", "b.*")


@query(f"""WITH {_B}, f AS (SELECT page, vec_id, box, CASE label % 3 WHEN 0 THEN 'Figure' WHEN 1 THEN 'table' ELSE 'Text' END AS label, (label % 10) / 10.0 AS confidence FROM bx),
k AS (SELECT *, 'fig_' || lpad(CAST(row_number() OVER (PARTITION BY page ORDER BY vec_id) AS VARCHAR), 2, '0') AS figure FROM f WHERE lower(label) IN ('figure', 'table') AND confidence >= 0.2 AND (box.x1 - box.x0) * (box.y1 - box.y0) / 10000.0 >= 0.05)
SELECT k.page, figure, k.label, coalesce(max(bx.line_idx) FILTER ((bx.box.y0 + bx.box.y1) / 2.0 < k.box.y0), 0) AS anchor FROM k JOIN bx USING (page) GROUP BY k.page, figure, k.label, k.box""")
def figure_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure and large figures of a page, each after the last line above it."""
    rows = _lines(spark, sf_dir)
    kind = F.when(F.col("label") % 3 == 0, "Figure").when(F.col("label") % 3 == 1, "table").otherwise("Text")
    found = rows.select("page", F.col("vec_id").alias("order"), kind.alias("label"), ((F.col("label") % 10) / 10).alias("confidence"), "box", F.lit(10_000.0).alias("page_area"))
    centres = rows.select("page", F.col("line_idx").alias("line_no"), ((F.col("box.y0") + F.col("box.y1")) / 2).alias("centre"))
    kept = P.figures(found, "page", ["figure", "table"], 0.2, 0.05)
    return P.anchors(kept, centres, "page").select("page", "figure", "label", "anchor")


@query("""WITH l AS (SELECT o_orderkey AS page, unnest(range(1, 31)) AS line_no FROM orders),
s AS (SELECT l_orderkey AS page, l_linenumber AS segment, CAST(l_quantity AS INT) % 20 AS lo, CAST(l_quantity AS INT) % 20 + l_linenumber * 2 AS hi FROM lineitem)
SELECT l.page, CAST(l.line_no AS INT) AS line_no, min(s.segment) FILTER (s.lo <= l.line_no AND l.line_no <= s.hi) AS segment FROM l LEFT JOIN s ON s.page = l.page GROUP BY l.page, l.line_no""")
def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first segment that covers each line of a page."""
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("line_no"))
    lo = F.col("l_quantity").cast("int") % 20
    segments = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("segment"), lo.alias("lo"), (lo + F.col("l_linenumber") * 2).alias("hi"))
    return P.first_covering(lines, segments, "page")


@query(r"""SELECT doc_id, md5(array_to_string(list_concat(string_split(text, chr(10))[1:least(len(string_split(text, chr(10))), doc_id % 5)], ['[fig:' || doc_id || ']'], string_split(text, chr(10))[least(len(string_split(text, chr(10))), doc_id % 5) + 1:]), chr(10))) AS marked
FROM documents WHERE text IS NOT NULL""")
def figure_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure's mark put after a line of every document."""
    mark = F.concat(F.lit("[fig:"), F.col("doc_id").cast("string"), F.lit("]"))
    marked = P.insert_mark(F.col("text"), (F.col("doc_id") % 5 - 1).cast("int"), mark)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(marked).alias("marked"))


@query(f"""WITH {_B}, s AS (SELECT page, count(*) AS n, median(box.x1 - box.x0) AS m, quantile_cont(box.x0, 0.25) AS l, quantile_cont(box.x1, 0.75) AS r FROM bx GROUP BY page)
SELECT page, line_idx AS line_no, box.x0 AS x0, box.x1 AS x1, n >= 4 AND box.x1 - box.x0 < 0.35::DOUBLE * m AND (box.x1 < l OR box.x0 > r) AS margin FROM bx JOIN s USING (page)""")
def margin_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the margin of their page."""
    rows = _lines(spark, sf_dir).select("page", F.col("line_idx").alias("line_no"), F.col("box.x0").alias("x0"), F.col("box.x1").alias("x1"))
    return P.margin_lines(rows, "page")


_KNOWN = {"calendar": ["day", "name"], "accounts": ["item", "sum", "note"]}
_SEGMENTS = """sg AS (SELECT user_id, event_id, CASE event_id % 7 WHEN 0 THEN 'table_header' WHEN 1 THEN 'table_row' WHEN 2 THEN 'table_row' WHEN 3 THEN 'table_row' ELSE 'body' END AS position, event_type || ' | ' || event_id || ' |' || user_id AS text,
  CASE WHEN event_id % 5 = 0 THEN 'tableType: calendar' WHEN event_id % 5 = 1 THEN 'x; tableType:accounts.' END AS notes FROM events)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, five = F.col("event_id") % 7, F.col("event_id") % 5
    position = F.when(k == 0, "table_header").when(k <= 3, "table_row").otherwise("body")
    text = F.concat("event_type", F.lit(" | "), F.col("event_id").cast("string"), F.lit(" |"), F.col("user_id").cast("string"))
    notes = F.when(five == 0, "tableType: calendar").when(five == 1, "x; tableType:accounts.")
    return table(spark, sf_dir, "events").select("user_id", "event_id", position.alias("position"), text.alias("text"), notes.alias("notes"))


@query(rf"""WITH {_SEGMENTS}, i AS (SELECT *, position <> 'body' AS inside, coalesce(lag(position <> 'body') OVER w, false) AS was FROM sg WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, sum((inside AND NOT was)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS table_no, list_transform(string_split(text, '|'), lambda x: trim(x)) AS cells, nullif(regexp_extract(notes, 'tableType:\s*([\w-]+)', 1), '') AS kind FROM i),
t AS (SELECT user_id, table_no, coalesce(first(kind ORDER BY event_id) FILTER (kind IS NOT NULL), 'unknown') AS type, last(cells ORDER BY event_id) FILTER (position = 'table_header') AS head, coalesce(list(cells ORDER BY event_id) FILTER (position = 'table_row'), []) AS rows FROM n WHERE inside GROUP BY user_id, table_no)
SELECT user_id, CAST(table_no AS BIGINT) AS table_no, type, array_to_string(coalesce(head, CASE type WHEN 'calendar' THEN ['day', 'name'] WHEN 'accounts' THEN ['item', 'sum', 'note'] ELSE [] END), ';') AS columns, CAST(len(rows) AS BIGINT) AS n_rows, array_to_string(list_transform(rows, lambda r: array_to_string(r, ';')), '/') AS rows FROM t""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of runs of table rows in every user's events."""
    found = P.tables(_segments(spark, sf_dir), "user_id", "event_id", "position", "text", "notes", _KNOWN)
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "/")
    return found.select("user_id", "table_no", "type", F.array_join("columns", ";").alias("columns"), F.size("rows").cast("long").alias("n_rows"), cells.alias("rows"))


@query(rf"""WITH {_SEGMENTS}, i AS (SELECT *, position <> 'body' AS inside, coalesce(lag(position <> 'body') OVER w, false) AS was FROM sg WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, sum((inside AND NOT was)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM i)
SELECT user_id, CAST(count(DISTINCT t) FILTER (inside) AS BIGINT) AS n_tables, CAST(count(*) FILTER (position = 'table_row') AS BIGINT) AS n_rows FROM n GROUP BY user_id HAVING count(*) FILTER (inside) > 0""")
def tables_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's tables as one JSON array, read back and counted."""
    found = P.tables(_segments(spark, sf_dir), "user_id", "event_id", "position", "text", "notes", _KNOWN)
    back = F.from_json("tables", "array<struct<type:string,columns:array<string>,rows:array<array<string>>>>")
    rows = P.tables_json(found, "user_id").select("user_id", back.alias("t"))
    n = F.aggregate("t", F.lit(0), lambda a, t: a + F.size(t["rows"]))
    return rows.select("user_id", F.size("t").cast("long").alias("n_tables"), n.cast("long").alias("n_rows"))


def _page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PAGE document of every conversation, a line a turn."""
    return L.build_page(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")


@query(r"""SELECT conv_id, trim(regexp_replace(array_to_string(list(text ORDER BY turn) FILTER (length(trim(text)) > 0), ' '), '\s+', ' ', 'g')) AS text FROM conversations GROUP BY conv_id""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined text of PAGE documents that were made of conversations."""
    lines = L.page_lines(_page_docs(spark, sf_dir), ["conv_id"], "content")
    return P.joined_text(lines, ["conv_id"], ["region_no", "line_no"], "text")


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, conv_id % 4 NOT IN (1, 2) AS ok, CASE conv_id % 4 WHEN 1 THEN 'no image' WHEN 2 THEN 'image size (1000x1) is not the page''s (1000x' || n * 40 || ')' ELSE n || ' lines, 1000x' || n * 40 END AS message FROM n""")
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAGE documents against their images, of which some are missing and some of another size."""
    docs = L.page_sizes(_page_docs(spark, sf_dir), ["conv_id"], "content")
    images = docs.where("conv_id % 4 <> 1").select("conv_id", "width", F.when(F.col("conv_id") % 4 == 2, 1).otherwise(F.col("height")).alias("height"))
    return P.check_pages(docs, images, "conv_id")


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS n_lines, max(turn * 40 + 40) * 3 AS bottom, 1500 AS right_edge FROM conversations GROUP BY conv_id""")
def page_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAGE documents with their points scaled by 1.5 and 3, read again."""
    docs = _page_docs(spark, sf_dir).withColumn("content", P.rescale_points(F.col("content"), F.lit(1.5), F.lit(3.0)))
    rows = L.page_lines(docs, ["conv_id"], "content").groupBy("conv_id")
    return rows.agg(F.count("*").alias("n_lines"), F.max("bbox.y1").cast("long").alias("bottom"), F.max("bbox.x1").alias("right_edge"))


@query("""WITH l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text FROM conversations)
SELECT conv_id, i - 1 AS line_no, CASE WHEN i % 2 = 1 THEN 'line ' || i || ' & <more>' ELSE text END AS text FROM l""")
def text_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed texts put into every other line of PAGE documents, by number."""
    numbers = F.filter(F.sequence(F.lit(1), F.lit(400)), lambda i: i % 2 == 1)
    typed = F.map_from_arrays(numbers, F.transform(numbers, lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" & <more>"))))
    docs = _page_docs(spark, sf_dir).withColumn("content", P.inject_lines(F.col("content"), typed))
    return L.page_lines(docs, ["conv_id"], "content").select("conv_id", F.col("line_no").cast("long").alias("line_no"), "text")


@query("""WITH l AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, '# source: ' || conv_id || '.xml' || chr(10) || '# ' || n || ' lines; blank ones are skipped' || chr(10) || array_to_string(list_transform(range(1, n + 1), lambda i: lpad(CAST(i AS VARCHAR), 3, '0') || ': '), chr(10)) || chr(10) AS template FROM l""")
def text_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered templates for PAGE documents."""
    docs = L.page_gate(_page_docs(spark, sf_dir), ["conv_id"], "content")
    return docs.select("conv_id", P.template(F.col("n_lines"), F.concat(F.col("conv_id").cast("string"), F.lit(".xml"))).alias("template"))


@query(f"""WITH {_B}, c AS (SELECT page, line_idx AS channel, box.x1 - box.x0 + 0.0 AS mass, label / 100.0 AS peak FROM bx), g AS (SELECT *, mass >= 40 OR peak >= 0.08 AS good, bool_or(mass >= 40 OR peak >= 0.08) OVER (PARTITION BY page) AS anyone FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY mass DESC, channel) AS place FROM g WHERE good OR NOT anyone), k AS (SELECT * FROM r WHERE (anyone AND place <= 5) OR (NOT anyone AND place = 1))
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY channel) - 1 AS INT) AS place, channel FROM k""")
def mask_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five heaviest channels of a page that hold a line, in their order."""
    rows = _lines(spark, sf_dir).select("page", F.col("line_idx").alias("channel"), (F.col("box.x1") - F.col("box.x0")).cast("double").alias("mass"), (F.col("label") / 100).alias("peak"))
    return P.channel_lines(rows, "page", 40.0, 0.08, 5)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars, words = F.length("p_name") * 20, F.size(F.split("p_name", " ")) * 9
    rate = lambda n, d: F.round((F.col("p_partkey") * n) % d / 97.0, 4)
    return table(spark, sf_dir, "part").select("p_brand", rate(31, 701).alias("cer"), rate(17, 997).alias("wer"), chars.cast("long").alias("n_chars"), words.cast("long").alias("n_words"))


@query("""WITH c AS (SELECT p_brand, round(((p_partkey * 31) % 701) / 97.0::DOUBLE, 4) AS cer, round(((p_partkey * 17) % 997) / 97.0::DOUBLE, 4) AS wer, length(p_name) * 20 AS n_chars, len(string_split(p_name, ' ')) * 9 AS n_words FROM part),
r AS (SELECT p_brand, count(*) AS n_cases, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(n_words) AS BIGINT) AS n_words, round(sum(round_even(cer * n_chars / 100, 0)) / sum(n_chars) * 100, 4) AS cer, round(sum(round_even(wer * n_words / 100, 0)) / sum(n_words) * 100, 4) AS wer FROM c GROUP BY p_brand)
SELECT *, CASE WHEN cer < 1 AND wer < 2 THEN 'PASS' WHEN cer < 3 AND wer < 5 THEN 'COND_PASS' ELSE 'FAIL' END AS disposition FROM r""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of made-up scored cases by corpus, from each case's rounded rates."""
    return E.report(_cases(spark, sf_dir), ["p_brand"])


@query("""WITH m AS (SELECT p_brand AS gt, CASE WHEN p_size % 2 = 0 THEN 'base' ELSE 'new' END AS model, round(avg(p_size) / 500, 6) AS cer, round(avg(p_retailprice) / 9000, 6) AS wer FROM part GROUP BY ALL)
SELECT b.gt, round(b.cer * 100, 3) AS base_cer, round(n.cer * 100, 3) AS candidate_cer, round(b.wer * 100, 3) AS base_wer, round(n.wer * 100, 3) AS candidate_wer, round(n.cer * 100 - b.cer * 100, 3) AS delta_cer, round(n.wer * 100 - b.wer * 100, 3) AS delta_wer,
  CASE WHEN n.cer * 100 - b.cer * 100 < -1 THEN 'clearly better' WHEN n.cer * 100 - b.cer * 100 < -0.2 THEN 'slightly better' WHEN abs(n.cer * 100 - b.cer * 100) <= 0.2 THEN 'equivalent' WHEN n.cer * 100 - b.cer * 100 > 1 THEN 'clearly worse' ELSE 'slightly worse' END AS verdict
FROM m b JOIN m n ON b.gt = n.gt AND b.model = 'base' AND n.model = 'new'""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of two made-up models on the same ground truth."""
    model = F.when(F.col("p_size") % 2 == 0, "base").otherwise("new")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gt"), model.alias("model"))
    rows = rows.agg(F.round(F.avg("p_size") / 500, 6).alias("cer"), F.round(F.avg(F.col("p_retailprice").cast("double")) / 9000, 6).alias("wer"))
    return E.compare_models(rows, "base", "new", "gt")


@query("""WITH p AS (SELECT o_orderkey, o_orderkey % 5 AS n_ref, o_orderkey % 7 AS n_hyp, least(o_orderkey % 5, o_orderkey % 7) AS n_matched, CAST(o_orderkey % 13 AS DOUBLE) / 4 AS g FROM orders),
q AS (SELECT n_ref, n_hyp, n_matched, CASE WHEN n_ref > 0 THEN n_matched / n_ref ELSE 1.0 END AS recall, CASE WHEN n_hyp > 0 THEN n_matched / n_hyp ELSE 1.0 END AS precision, CASE WHEN n_matched > 0 THEN g END AS chamfer, n_ref > 0 AND n_hyp > 0 AS usable FROM p)
SELECT count(*) FILTER (usable) AS n_pages, count(*) FILTER (NOT usable) AS n_skipped, round(avg(recall) FILTER (usable), 6) AS recall, round(avg(precision) FILTER (usable), 6) AS precision, round(sum(chamfer * n_matched) FILTER (usable) / sum(n_matched) FILTER (usable AND chamfer IS NOT NULL), 6) AS chamfer FROM q""")
def baseline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision as means over pages, chamfer distance over all matches, of made-up pages."""
    key = F.col("o_orderkey")
    n = F.least(key % 5, key % 7)
    share = lambda d: F.when(d > 0, n / d).otherwise(F.lit(1.0))
    rows = table(spark, sf_dir, "orders").select(
        (key % 5).alias("n_ref"), (key % 7).alias("n_hyp"), n.alias("n_matched"), share(key % 5).alias("recall"), share(key % 7).alias("precision"), F.when(n > 0, (key % 13).cast("double") / 4).alias("chamfer")
    )
    return P.baseline_report(rows)


@query("""WITH m AS (SELECT s_suppkey, s_suppkey % 4 AS k, (s_suppkey % 40) / 100.0::DOUBLE AS x FROM supplier), r AS (SELECT 'model ' || s_suppkey AS name, k, CASE k WHEN 0 THEN x WHEN 1 THEN 1 - (1 - x) WHEN 2 THEN (x + 0.1::DOUBLE) / 2 END AS cer, CASE WHEN k <> 1 THEN 1 - (1 - x * 2) END AS wer, s_suppkey % 5 <> 0 AS ready FROM m),
q AS (SELECT name, cer, wer, CASE WHEN NOT ready THEN 'not held out' WHEN cer IS NULL OR wer IS NULL THEN 'no error rate' WHEN cer > 0.15::DOUBLE THEN 'character errors' WHEN wer > 0.5::DOUBLE THEN 'word errors' ELSE 'ok' END AS reason FROM r)
SELECT name, round(cer, 6) AS cer, round(wer, 6) AS wer, reason, reason = 'ok' AS allowed, reason NOT IN ('character errors', 'word errors') AND coalesce(cer <= 0.15::DOUBLE, false) AS recommended FROM q""")
def correct_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether made-up models may correct silently; rates are held out, from accuracy, or means over corpora."""
    k, x = F.col("s_suppkey") % 4, (F.col("s_suppkey") % 40) / 100
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("model "), F.col("s_suppkey").cast("string")).alias("name"), F.when(k == 0, x).alias("held_out_cer"), F.lit(None).cast("double").alias("held_out_wer"), F.when(k == 1, 1 - x).alias("val_accuracy"),
        F.when(k != 1, 1 - x * 2).alias("val_word_accuracy"), F.when(k == 2, F.create_map(F.lit("a"), x, F.lit("b"), F.lit(0.1))).alias("per_corpus"), (F.col("s_suppkey") % 5 != 0).alias("held_out_ready"),
    )
    return E.correct_gate(rows)
