"""PAGE and ALTO documents to rows and back, TEI and tables out, line files in.

Readers take a string column and shred it with Spark's XML functions: a broken document is a row with an error,
never a failure of the job.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.evaluate import parse_points

_LINE = "struct<_id:string,_custom:string,Coords:struct<_points:string>,Baseline:struct<_points:string>,TextEquiv:struct<Unicode:string>>"
PAGE_SCHEMA = f"Page struct<_imageFilename:string,_imageWidth:int,_imageHeight:int,TextRegion:array<struct<_id:string,TextLine:array<{_LINE}>>>>, _corrupt_record string"
ALTO_SCHEMA = "Layout struct<Page:struct<PrintSpace:struct<TextBlock:array<struct<TextLine:array<struct<_HPOS:string,_VPOS:string,_WIDTH:string,_HEIGHT:string,String:array<struct<_CONTENT:string>>>>>>>>>, _corrupt_record string"


def escape(text: Column) -> Column:
    """Text for an XML element or a double-quoted attribute."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def read_documents(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """``path, content`` of every matching file, whole."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return files.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; blank lines are skipped, bad ones have ``_corrupt_record``."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def numbered_lines(texts: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``keys, number, text`` of the ``007: text`` lines of a file; comments and other lines are skipped."""
    rows = texts.select(*keys, F.explode(F.split(content, "\r?\n")).alias("line")).where(F.col("line").rlike(r"^\d{3,}:"))
    pattern = r"^(\d{3,}):\s*(.*)$"
    return rows.select(*keys, F.regexp_extract("line", pattern, 1).cast("int").alias("number"), F.regexp_extract("line", pattern, 2).alias("text"))


def _error(doc: Column, root: str) -> Column:
    return F.when(doc["_corrupt_record"].isNotNull(), "malformed").when(doc[root].isNull(), f"no {root}")


def page_lines(docs: DataFrame, keys: list[str], content: str) -> DataFrame:
    """One row per text line of PAGE documents: region and line number in document order, id, text, box and baseline
    points. Marginal lines and lines without coordinates are left out; a bad document is one row with ``error``."""
    doc = F.from_xml(F.col(content), PAGE_SCHEMA, {"mode": "PERMISSIVE"})
    rows = docs.select(*keys, doc.alias("d")).select(*keys, _error(F.col("d"), "Page").alias("error"), F.posexplode_outer("d.Page.TextRegion").alias("region_no", "r"))
    rows = rows.select(*keys, "error", "region_no", F.posexplode_outer("r.TextLine").alias("line_no", "l"))
    box = parse_points(F.col("l.Coords._points"))
    edge = lambda f, k: f(F.transform("box", lambda p: p[k])).cast("int")
    rows = rows.select(
        *keys, "error", "region_no", "line_no", F.col("l._id").alias("line_id"), F.col("l._custom").alias("custom"), F.col("l.TextEquiv.Unicode").alias("text"),
        box.alias("box"), parse_points(F.col("l.Baseline._points")).alias("baseline"),
    )
    margin = F.coalesce(F.col("custom").contains("type:margin"), F.lit(False))
    kept = rows.where(F.col("error").isNotNull() | (F.col("line_no").isNotNull() & ~margin & (F.size("box") > 0)))
    bounds = F.struct(edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x").alias("x1"), edge(F.array_max, "y").alias("y1"))
    return kept.select(*keys, "error", "region_no", "line_no", "line_id", "text", bounds.alias("bbox"), "baseline")


def page_gate(docs: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``n_regions, n_lines, error`` per document: malformed, no page, or no lines."""
    doc = F.from_xml(F.col(content), PAGE_SCHEMA, {"mode": "PERMISSIVE"})
    rows = docs.select(*keys, doc.alias("d"))
    regions = F.coalesce("d.Page.TextRegion", F.array())
    lines = F.aggregate(F.col("d.Page.TextRegion"), F.lit(0), lambda n, r: n + F.coalesce(F.size(r["TextLine"]), F.lit(0)))
    n = F.coalesce(lines, F.lit(0)).cast("long")
    return rows.select(*keys, F.size(regions).cast("long").alias("n_regions"), n.alias("n_lines"), F.coalesce(_error(F.col("d"), "Page"), F.when(n == 0, "no lines")).alias("error"))


def page_sizes(docs: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``width, height, n_baselines, error`` of every PAGE document; baselines without a valid point do not count."""
    doc = F.from_xml(F.col(content), PAGE_SCHEMA, {"mode": "PERMISSIVE"})
    rows = docs.select(*keys, doc.alias("d"))
    drawn = lambda r: F.size(F.filter(r["TextLine"], lambda t: F.size(parse_points(t["Baseline"]["_points"])) > 0))
    n = F.aggregate(F.coalesce("d.Page.TextRegion", F.array()), F.lit(0), lambda a, r: a + F.coalesce(drawn(r), F.lit(0)))
    return rows.select(*keys, F.col("d.Page._imageWidth").alias("width"), F.col("d.Page._imageHeight").alias("height"), n.cast("long").alias("n_baselines"), _error(F.col("d"), "Page").alias("error"))


def alto_lines(docs: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Text and box of every ALTO line; lines without text or with geometry that is not numeric are left out."""
    doc = F.from_xml(F.col(content), ALTO_SCHEMA, {"mode": "PERMISSIVE"})
    blocks = docs.select(*keys, doc.alias("d")).select(*keys, F.posexplode("d.Layout.Page.PrintSpace.TextBlock").alias("block_no", "b"))
    rows = blocks.select(*keys, "block_no", F.posexplode("b.TextLine").alias("line_no", "l"))
    text = F.array_join(F.transform("l.String", lambda s: s["_CONTENT"]), " ")
    at = {k: F.col(f"l.{k}").try_cast("double") for k in ("_HPOS", "_VPOS", "_WIDTH", "_HEIGHT")}
    x1, y1 = at["_HPOS"] + at["_WIDTH"], at["_VPOS"] + at["_HEIGHT"]
    box = F.struct(at["_HPOS"].cast("int").alias("x0"), at["_VPOS"].cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"))
    rows = rows.select(*keys, "block_no", "line_no", text.alias("text"), F.when((x1 + y1).isNotNull(), box).alias("bbox"))
    return rows.where((F.trim("text") != "") & F.col("bbox").isNotNull())


def build_page(lines: DataFrame, keys: list[str], order: str, text: str, *, width: int = 1000, pitch: int = 40) -> DataFrame:
    """``keys, content``: a PAGE document of the lines in order, each a strip whose baseline is at 80 percent of its height."""
    top = F.col(order).cast("long") * pitch
    corner = lambda x, y: F.concat(F.lit(f"{x},"), y.cast("string"))
    coords = F.concat_ws(" ", corner(0, top), corner(width, top), corner(width, top + pitch), corner(0, top + pitch))
    base = F.concat_ws(" ", corner(0, top + pitch * 8 // 10), corner(width, top + pitch * 8 // 10))
    line = F.format_string(
        '<TextLine id="l%s"><Coords points="%s"/><Baseline points="%s"/><TextEquiv><Unicode>%s</Unicode></TextEquiv></TextLine>',
        F.col(order).cast("string"), coords, base, escape(F.col(text)),
    )
    joined = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda s: s["x"]), "")
    head = F.lit(f'<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="page.png" imageWidth="{width}" imageHeight="')
    height = (F.size("ls") * pitch).cast("string")
    return joined.select(*keys, F.concat(head, height, F.lit('"><TextRegion id="r0">'), body, F.lit("</TextRegion></Page></PcGts>")).alias("content"))


def points_text(points: Column) -> Column:
    """``"x,y x,y"`` of an array of points, whole numbers."""
    return F.array_join(F.transform(points, lambda p: F.concat(F.bround(p["x"]).cast("long").cast("string"), F.lit(","), F.bround(p["y"]).cast("long").cast("string"))), " ")


def build_page_lines(lines: DataFrame, keys: list[str], order: str, text: str, coords: str, baseline: str, *, image: str = "page.png", width: int | None = None, height: int | None = None) -> DataFrame:
    """``keys, content``: a PAGE document of recognised lines with their polygons and baselines (``"x,y x,y"`` texts; null ones are
    left out). Without a size the page reaches to its lines' largest coordinates."""
    drawn = lambda tag, c: F.when(F.col(c).isNotNull(), F.format_string(f'<{tag} points="%s"/>', escape(F.col(c)))).otherwise(F.lit(""))
    said = F.when(F.col(text).isNotNull(), F.format_string("<TextEquiv><Unicode>%s</Unicode></TextEquiv>", escape(F.col(text)))).otherwise(F.lit(""))
    line = F.concat(F.format_string('<TextLine id="l%s">', F.col(order).cast("string")), drawn("Coords", coords), drawn("Baseline", baseline), said, F.lit("</TextLine>"))
    far = lambda k: F.max(F.array_max(F.transform(parse_points(F.col(coords)), lambda p: p[k]))).cast("int")
    joined = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("ls"), far("x").alias("w"), far("y").alias("h"))
    size = lambda c, given: F.coalesce(F.lit(given) if given is not None else F.col(c), F.lit(0)).cast("string")
    head = F.format_string('<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="%s" imageWidth="%s" imageHeight="%s"><TextRegion id="r0">', F.lit(image), size("w", width), size("h", height))
    return joined.select(*keys, F.concat(head, F.array_join(F.transform("ls", lambda x: x["x"]), ""), F.lit("</TextRegion></Page></PcGts>")).alias("content"))


def alto_to_page(docs: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``keys, content``: ALTO documents as PAGE documents: boxes as polygons, the middle of the box as baseline."""
    lines = alto_lines(docs, keys, content)
    b, at = F.col("bbox"), lambda x, y: F.concat(x.cast("string"), F.lit(","), y.cast("string"))
    middle = F.floor((b["y0"] + b["y1"]) / 2)
    box = F.concat_ws(" ", at(b["x0"], b["y0"]), at(b["x1"], b["y0"]), at(b["x1"], b["y1"]), at(b["x0"], b["y1"]))
    rows = lines.select(*keys, (F.col("block_no") * 100_000 + F.col("line_no")).alias("o"), "text", box.alias("coords"), F.concat_ws(" ", at(b["x0"], middle), at(b["x1"], middle)).alias("base"))
    return build_page_lines(rows, keys, "o", "text", "coords", "base")


def strip_page(width: Column, height: Column, text: Column, image: Column) -> Column:
    """A PAGE document of one line image: the whole strip, its baseline at 80 percent of its height and within it."""
    base = F.greatest(F.lit(0), F.least(height - 1, F.bround(height * 0.8).cast("int")))
    w, h, y = width.cast("string"), height.cast("string"), base.cast("string")
    return F.format_string(
        '<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="%s" imageWidth="%s" imageHeight="%s"><TextRegion id="r0"><TextLine id="l0"><Coords points="0,0 %s,0 %s,%s 0,%s"/><Baseline points="0,%s %s,%s"/><TextEquiv><Unicode>%s</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>',
        escape(image), w, h, w, w, h, h, y, w, y, escape(text),
    )


def xsd_gate(docs: DataFrame, keys: list[str], content: str, xsd_path: str) -> DataFrame:
    """``keys, valid`` of documents against a schema file that every executor can read (``SparkContext.addFile``)."""
    doc = F.from_xml(F.col(content), "_corrupt_record string, _x string", {"mode": "PERMISSIVE", "rowValidationXSDPath": xsd_path})
    return docs.select(*keys, doc["_corrupt_record"].isNull().alias("valid"))


def build_alto(lines: DataFrame, keys: list[str], order: str, text: str, *, width: int = 1000, pitch: int = 40) -> DataFrame:
    """``keys, content``: an ALTO document with one string per word."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    strings = F.array_join(F.transform(words, lambda w: F.concat(F.lit('<String CONTENT="'), escape(w), F.lit('"/>'))), "")
    line = F.concat(F.lit('<TextLine HPOS="0" VPOS="'), (F.col(order) * pitch).cast("string"), F.lit(f'" WIDTH="{width}" HEIGHT="{pitch}">'), strings, F.lit("</TextLine>"))
    joined = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda s: s["x"]), "")
    return joined.select(*keys, F.concat(F.lit("<alto><Layout><Page><PrintSpace><TextBlock>"), body, F.lit("</TextBlock></PrintSpace></Page></Layout></alto>")).alias("content"))


def render_tei(segments: DataFrame, keys: list[str], order: str, position: str, text: str) -> DataFrame:
    """``keys, tei``: segments in order as paragraphs by position, margins as additions, line breaks as milestones."""
    numbered = F.array_join(
        F.transform(F.split(F.col(text), "\n"), lambda x, i: F.concat(F.lit('<lb n="'), (i + 1).cast("string"), F.lit('"/>'), escape(x))), ""
    )
    add = F.col(position).startswith("margin")
    body = F.when(add, F.concat(F.lit('<add place="'), escape(F.col(position)), F.lit('">'), numbered, F.lit("</add>"))).otherwise(
        F.concat(F.lit('<p rend="'), escape(F.col(position)), F.lit('">'), numbered, F.lit("</p>"))
    )
    joined = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("x")))).alias("s"))
    whole = F.array_join(F.transform("s", lambda s: s["x"]), "")
    return joined.select(*keys, F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>'), whole, F.lit("</body></text></TEI>")).alias("tei"))


def render_tei_tables(segments: DataFrame, keys: list[str], order: str, position: str, text: str, line_range: str | None = None) -> DataFrame:
    """``keys, tei``: like :func:`render_tei`, with runs of table rows as tables (header rows marked) and line breaks numbered from
    the first line of a segment's range; blank lines keep the count."""
    first = F.coalesce(F.regexp_extract(F.col(line_range), r"\d+", 0).try_cast("int"), F.lit(1)) if line_range else F.lit(1)
    numbered = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.when(F.trim(x) != "", F.concat(F.lit('<lb n="'), (i + first).cast("string"), F.lit('"/>'), escape(x))).otherwise(F.lit("")))
    body = F.array_join(numbered, "")
    cells = F.array_join(F.transform(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\|"), lambda c: F.concat(F.lit("<cell>"), escape(F.trim(c)), F.lit("</cell>"))), "")
    inside = F.col(position).isin("table_row", "table_header")
    row = F.concat(F.when(F.col(position) == "table_header", '<row role="label">').otherwise("<row>"), cells, F.lit("</row>"))
    plain = F.when(F.col(position).startswith("margin"), F.concat(F.lit('<add place="'), escape(F.col(position)), F.lit('">'), body, F.lit("</add>"))).otherwise(
        F.concat(F.lit('<p rend="'), escape(F.coalesce(F.col(position), F.lit(""))), F.lit('">'), body, F.lit("</p>"))
    )
    part = F.struct(F.col(order).alias("o"), F.coalesce(inside, F.lit(False)).alias("t"), F.when(inside, row).otherwise(plain).alias("x"))
    joined = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("s"))
    table = lambda i: F.coalesce(F.get("s", i)["t"], F.lit(False))
    edge = lambda s, i, side, tag: F.when(s["t"] & ~table(i + side), tag).otherwise("")
    whole = F.array_join(F.transform("s", lambda s, i: F.concat(edge(s, i, -1, "<table>"), s["x"], edge(s, i, 1, "</table>"))), "")
    return joined.select(*keys, F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>'), whole, F.lit("</body></text></TEI>")).alias("tei"))


def _tei_text(raw: str | None, include_header: bool) -> str | None:
    try:
        root = ET.fromstring(raw or "")
    except ET.ParseError:
        return None
    local = lambda e: e.tag.rpartition("}")[2]
    if not include_header:
        root = next((e for e in root.iter() if local(e) == "body"), root)
    return "\n".join(t.strip() for t in root.itertext() if t.strip())


def tei_text(content: Column, include_header: bool = False) -> Column:
    """Text of a TEI document in document order (mixed content needs a real parser); null if it is malformed."""
    return F.pandas_udf(lambda s: pd.Series([_tei_text(x, include_header) for x in s], dtype="object"), "string")(content)


def table_csv(rows: DataFrame, keys: list[str], order: str, cells: str) -> DataFrame:
    """``keys, n_columns, csv``: array rows in order, padded to the widest, quoted where needed."""
    joined = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cells).alias("c")))).alias("r"))
    width = F.array_max(F.transform("r", lambda x: F.size(x["c"])))
    joined = joined.select(*keys, "r", width.alias("most"))
    quote = lambda v: F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    pad = lambda c: F.concat(c, F.array_repeat(F.lit(""), F.col("most") - F.size(c)))
    lines = F.transform("r", lambda x: F.array_join(F.transform(pad(x["c"]), quote), ","))
    return joined.select(*keys, F.col("most").cast("long").alias("n_columns"), F.array_join(lines, "\n").alias("csv"))


#: Folder names under which nothing may be written.
PROTECTED = {"train", "training", "ground_truth"}


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; refuses a path with a protected folder."""
    if PROTECTED & set(path.rstrip("/").split("/")):
        raise ValueError(f"{path} lies in a protected folder")
    df.write.mode(mode).json(path)
