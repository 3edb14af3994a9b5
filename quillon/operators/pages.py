"""Page-level work: ground truth of PAGE documents, best boxes, figures and their marks, margins, tables, rescaled coordinates.

A page's lines are few; where they must be seen together they are one array, so a line finds its partner without a
row for every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.forms import scale_points
from quillon.functions.protocol import pipe_cells
from quillon.functions.text import squeeze
from quillon.operators.evaluate import iou
from quillon.operators.ordered import runs
from quillon.operators.stylometry import let

TABLE_POSITIONS = ["table_row", "table_header"]


def joined_text(lines: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """``keys, text``: the lines of a page in document order, joined by blanks and squeezed; lines without text say nothing."""
    kept = F.collect_list(F.when(F.length(F.trim(text)) > 0, F.struct(*order, F.col(text).alias("t"))))
    rows = lines.groupBy(*keys).agg(F.array_sort(kept).alias("l"))
    return rows.select(*keys, squeeze(F.array_join(F.transform("l", lambda x: x["t"]), " ")).alias("text"))


def padded_box(box: Column, width: Column, height: Column, pad: int = 6) -> Column:
    """A box with a margin, kept within the page."""
    grown = lambda k, d, most: F.greatest(F.lit(0), F.least(box[k] + d, most)).alias(k)
    return F.struct(grown("x0", -pad, width), grown("y0", -pad, height), grown("x1", pad, width), grown("y1", pad, height))


def check_pages(pages: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """``key, ok, message`` of PAGE documents (``width, height, n_baselines, error``) against their images (``width, height``)."""
    im = images.select(key, F.col("width").alias("iw"), F.col("height").alias("ih"))
    message = (
        F.when(F.col("error") == "malformed", "XML parse error")
        .when(F.col("width").isNull() | F.col("height").isNull(), "page size missing")
        .when(F.col("iw").isNull(), "no image")
        .when((F.col("iw") != F.col("width")) | (F.col("ih") != F.col("height")), F.format_string("image size (%sx%s) is not the page's (%sx%s)", *[F.col(c).cast("string") for c in ("iw", "ih", "width", "height")]))
        .when(F.col("n_baselines") == 0, "no baselines")
    )
    good = F.format_string("%s lines, %sx%s", *[F.col(c).cast("string") for c in ("n_baselines", "width", "height")])
    rows = pages.join(im, key, "left").select(key, message.alias("fault"), good.alias("good"))
    return rows.select(key, F.col("fault").isNull().alias("ok"), F.coalesce("fault", "good").alias("message"))


def best_boxes(hypotheses: DataFrame, references: DataFrame, page: list[str], least: float = 0.3) -> DataFrame:
    """Every hypothesis line (``page, line_idx, box``) with the text of the reference line (``page, line_idx, box, text``) that it
    overlaps most, from ``least`` on (the first on ties), else of the line with its number, else null. A reference may serve
    several lines."""
    refs = references.groupBy(*page).agg(F.collect_list(F.struct(F.col("line_idx").alias("i"), "box", "text")).alias("refs"))
    rows = hypotheses.join(refs, page, "left")
    scored = F.transform("refs", lambda r: F.struct(iou(F.col("box"), r["box"]).alias("iou"), (-r["i"]).alias("i"), r["text"].alias("text")))
    near, same = F.array_max(F.filter(scored, lambda s: s["iou"] >= least)), F.get(F.filter("refs", lambda r: r["i"] == F.col("line_idx")), 0)
    how = F.when(near.isNotNull(), "iou").when(same.isNotNull(), "order")
    return rows.select(
        *page, "line_idx", how.alias("method"), F.coalesce(-near["i"], same["i"]).alias("ref_idx"), F.round(near["iou"], 6).alias("iou"), F.coalesce(near["text"], same["text"]).alias("text")
    )


def baseline_report(pages: DataFrame) -> DataFrame:
    """One row over pages (``n_ref, n_hyp, n_matched, recall, precision, chamfer``): means over pages of recall and precision,
    the mean chamfer distance over all matches, and how many pages had no line on a side and are left out."""
    usable = (F.col("n_ref") > 0) & (F.col("n_hyp") > 0)
    mean = lambda c: F.round(F.avg(F.when(usable, F.col(c))), 6)
    weighted = F.sum(F.when(usable, F.col("chamfer") * F.col("n_matched"))) / F.nullif(F.sum(F.when(usable & F.col("chamfer").isNotNull(), F.col("n_matched"))), F.lit(0))
    return pages.agg(
        F.count_if(usable).alias("n_pages"), F.count_if(~usable).alias("n_skipped"), mean("recall").alias("recall"), mean("precision").alias("precision"), F.round(weighted, 6).alias("chamfer")
    )


def figures(found: DataFrame, page: str, classes: list[str], least_confidence: float = 0.35, least_share: float = 0.01) -> DataFrame:
    """Detections (``page, order, label, confidence, box, page_area``) that are sure and large enough and of a class, numbered on
    their page (``fig_01``)."""
    box = F.col("box")
    share = F.greatest(F.lit(0.0), ((box["x1"] - box["x0"]) * (box["y1"] - box["y0"])).cast("double")) / F.col("page_area")
    kept = found.where(F.lower("label").isin(classes) & (F.col("confidence") >= least_confidence) & (share >= least_share))
    number = F.row_number().over(Window.partitionBy(page).orderBy("order"))
    return kept.select(page, "label", "confidence", "box", F.format_string("fig_%02d", number).alias("figure"))


def anchors(found: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """``anchor``: the largest number of a line (``page, line_no, centre``) whose centre is above a figure's top; 0 above all."""
    centres = lines.groupBy(page).agg(F.collect_list(F.struct("line_no", "centre")).alias("lines"))
    above = F.transform(F.filter("lines", lambda x: x["centre"] < F.col("box")["y0"]), lambda x: x["line_no"])
    return found.join(centres, page, "left").withColumn("anchor", F.coalesce(F.array_max(above), F.lit(0))).drop("lines")


def first_covering(lines: DataFrame, segments: DataFrame, page: str) -> DataFrame:
    """``page, line_no, segment``: the first segment (``page, segment, lo, hi``) whose range has the line, or null."""
    covers = segments.groupBy(page).agg(F.collect_list(F.struct("segment", "lo", "hi")).alias("segments"))
    holding = F.filter("segments", lambda s: (s["lo"] <= F.col("line_no")) & (F.col("line_no") <= s["hi"]))
    return lines.join(covers, page, "left").select(page, "line_no", F.array_min(F.transform(holding, lambda s: s["segment"])).alias("segment"))


def insert_mark(text: Column, after: Column, mark: Column) -> Column:
    """``mark`` on a line of its own after line ``after`` (from 0) of a text; before the first below 0, after the last beyond."""
    lines = F.split(text, "\n")
    at = F.greatest(F.lit(0), F.least(F.size(lines), after + 1))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), at), F.array(mark), F.slice(lines, at + 1, F.size(lines))), "\n")


def figure_section(marks: DataFrame, doc: str) -> DataFrame:
    """``doc, n_marks, figures``: what is recorded of a document's figures, in order of their names, as JSON."""
    rows = marks.groupBy(doc).agg(F.count("*").alias("n_marks"), F.array_sort(F.collect_list(F.struct("figure", "label", "anchor"))).alias("f"))
    return rows.select(doc, "n_marks", F.to_json("f").alias("figures"))


def margin_lines(lines: DataFrame, page: str, least_lines: int = 4) -> DataFrame:
    """Lines (``page, line_no, x0, x1``) with ``margin``: shorter than 0.35 of the median length and wholly left of the first
    quartile of left edges or right of the third of right edges; pages of fewer lines have none."""
    length = F.col("x1") - F.col("x0")
    stats = lines.groupBy(page).agg(
        F.count("*").alias("n"), F.median(length).alias("middle"), F.percentile("x0", F.lit(0.25)).alias("left"), F.percentile("x1", F.lit(0.75)).alias("right")
    )
    outside = (F.col("x1") < F.col("left")) | (F.col("x0") > F.col("right"))
    mark = (F.col("n") >= least_lines) & (length < 0.35 * F.col("middle")) & outside
    return lines.join(stats, page).select(page, "line_no", "x0", "x1", mark.alias("margin"))


def tables(segments: DataFrame, doc: str, order: str, position: str, text: str, notes: str, known: dict[str, list[str]]) -> DataFrame:
    """``doc, table_no, type, columns, rows``: runs of table rows and headers.

    The type is the first that a note of the run names (``tableType: x``), else unknown; columns are the last header's, else
    those known for the type; every other segment ends a run.
    """
    inside = F.coalesce(F.col(position).isin(TABLE_POSITIONS), F.lit(False))
    # runs inside and outside of tables take turns, so every second one is a table
    rows = runs(segments, [doc], [order], inside, "_run").where(inside).withColumn("_table", F.ceil(F.col("_run") / 2))
    kind = F.nullif(F.regexp_extract(notes, r"tableType:\s*([\w-]+)", 1), F.lit(""))
    part = F.struct(F.col(order).alias("o"), (F.col(position) == "table_header").alias("header"), pipe_cells(F.trim(F.coalesce(text, F.lit("")))).alias("cells"), kind.alias("type"))
    found = rows.groupBy(doc, F.col("_table").cast("long").alias("table_no")).agg(F.array_sort(F.collect_list(part)).alias("s"))
    named = F.get(F.filter("s", lambda x: x["type"].isNotNull()), 0)["type"]
    heads = F.filter("s", lambda x: x["header"])
    none = F.array().cast("array<string>")
    schema = none
    for name, columns in known.items():
        schema = F.when(F.col("type") == name, F.array(*map(F.lit, columns))).otherwise(schema)
    found = found.select(doc, "table_no", F.coalesce(named, F.lit("unknown")).alias("type"), F.when(F.size(heads) > 0, F.element_at(heads, -1)["cells"]).alias("head"), F.transform(F.filter("s", lambda x: ~x["header"]), lambda x: x["cells"]).alias("rows"))
    return found.select(doc, "table_no", "type", F.coalesce("head", schema).alias("columns"), "rows")


def tables_json(found: DataFrame, doc: str) -> DataFrame:
    """``doc, tables``: a document's tables in order as one JSON array."""
    rows = found.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("table_no", "type", "columns", "rows"))).alias("t"))
    return rows.select(doc, F.to_json(F.transform("t", lambda t: t.dropFields("table_no"))).alias("tables"))


def rescale_points(content: Column, sx: Column, sy: Column) -> Column:
    """An XML document with every ``points`` attribute scaled, as its image was."""
    parts = F.split(content, ' points="')

    def scaled(part: Column, i: Column) -> Column:
        end = F.instr(part, '"')
        moved = F.concat(F.lit(' points="'), scale_points(F.left(part, end - 1), sx, sy), F.substring(part, end, F.length(part)))
        return F.when(i == 0, part).otherwise(moved)

    return F.array_join(F.transform(parts, scaled), "")


def template(n_lines: Column, name: Column) -> Column:
    """A numbered text to be filled in, one line for every text line of a page."""
    numbers = F.when(n_lines > 0, F.sequence(F.lit(1).cast("long"), n_lines.cast("long"))).otherwise(F.array().cast("array<long>"))
    head = F.array(F.concat(F.lit("# source: "), name), F.concat(F.lit("# "), n_lines.cast("string"), F.lit(" lines; blank ones are skipped")))
    return F.concat(F.array_join(F.concat(head, F.transform(numbers, lambda i: F.concat(F.lpad(i.cast("string"), 3, "0"), F.lit(": ")))), "\n"), F.lit("\n"))


def inject_lines(content: Column, texts: Column) -> Column:
    """A PAGE document whose n-th text line has the n-th text (a map from number to text) in place of its own; lines without a
    text in the map stay."""
    parts = F.split(content, r"(?=<TextLine\b)")

    def filled(part: Column, i: Column) -> Column:
        number = i + F.when(F.get(parts, 0).startswith("<TextLine"), 1).otherwise(0)
        text = F.nullif(F.trim(F.element_at(texts, number)), F.lit(""))
        safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        bare = F.regexp_replace(part, r"(?s)<TextEquiv.*?</TextEquiv>", "")
        new = F.replace(bare, F.lit("</TextLine>"), F.concat(F.lit("<TextEquiv><Unicode>"), safe, F.lit("</Unicode></TextEquiv></TextLine>")))
        return F.when(part.startswith("<TextLine") & text.isNotNull(), new).otherwise(part)

    return F.array_join(F.transform(parts, filled), "")


def channel_lines(channels: DataFrame, page: str, least_mass: float = 15.0, least_peak: float = 0.12, most: int = 96) -> DataFrame:
    """Mask channels (``page, channel, mass, peak``) that hold a line: heavy or peaked ones, the ``most`` heaviest, in their order;
    without any, the heaviest alone."""
    good = (F.col("mass") >= least_mass) | (F.col("peak") >= least_peak)
    rows = channels.groupBy(page).agg(F.collect_list(F.struct((-F.col("mass")).alias("m"), "channel", good.alias("good"))).alias("all"))
    kept = let(F.filter("all", lambda c: c["good"]), lambda g: F.when(F.size(g) > 0, F.slice(F.array_sort(g), 1, most)).otherwise(F.slice(F.array_sort("all"), 1, 1)))
    return rows.select(page, F.posexplode(F.array_sort(F.transform(kept, lambda c: c["channel"]))).alias("place", "channel"))
