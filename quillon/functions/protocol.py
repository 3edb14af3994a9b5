"""Vocabulary of transcription protocols: positions, confidence, eras; table rows and line ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions of the protocol, and other names for them (fixed values).
POSITIONS = ["body", "header", "footer", "margin_left", "margin_right", "margin_top", "margin_bottom", "interlinear", "footnote", "table_row", "table_header"]
POSITION_ALIASES = {
    "main": "body", "main_body": "body", "center": "body", "full_page": "body", "full_text": "body", "text": "body",
    "left_margin": "margin_left", "right_margin": "margin_right", "top_margin": "margin_top", "bottom_margin": "margin_bottom",
    "top": "margin_top", "bottom": "margin_bottom", "left": "margin_left", "right": "margin_right",
    "top_center": "header", "top_centered": "header",
    "marginalia_left": "margin_left", "marginalia_right": "margin_right", "marginalia_top": "margin_top", "marginalia_bottom": "margin_bottom",
    "marginalia": "margin_left", "margin": "margin_left",
    "marginalia_bottom_right": "margin_bottom", "marginalia_bottom_left": "margin_bottom", "marginalia_top_right": "margin_top", "marginalia_top_left": "margin_top",
    "margin_bottom_right": "margin_bottom", "margin_bottom_left": "margin_bottom", "margin_top_right": "margin_top", "margin_top_left": "margin_top",
    "top_right_corner": "margin_top", "top_left_corner": "margin_top", "bottom_right_corner": "margin_bottom", "bottom_left_corner": "margin_bottom",
    "top_right": "margin_top", "top_left": "margin_top", "bottom_right": "margin_bottom", "bottom_left": "margin_bottom",
    "title": "header", "subtitle": "header", "attestation_block": "footer", "attestation": "footer",
    "heading": "header", "address": "header", "date_line": "header", "salutation": "body", "greeting": "body", "closing": "body", "valediction": "body", "signature": "body",
    "headline": "header", "subheadline": "header", "sub_headline": "header", "byline": "body", "by_line": "body", "dateline": "header",
    "caption": "footnote", "photo_caption": "footnote", "image_caption": "footnote", "pull_quote": "body", "pullquote": "body", "drop_cap": "body",
    "column_header": "header", "section_header": "header", "page_number": "footer", "folio": "footer", "running_head": "header", "running_header": "header",
    "colophon": "footer", "advertisement": "body", "classified": "body", "masthead": "header", "kicker": "header", "deck": "header", "attribution": "body",
    "credit": "body", "source": "body", "subheading": "header", "sub_heading": "header", "standfirst": "header", "lede": "body", "lead": "body",
    "paragraph": "body", "article": "body", "editorial": "body", "column": "body",
    "table": "table_row", "insertion": "interlinear", "caret_insertion": "interlinear",
}
#: Words of a margin, and where each direction leads (fixed values; the first that is there counts).
MARGIN_WORDS, MARGIN_DIRECTIONS = ["margin", "corner", "marginalia"], ["left", "right", "top", "bottom"]


def position(raw: Column) -> Column:
    """A known position: of the normalised name, by alias, without a plural s, by the words of a margin (of the singular too); else as it was."""
    key = F.regexp_replace(F.replace(F.regexp_replace(F.lower(F.trim(raw)), r"\s+", "_"), F.lit("-"), F.lit("_")), "_{2,}", "_")
    alias = F.create_map(*[F.lit(x) for pair in POSITION_ALIASES.items() for x in pair])
    named = lambda c: F.coalesce(F.element_at(alias, c), F.when(c.isin(POSITIONS), c))
    single = F.when(key.endswith("s"), F.left(key, F.length(key) - 1))
    parts = F.split(F.coalesce(single, key), "_")  # a plural goes on as its singular
    where = F.lit(None).cast("string")
    for direction in reversed(MARGIN_DIRECTIONS):
        where = F.when(F.array_contains(parts, direction), f"margin_{direction}").otherwise(where)
    margin = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, MARGIN_WORDS))), where)
    return F.coalesce(named(key), named(single), margin, raw)


def confidence_tier(value: Column) -> Column:
    return F.when(value >= 0.90, "high").when(value >= 0.70, "medium").otherwise("low")


def pipe_cells(line: Column) -> Column:
    """Trimmed cells of a ``a | b | c`` row."""
    return F.transform(F.split(line, r"\|"), lambda c: F.trim(c))


def line_range(raw: Column) -> Column:
    """``5-11``, ``5`` or ``[5, 11]`` as a struct of lo and hi."""
    numbers = F.transform(F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    return F.struct(F.get(numbers, 0).alias("lo"), F.coalesce(F.get(numbers, 1), F.get(numbers, 0)).alias("hi"))


def strip_fence(raw: Column) -> Column:
    """The inside of a fenced block, else the text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), "^```[a-z]*\\s*\n", ""), "\n```$", ""))


def closed_label(raw: Column, labels: list[str]) -> Column:
    """The label of a JSON answer if it is valid, else the longest valid label that the text contains, else null."""
    inner = strip_fence(raw)
    field = F.get_json_object(inner, "$.label")
    out = F.lit(None).cast("string")
    for label in sorted(labels, key=lambda x: (len(x), x)):
        out = F.when(F.lower(inner).contains(label), label).otherwise(out)
    return F.when(field.isin(labels), field).otherwise(out)
