"""The library from SQL: temporary functions that Catalyst inlines, and a table function that shreds layout documents.

``register(spark)`` makes them known to a session; after that a query is SQL text. Scalar functions are SQL themselves, so they are
planned with the query; only the shredder is Python, in Arrow batches. (Spark takes such functions neither inside a lambda nor as the argument
of a generator: name their result in a subquery first.)
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillon.functions.text import _fold_table

#: Name, parameters, type and body of the scalar functions; ``{source}`` and ``{target}`` are the letters that folding replaces.
FUNCTIONS = [
    ("fold_text", "t STRING", "STRING", r"regexp_replace(translate(lower(t), '{source}', '{target}'), '\\p{{M}}+', '')"),
    ("squeeze_text", "t STRING", "STRING", r"trim(regexp_replace(t, '\\s+', ' '))"),
    ("canonical_text", "t STRING", "STRING", "squeeze_text(regexp_replace(translate(fold_text(t), 'vj', 'ui'), '[^a-z0-9]+', ' '))"),
    ("word_list", "t STRING", "ARRAY<STRING>", "regexp_extract_all(fold_text(coalesce(t, '')), '[a-z]{{2,}}', 0)"),
    ("escape_xml", "t STRING", "STRING", "replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"),
    ("line_error", "a STRING, b STRING", "DOUBLE", "CASE WHEN greatest(length(a), length(b)) = 0 THEN 0D ELSE levenshtein(a, b) / greatest(length(a), length(b)) END"),
    ("disposition", "cer DOUBLE, wer DOUBLE", "STRING", "CASE WHEN cer < 1 AND wer < 2 THEN 'PASS' WHEN cer < 3 AND wer < 5 THEN 'COND_PASS' ELSE 'FAIL' END"),
    ("confidence_tier", "v DOUBLE", "STRING", "CASE WHEN v >= 0.90D THEN 'high' WHEN v >= 0.70D THEN 'medium' ELSE 'low' END"),
    ("safe_id", "t STRING", "STRING", "coalesce(nullif(left(regexp_replace(regexp_replace(t, '[^A-Za-z0-9._-]+', '_'), '^[._-]+|[._-]+$', ''), 120), ''), 'job')"),
    ("slice_size", "n INT", "INT", "CASE WHEN n < 120 THEN NULL WHEN n < 500 THEN greatest(80, int(n / 3)) WHEN n < 1500 THEN 250 ELSE 400 END"),
    ("slice_step", "n INT", "INT", "CASE WHEN n < 120 THEN NULL WHEN n < 500 THEN greatest(40, int(n / 6)) WHEN n < 1500 THEN 150 ELSE 250 END"),
    (
        "word_slices", "w ARRAY<STRING>", "ARRAY<STRUCT<slice_no: INT, words: ARRAY<STRING>>>",
        # bound twice, as the planner puts the whole of w, and of its size, in every place where they are named
        "transform(transform(transform(array(w), w -> named_struct('w', w, 'm', size(w))), "
        "x -> named_struct('w', x.w, 'n', CASE WHEN x.m < 120 THEN NULL WHEN x.m < 500 THEN greatest(80, int(x.m / 3)) WHEN x.m < 1500 THEN 250 ELSE 400 END, "
        "'step', CASE WHEN x.m < 120 THEN NULL WHEN x.m < 500 THEN greatest(40, int(x.m / 6)) WHEN x.m < 1500 THEN 150 ELSE 250 END)), v -> CASE WHEN v.n IS NULL THEN array() "
        "ELSE transform(filter(sequence(0, size(v.w) - 1, v.step), (s, i) -> i = 0 OR least(v.n, size(v.w) - s) >= greatest(80, v.n / 2)), "
        "(s, i) -> named_struct('slice_no', i, 'words', slice(v.w, s + 1, v.n))) END)[0]",
    ),
]


class PageRows:
    """Lines of a PAGE document: ``line_no, line_id, text, n_points, error``; a document that is none is one row with its error."""

    def eval(self, content: str) -> Iterator[tuple]:
        if content is None:
            return
        try:
            root = ElementTree.fromstring(content)
        except ElementTree.ParseError:
            yield None, None, None, None, "malformed"
            return
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        if not any(local(e) == "Page" for e in root):
            yield None, None, None, None, "no Page"
            return
        for number, line in enumerate(e for e in root.iter() if local(e) == "TextLine"):
            parts = {local(e): e for e in line}
            text = next((e.text for e in parts["TextEquiv"] if local(e) == "Unicode"), None) if "TextEquiv" in parts else None
            points = parts["Coords"].get("points", "").split() if "Coords" in parts else []
            yield number, line.get("id"), text, len(points), None


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to the session; the session itself is given back."""
    source, target = _fold_table()
    for name, parameters, kind, body in FUNCTIONS:
        body = body.format(source=source, target=target)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    shredder = udtf(PageRows, returnType="line_no int, line_id string, text string, n_points int, error string", useArrow=True)
    spark.udtf.register("page_rows", shredder)
    return spark
