"""Canonical forms, marks, segments and small parsers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import forms
from quillon.operators import evaluate as E
from quillon.plans.registry import query, table

_FOLD = "strip_accents(lower(coalesce(text, '')))"
_PUNCT = forms.PUNCTUATION.replace("'", "''")
_SIGNS = forms.PUNCTUATION_AND_SIGNS.replace("'", "''")


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _each(x: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


_UV = f"translate({_FOLD}, 'vj', 'ui')"
_SCORING = _squeeze(f"regexp_replace({_UV}, '{_PUNCT}', ' ', 'g')")
_FINGERPRINT = _squeeze(f"regexp_replace({_UV}, '{_SIGNS}', ' ', 'g')")
_ABBREVIATED = (("q3", "que"), ("qz", "que"), ("qʒ", "que"), ("⁊", " et "), ("&", " et "))
_GENRE = _squeeze(f"regexp_replace({_each(_UV, *_ABBREVIATED)}, '[<>]', ' ', 'g')")
_AE = _each(_FOLD, ("æ", "e"), ("œ", "e"), ("ae", "e"), ("oe", "e"))
_STYLO = _squeeze(rf"regexp_replace({_each(f'translate({_AE}, {chr(39)}vj{chr(39)}, {chr(39)}ui{chr(39)})', ('q3', 'que'), ('qz', 'que'), ('&', ' et '), ('⁊', ' et '))}, '[^a-z\s]', ' ', 'g')")
_QUALITY = _squeeze(rf"regexp_replace(regexp_replace({_each(_UV, ('q3', 'que'), ('&', ' et '), ('⁊', ' et '))}, '\[[^\]]*\]', ' ', 'g'), '[^a-z\s]', ' ', 'g')")
_TITLE = _each(_FOLD, ("æ", "ae"), ("œ", "oe"), ("ae", "e"), ("oe", "e"))


@query(f"""SELECT doc_id, md5({_SCORING}) AS scoring, md5({_FINGERPRINT}) AS fingerprint, md5({_GENRE}) AS genre, md5({_STYLO}) AS stylo, md5({_QUALITY}) AS quality,
  md5({_squeeze(_FOLD)}) AS line, md5({_TITLE}) AS title FROM documents""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a text's canonical forms."""
    rows = table(spark, sf_dir, "documents").select("doc_id", forms.digests(F.coalesce("text", F.lit(""))).alias("m"))
    return rows.select("doc_id", "m.*")


@query(rf"""SELECT doc_id, CAST(len(list_filter(string_split({_FINGERPRINT}, ' '), lambda w: regexp_matches(w, '^\p{{L}}{{2,}}$'))) AS BIGINT) AS n_words,
  CAST(len(regexp_extract_all({_GENRE}, '[a-z]+')) AS BIGINT) AS n_delta, md5(array_to_string(regexp_extract_all({_GENRE}, '[a-z]+'), ' ')) AS delta FROM documents""")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, delta = forms.fingerprint_tokens(F.col("text")), forms.delta_tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), delta.alias("d"))
    return rows.select("doc_id", "n_words", F.size("d").cast("long").alias("n_delta"), F.md5(F.array_join("d", " ")).alias("delta"))


_MARKED = "'[exp:dominus] ' || replace(replace(replace(text, ', ', ' [uncertain: ut / vt] '), '. ', ' [gap 3] [unc: x] '), ' the ', ' <hi>the</hi> [Illegible] ')"


def _marked(text: Column) -> Column:
    for old, new in ((", ", " [uncertain: ut / vt] "), (". ", " [gap 3] [unc: x] "), (" the ", " <hi>the</hi> [Illegible] ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.concat(F.lit("[exp:dominus] "), text)


_KINDS = "illegible|uncertain|gap|damaged|glyph-uncertain|deletion|insertion|marginalia|superscript|exp|wrap-join"


def _strip_marks_sql(keep: bool) -> str:
    out = rf"regexp_replace(m, '\[exp:([^\]]*)\]', '{chr(92) + '1' if keep else ''}', 'g')"
    for mark in (r"\[unc:[^\]]*\]", r"\[gap[^\]]*\]", r"\[fig:[^\]]*\]", r"\[[^\]]{0,40}\]", r"<[^>]{0,80}>"):
        out = f"regexp_replace({out}, '{mark}', '', 'g')"
    return _squeeze(out)


@query(rf"""WITH t AS (SELECT doc_id, {_MARKED} AS m FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(regexp_replace(regexp_replace(m, '\[uncertain:\s*([^/\]]*?)\s*(?:/[^\]]*)?\]', '\1', 'g'), '\[(?:{_KINDS})[^\]]*\]', '', 'g')) AS tokens,
  md5({_strip_marks_sql(True)}) AS kept, md5({_strip_marks_sql(False)}) AS dropped,
  md5(regexp_replace(regexp_replace(regexp_replace(m, '(?i)\[(?:illegible|unclear|gap|omitted)[^\]]*\]', ' ', 'g'), '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS stream FROM t""")
def marks_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts with protocol marks in them, after the marks are taken out in four ways."""
    m = F.col("m")
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", _marked(F.col("text")).alias("m"))
    made = {"tokens": forms.strip_tokens(m), "kept": forms.strip_marks(m), "dropped": forms.strip_marks(m, False), "stream": forms.stream_text(m)}
    return rows.select("doc_id", *[F.md5(c).alias(k) for k, c in made.items()])


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH f AS (SELECT doc_id, {_STRIP.format("coalesce(text, '')")} AS full_text FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(full_text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: {_STRIP.format("p")}), lambda p: len(regexp_split_to_array(p, '\s+')) >= 4) AS sentences,
  list_filter(list_transform(regexp_split_to_array(full_text, '\n\s*\n'), lambda p: {_STRIP.format("p")}), lambda p: p <> '') AS parts,
  list_filter(list_transform(string_split(full_text, chr(10)), lambda p: {_STRIP.format("p")}), lambda p: p <> '') AS lines FROM f),
p AS (SELECT doc_id, sentences, CASE WHEN len(parts) > 1 THEN parts ELSE list_transform(range(0, CAST(ceil(len(lines) / 12) AS BIGINT)), lambda i: array_to_string(lines[i * 12 + 1:i * 12 + 12], chr(10))) END AS paragraphs FROM s)
SELECT doc_id, CAST(len(sentences) AS BIGINT) AS n_sentences, md5(array_to_string(sentences, chr(1))) AS sentences, CAST(len(paragraphs) AS BIGINT) AS n_paragraphs, md5(array_to_string(paragraphs, chr(1))) AS paragraphs FROM p""")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", forms.segments(F.col("text"), "sentence").alias("s"), forms.segments(F.col("text")).alias("p")
    )
    n = lambda c: F.size(c).cast("long")
    return rows.select(
        "doc_id", n("s").alias("n_sentences"), F.md5(F.array_join("s", "\x01")).alias("sentences"), n("p").alias("n_paragraphs"), F.md5(F.array_join("p", "\x01")).alias("paragraphs")
    )


@query(r"""WITH t AS (SELECT part.p_partkey, p_brand || '_' || p_type AS stem FROM part),
h AS (SELECT p_partkey, stem, string_split(string_split(replace(stem, '_', '-'), '-')[1], '.')[1] AS head FROM t)
SELECT p_partkey, coalesce(nullif(regexp_extract(head, '^([A-Za-z]+\d*)', 1), ''), nullif(head, ''), stem) AS source_key FROM h""")
def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive prefixes of made-up file stems."""
    stem = F.concat_ws("_", "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", forms.source_key(stem).alias("source_key"))


@query(r"""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderkey % 100 AS VARCHAR) AS v FROM orders)
SELECT o_orderkey, CAST(CASE k WHEN 2 THEN 0.9312 WHEN 3 THEN NULL ELSE CASE WHEN CAST(v AS DOUBLE) <= 1 THEN CAST(v AS DOUBLE) ELSE CAST(v AS DOUBLE) / 100 END END AS DOUBLE) AS char_accuracy,
  CASE WHEN k = 0 THEN 0.75::DOUBLE END AS word_accuracy, CASE k WHEN 1 THEN CAST(v AS BIGINT) WHEN 3 THEN greatest(CAST(v AS BIGINT), 7) ELSE 0 END AS n_lines FROM o""")
def metrics_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies and line counts out of four kinds of tool output."""
    k, v = F.col("o_orderkey") % 4, (F.col("o_orderkey") % 100).cast("string")
    output = (
        F.when(k == 0, F.concat(F.lit("Character Accuracy: 0.5\nCharacter accuracy | "), v, F.lit(" %\nword accuracy: 75.0")))
        .when(k == 1, F.concat(F.lit("tested\n"), v, F.lit(" lines\nCharacter Accuracy "), v))
        .when(k == 2, F.lit("report\n 0.9312 \ndone"))
        .otherwise(F.concat(v, F.lit(" Samples read\n7 lines")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", forms.parse_metrics(output).alias("m"))
    return rows.select("o_orderkey", "m.char_accuracy", "m.word_accuracy", "m.n_lines")


@query(r"""WITH q AS (SELECT item_id, regexp_replace(regexp_replace(translate(strip_accents(lower(text)), 'vj', 'ui'), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g') AS a FROM (SELECT item_id, replace(replace(replace(text, 'q3', 'que'), '&', ' et '), '⁊', ' et ') AS text FROM benchmark)),
h AS (SELECT item_id, trim(a) AS a, trim(regexp_replace(replace(a, 'en ', 'e n '), '\s+', ' ', 'g')) AS b FROM q)
SELECT item_id, CAST(length(replace(a, ' ', '')) AS BIGINT) AS ref_chars, CAST(length(replace(b, ' ', '')) AS BIGINT) AS hyp_chars, CAST(levenshtein(replace(a, ' ', ''), replace(b, ' ', '')) AS BIGINT) AS char_edits,
  round(levenshtein(replace(a, ' ', ''), replace(b, ' ', '')) / greatest(1, length(replace(a, ' ', ''))), 6) AS cer FROM h""")
def quality_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate without blanks: moving a word's edge costs nothing."""
    form = forms.quality_form(F.col("text"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", form.alias("ref"))
    hyp = F.replace(F.concat("ref", F.lit(" ")), F.lit("en "), F.lit("e n "))
    return E.quality_errors(rows.withColumn("hyp", hyp), ["item_id"], "ref", "hyp")


@query(r"""WITH g AS (SELECT vec_id, CAST(floor(embedding[1] * 100) AS BIGINT) AS x, CAST(floor(embedding[2] * 100) AS BIGINT) AS y FROM embeddings)
SELECT vec_id, round_even(x * 1.5, 0)::BIGINT || ',' || round_even(y * 0.5, 0)::BIGINT || ' bad ' || round_even((x + 7) * 1.5, 0)::BIGINT || ',' || round_even((y - 3) * 0.5, 0)::BIGINT AS scaled FROM g""")
def scaled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.floor(F.col("embedding")[i].cast("double") * 100)
    text = F.format_string("%d,%d bad %d,%d", at(0), at(1), at(0) + 7, at(1) - 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", forms.scale_points(text, F.lit(1.5), F.lit(0.5)).alias("scaled"))


@query(r"""WITH p AS (SELECT vec_id, list_transform(range(0, 8), lambda i: CAST(floor(embedding[i + 1] * 100) AS DOUBLE)) AS y FROM embeddings),
w AS (SELECT vec_id, y, list_concat([y[1], y[1]], y, [y[8], y[8]]) AS z FROM p)
SELECT vec_id, array_to_string(list_transform(range(0, 8), lambda i: CAST(CAST(round_even(list_sum(z[i + 1:i + 5]) / 5, 0) AS BIGINT) AS VARCHAR)), ' ') AS smooth FROM w""")
def smooth_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moving average of five over made-up baselines of eight points."""
    y = lambda i: F.floor(F.col("embedding")[i].cast("double") * 100)
    points = F.array(*[F.struct(F.lit(i * 10).alias("x"), y(i).alias("y")) for i in range(8)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", forms.smooth(points, 5).alias("p"))
    return rows.select("vec_id", F.array_join(F.transform("p", lambda p: p["y"].cast("string")), " ").alias("smooth"))


_SCRIPTS = {"english": ["the", "that", "with"], "french": ["des", "les", "que"]}


@query(r"""SELECT doc_id, CASE WHEN e AND f THEN 'english,french' WHEN e THEN 'english' WHEN f THEN 'french' ELSE 'unknown' END AS scripts FROM (
SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '(?:^|[^\p{L}\p{N}_])(?:the|that|with)(?:$|[^\p{L}\p{N}_])') AS e, regexp_matches(lower(coalesce(text, '')), '(?:^|[^\p{L}\p{N}_])(?:des|les|que)(?:$|[^\p{L}\p{N}_])') AS f FROM documents)""")
def script_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = forms.scripts_of(F.array(F.coalesce("text", F.lit(""))), _SCRIPTS, "unknown")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, ",").alias("scripts"))
