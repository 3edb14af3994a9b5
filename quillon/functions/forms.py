"""Canonical forms of a text for different comparisons, segments of a document, and small parsers.

All but :func:`unicode_form` are column expressions; forms that compose or decompose Unicode need the Unicode database and
go through Arrow.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import fold, squeeze

#: Scribal and modern punctuation that scoring takes for a blank (fixed values).
PUNCTUATION = r"""['.,;:!?"`’‘“”…—\-()\[\]]+"""
PUNCTUATION_AND_SIGNS = r"""['.,;:!?"`’‘“”…—\-()\[\]⁊ꝙ]+"""
#: Combining marks that a plain extract drops (fixed values: strokes, cedillas and dots below, tilde, macron and others above).
DROPPED_MARKS = "[̴-̸̧̨̡-̥̩-̳̃̄̈̊]+"


#: Texts of a batch that are Python strings at a time.
SLICE = 64


def _all(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _uv_ij(text: Column) -> Column:
    return _all(text, ("v", "u"), ("j", "i"))


def _folded(text: Column) -> Column:
    """:func:`fold`, of plain ASCII only its lower case: it has no accents to look for letter by letter."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(fold(text))


def _blanked(text: Column, signs: str) -> Column:
    """Runs of signs (the inside of a character class) and white space as one blank, trimmed: one pass for both."""
    return F.trim(F.regexp_replace(text, rf"[{signs}\s]+", " "))


def _scoring(uv: Column) -> Column:
    return _blanked(uv, PUNCTUATION[1:-2])


def _fingerprint(uv: Column) -> Column:
    return _blanked(uv, PUNCTUATION_AND_SIGNS[1:-2])


def _genre(uv: Column) -> Column:
    return _blanked(_all(uv, ("q3", "que"), ("qz", "que"), ("qʒ", "que"), ("⁊", " et "), ("&", " et ")), "<>")


def _stylo(folded: Column) -> Column:
    out = _all(folded, ("æ", "e"), ("œ", "e"), ("ae", "e"), ("oe", "e"))
    out = _all(_uv_ij(out), ("q3", "que"), ("qz", "que"), ("&", " et "), ("⁊", " et "))
    return F.trim(F.regexp_replace(out, "[^a-z]+", " "))


def _quality(uv: Column) -> Column:
    out = _all(uv, ("q3", "que"), ("&", " et "), ("⁊", " et "))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\[[^\]]*\]", " "), "[^a-z]+", " "))


def _title(folded: Column) -> Column:
    return _all(folded, ("æ", "ae"), ("œ", "oe"), ("ae", "e"), ("oe", "e"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column) -> Column:
    """Struct of the MD5 of all seven forms below, the text being folded once for all of them."""

    def made(folded: Column, uv: Column) -> Column:
        found = {"scoring": _scoring(uv), "fingerprint": _fingerprint(uv), "genre": _genre(uv), "stylo": _stylo(folded), "quality": _quality(uv), "line": squeeze(folded), "title": _title(folded)}
        return F.struct(*[F.md5(c).alias(k) for k, c in found.items()])

    return _bound(_folded(text), lambda f: _bound(_uv_ij(f), lambda uv: made(f, uv)))


def scoring_form(text: Column) -> Column:
    """Folded, v as u and j as i, punctuation as blanks: both sides of an error rate."""
    return _scoring(_uv_ij(_folded(text)))


def fingerprint_form(text: Column) -> Column:
    return _fingerprint(_uv_ij(_folded(text)))


def fingerprint_tokens(text: Column) -> Column:
    """Words of letters only, of whatever alphabet, two at least; null has none."""
    return F.filter(F.split(F.coalesce(fingerprint_form(text), F.lit("")), " "), lambda w: w.rlike(r"^\p{L}{2,}$"))


def genre_form(text: Column) -> Column:
    """Abbreviation signs written out, angle brackets as blanks."""
    return _genre(_uv_ij(_folded(text)))


def delta_tokens(text: Column) -> Column:
    """Runs of a-z in the form of :func:`genre_form`; null has none."""
    return F.regexp_extract_all(F.coalesce(genre_form(text), F.lit("")), F.lit("[a-z]+"), F.lit(0))


def stylo_form(text: Column) -> Column:
    """Orthography of reference sets: ae and oe as e, only a-z."""
    return _stylo(_folded(text))


def quality_form(text: Column) -> Column:
    """Bracketed marks dropped, only a-z."""
    return _quality(_uv_ij(_folded(text)))


def line_form(text: Column) -> Column:
    """Lower case without marks, punctuation and letters as they are."""
    return squeeze(_folded(text))


def title_form(text: Column) -> Column:
    return _title(_folded(text))


def strip_tokens(text: Column) -> Column:
    """Protocol marks removed; of an uncertain reading the first alternative stays."""
    first = F.regexp_replace(text, r"\[uncertain:\s*([^/\]]*?)\s*(?:/[^\]]*)?\]", "$1")
    kinds = "illegible|uncertain|gap|damaged|glyph-uncertain|deletion|insertion|marginalia|superscript|exp|wrap-join"
    return F.regexp_replace(first, rf"\[(?:{kinds})[^\]]*\]", "")


def strip_marks(text: Column, keep_expansions: bool = True) -> Column:
    """Markup removed; expansions are kept or dropped."""
    text = F.regexp_replace(text, r"\[exp:([^\]]*)\]", "$1" if keep_expansions else "")
    for mark in (r"\[unc:[^\]]*\]", r"\[gap[^\]]*\]", r"\[fig:[^\]]*\]", r"\[[^\]]{0,40}\]", r"<[^>]{0,80}>"):
        text = F.regexp_replace(text, mark, "")
    return squeeze(text)


def stream_text(text: Column) -> Column:
    """Marks of what cannot be read and tags as blanks, trimmed at the ends."""
    text = F.regexp_replace(text, r"(?i)\[(?:illegible|unclear|gap|omitted)[^\]]*\]", " ")
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"^\s+|\s+$", "")


def unicode_form(text: Column, form: str = "NFC", casefold: bool = False) -> Column:
    """Exact Unicode form (NFC, NFD, NFKC, NFKD), case-folded if asked; null stays null."""

    def one(v: str | None) -> str | None:
        out = None if v is None else unicodedata.normalize(form, v)
        return out.casefold() if casefold and out is not None else out

    def convert(values: pa.Array) -> pa.Array:
        """In slices: of a batch of texts only one slice at a time is Python strings."""
        return pa.concat_arrays([pa.array(map(one, values.slice(at, SLICE).to_pylist()), pa.string()) for at in range(0, max(1, len(values)), SLICE)])

    # plain ASCII is its own form and does not leave the JVM
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text) if casefold else text).otherwise(F.arrow_udf(convert, "string")(F.when(~plain, text)))


def ocr_text(text: Column) -> Column:
    """Byte order mark dropped, trimmed, composed."""
    return unicode_form(F.regexp_replace(F.replace(text, F.lit("﻿"), F.lit("")), r"^\s+|\s+$", ""), "NFC")


def tagger_form(text: Column) -> Column:
    return unicode_form(text, "NFKD", casefold=True)


def extract_text(text: Column) -> Column:
    """Abbreviation marks dropped, composed for compatibility, other than Latin letters as blanks, long blanks shortened."""
    plain = unicode_form(F.regexp_replace(text, DROPPED_MARKS, ""), "NFKC")
    return F.regexp_replace(F.regexp_replace(plain, "[^\\x09\\x0a\\x0d\\x20-\\x7e -ɏḀ-ỿ]", " "), " {3,}", "  ")


def segments(text: Column, granularity: str = "paragraph", block: int = 12) -> Column:
    """A document's pages, sentences of four words or more, or paragraphs; a text of one paragraph goes by blocks of lines.

    Pages are separated by form feeds. Null has no segments.
    """
    pages = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\f"), _strip), lambda p: p != "")
    if granularity == "page":
        return pages
    full = F.array_join(pages, "\n\n")
    if granularity == "sentence":
        return F.filter(F.transform(F.split(full, r"(?<=[.!?;])\s+"), _strip), lambda p: F.size(F.split(p, r"\s+")) >= 4)
    parts = F.filter(F.transform(F.split(full, r"\n\s*\n"), _strip), lambda p: p != "")
    lines = F.filter(F.transform(F.split(full, "\n"), _strip), lambda p: p != "")
    n = F.ceil(F.size(lines) / block).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.array_join(F.slice(lines, i * block + 1, F.lit(block)), "\n"))
    return F.when(F.size(parts) > 1, parts).otherwise(blocks)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_year(text: Column) -> Column:
    """First number of three or four digits, with its sign; null without one."""
    return F.nullif(F.regexp_extract(text, r"-?\d{3,4}", 0), F.lit("")).cast("int")


def source_key(stem: Column) -> Column:
    """Archive prefix of a file stem: up to the first dash, underscore or dot, and of that the letters with the digits after them."""
    head = F.split(F.split(F.replace(stem, F.lit("_"), F.lit("-")), "-")[0], r"\.")[0]
    prefix = F.regexp_extract(head, r"^([A-Za-z]+\d*)", 1)
    return F.coalesce(F.nullif(prefix, F.lit("")), F.nullif(head, F.lit("")), stem)


def parse_metrics(output: Column) -> Column:
    """Struct of character accuracy, word accuracy (fractions) and number of lines in a tool's output; the last line that names a
    value counts, percentages are divided by 100."""
    lines = F.split(output, "\n")
    number = r"[^0-9]*([0-9]+\.?[0-9]*)"
    chars, words = rf"[Cc]haracter\s+[Aa]ccuracy{number}", rf"[Ww]ord\s+[Aa]ccuracy{number}"

    def last(pattern: str) -> Column:
        found = F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, pattern, 1).cast("double"))
        value = F.element_at(F.concat(F.array(F.lit(None).cast("double")), found), -1)
        return F.when(value <= 1.0, value).otherwise(value / 100)

    bare = F.filter(lines, lambda x: x.rlike(r"^\s*[0-9]\.[0-9]{3,}\s*$"))
    counted = r"(?i)([0-9]+)\s+(?:lines?|samples?)"
    rest = F.filter(lines, lambda x: x.rlike(counted) & ~x.rlike(chars) & ~x.rlike(words))
    n = F.array_max(F.transform(rest, lambda x: F.regexp_extract(x, counted, 1).cast("long")))
    return F.struct(
        F.coalesce(last(chars), F.trim(F.get(bare, 0)).cast("double")).alias("char_accuracy"),
        last(words).alias("word_accuracy"),
        F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"),
    )


def split_model(reference: Column, aliases: dict[str, tuple[str, str]] | None = None) -> Column:
    """Struct of provider and model of an alias, a ``provider/model`` or a bare model name."""
    ref = F.trim(reference)
    provider = F.when(ref.startswith("gemini"), "gemini").when(ref.startswith("gpt"), "openai").otherwise("anthropic")
    model, slash = ref, F.instr(ref, "/")
    provider = F.when(slash > 0, F.lower(F.left(ref, slash - 1))).otherwise(provider)
    model = F.when(slash > 0, F.nullif(F.substring(ref, slash + 1, F.length(ref)), F.lit(""))).otherwise(model)
    for alias, (p, m) in (aliases or {}).items():
        provider = F.when(ref == alias, p).otherwise(provider)
        model = F.when(ref == alias, m).otherwise(model)
    return F.struct(provider.alias("provider"), model.alias("model"))


def scripts_of(values: Column, keywords: dict[str, list[str]], default: str) -> Column:
    """Sorted script tags whose keywords stand as words in the joined values of a configuration, else the default."""
    text = F.lower(F.array_join(values, " "))
    tags = [F.when(text.rlike(r"\b(?:" + "|".join(words) + r")\b"), tag) for tag, words in keywords.items()]
    found = F.array_sort(F.array_compact(F.array(*tags)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def translation_code(language: Column, known: dict[str, str]) -> Column:
    """A translator's code of a language; an unknown one in upper case."""
    key, out = F.lower(F.trim(language)), F.upper(language)
    for name, code in known.items():
        out = F.when(key == name, code).otherwise(out)
    return out


def line_confidence(char_confidences: Column, cuts: Column) -> Column:
    """Least confidence of the characters, else the mean of the cuts, else 0."""
    mean = F.aggregate(cuts, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(cuts), F.lit(0))
    return F.coalesce(F.array_min(char_confidences), mean, F.lit(0.0))


def smooth(points: Column, window: int) -> Column:
    """Moving average over the y of an array of points (x, y), the ends repeated; x stays."""
    n = F.size(points)
    w = F.least(F.lit(window), n)
    pad = F.floor(w / 2).cast("int")
    ys = F.transform(points, lambda p: p["y"].cast("double"))
    padded = F.concat(F.array_repeat(F.element_at(ys, 1), pad), ys, F.array_repeat(F.element_at(ys, -1), pad))

    def mean(i: Column) -> Column:
        part = F.slice(padded, i + 1, w)
        return F.aggregate(part, F.lit(0.0), lambda a, y: a + y) / F.size(part)

    moved = F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), F.bround(mean(i)).cast("int").alias("y")))
    return F.when((F.lit(window) <= 1) | (n < 3), F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).otherwise(moved)


def scale_points(text: Column, sx: Column, sy: Column) -> Column:
    """``"x,y x,y"`` scaled and rounded half to even; tokens that are not pairs of numbers stay."""

    def scaled(token: Column) -> Column:
        parts = F.split(token, ",")
        x, y = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
        whole = F.concat(F.bround(x * sx).cast("long").cast("string"), F.lit(","), F.bround(y * sy).cast("long").cast("string"))
        return F.when(F.size(parts) == 2, F.coalesce(whole, token)).otherwise(token)

    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), scaled), " ")


def flat_polygon(text: Column) -> Column:
    """Points of ``"x,y x,y"`` or of a flat list of numbers ``"x y x y"``."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    n = F.floor(F.size(numbers) / 2).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(numbers, 2 * i).alias("x"), F.get(numbers, 2 * i + 1).alias("y")))
