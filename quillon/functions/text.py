"""Folding, canonical forms, tokens and n-grams as column expressions (whole-stage code, no UDF)."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Precomposed letters of the basic plane and their bases, by the rule: decompose, drop marks, one letter left."""
    source, target = [], []
    for point in range(0xC0, min(sys.maxunicode, 0x1F00)):
        letter = chr(point)
        bare = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.category(c).startswith("M"))
        if bare != letter and len(bare) == 1 and letter.lower() == letter:
            source.append(letter)
            target.append(bare)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents: precomposed letters by table, combining marks removed."""
    source, target = _fold_table()
    return F.regexp_replace(F.translate(F.lower(text), source, target), r"\p{M}+", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical(text: Column) -> Column:
    """Folded, v and j as u and i, everything but letters and digits as single blanks."""
    return squeeze(F.regexp_replace(F.translate(fold(text), "vj", "ui"), "[^a-z0-9]+", " "))


def tokens(text: Column, least: int = 2) -> Column:
    """Folded ASCII words of at least ``least`` letters; null has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0))


def ascii_edit_form(text: Column) -> Column:
    """A form on which byte and letter edit distances agree: folded, sharp s written out."""
    return F.replace(fold(text), F.lit("ß"), F.lit("ss"))


def strip_markup(text: Column) -> Column:
    """Protocol markers removed: of alternatives the first stays, expansions stay, other marks go."""
    text = F.regexp_replace(text, r"\[uncertain:\s*([^/\]]*)[^\]]*\]", "$1")
    text = F.regexp_replace(text, r"\[exp:([^\]]*)\]", "$1")
    text = F.regexp_replace(text, r"\[(?:unc|gap|fig)[^\]]*\]", "")
    return F.regexp_replace(F.regexp_replace(text, r"\[[^\]]{0,40}\]", ""), r"<[^>]{0,80}>", "")


def chunk_words(words: Column, size: int) -> Column:
    """Near-even chunks that do not overlap: as many as fit, at least one, the last takes the remainder."""
    n = F.greatest(F.lit(1), F.floor(F.size(words) / size).cast("int"))
    each = F.floor(F.size(words) / n).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    return F.transform(
        at, lambda i: F.slice(words, i * each + 1, F.when(i == n - 1, F.size(words)).otherwise(each))
    )


def rolling_window(n: Column) -> Column:
    """Struct of window size and step for a text of ``n`` words; nulls below 120 words."""
    third, sixth = F.floor(n / 3).cast("int"), F.floor(n / 6).cast("int")
    size = F.when(n < 120, None).when(n < 500, F.greatest(F.lit(80), third)).when(n < 1500, 250).otherwise(400)
    step = F.when(n < 120, None).when(n < 500, F.greatest(F.lit(40), sixth)).when(n < 1500, 150).otherwise(250)
    return F.struct(size.cast("int").alias("size"), step.cast("int").alias("step"))


def parse_years(text: Column) -> Column:
    """Struct of the first and last year in a messy date: four-digit years of 1000-2100, ``17uu`` as a century."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{4}(?!\d)"), F.lit(0)), lambda y: y.cast("int"))
    years = F.filter(years, lambda y: (y >= 1000) & (y <= 2100))
    cents = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d\d)uu"), F.lit(1)), lambda c: c.cast("int") * 100)
    both = F.concat(years, cents, F.transform(cents, lambda c: c + 99))
    return F.struct(F.array_min(both).alias("first"), F.array_max(both).alias("last"))


def safe_id(text: Column, longest: int = 120) -> Column:
    """Letters, digits, dot, underscore and dash only; trimmed of the last three; ``job`` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(F.left(clean, F.lit(longest)), F.lit("")), F.lit("job"))
