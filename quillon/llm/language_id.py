"""Language identification by hyperdimensional profiles.

Every letter has a random +-1 vector (drawn from its code point). A letter trigram is the product of its letters'
vectors, rotated by two, one and no places; a text is the sum (bundle) of its trigrams' vectors, words being
separated by a blank letter. A language's prototype is the bundle of all its training texts, and a text
gets the language of the largest cosine.

Prototypes are sums, so each task adds up its rows and only languages x dimensions numbers are
brought together, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow, table
from quillon.llm.toxicity import fold

DIMENSIONS = 1024
FOLDS, HELD_OUT_FOLD = 4, 2
SEED = 20_011
#: Characters of text in one step of the encoder, and trigram vectors that a worker remembers.
STEP_CHARS, MEMO_VECTORS = 200_000, 60_000
#: Distinct trigrams whose vectors are multiplied at once.
CODE_STEP = 8_192


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    is_letter = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            is_letter[c] = chr(c).isalpha()
    return is_letter


def _letters_of(text: str | None) -> np.ndarray:
    """Code points of a text's letters, with one 0 before, between and after words; empty without a letter.

    The text is read in steps, so a long one takes little more memory than its letters.
    """
    text, parts = text or "", []
    for at in range(0, len(text), STEP_CHARS):
        points = np.frombuffer(text[at : at + STEP_CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        parts.append(np.where(_letters()[points], points, 0).astype(np.int32))
    s = np.concatenate([np.zeros(1, np.int32), *parts, np.zeros(1, np.int32)])
    if not s.any():
        return np.zeros(0, np.int32)
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    keep[0] = True
    return s[keep]


def trigram_steps(text: str | None) -> Iterator[np.ndarray]:
    """Codes of the letter trigrams of a text (three code points of 21 bits), ``STEP_CHARS`` at a time; nothing if it has no letter."""
    s = _letters_of(text)
    for at in range(0, max(0, len(s) - 2), STEP_CHARS):
        part = s[at : at + STEP_CHARS + 2].astype(np.int64)
        yield (part[:-2] << 42) | (part[1:-1] << 21) | part[2:]


def trigrams(text: str | None) -> np.ndarray:
    """All trigrams of a text together."""
    return np.concatenate([np.zeros(0, np.int64), *trigram_steps(text)])


class Encoder:
    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((1024, dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            bits = np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dimensions)
            self.letters[point] = (2 * bits - 1).astype(np.int8)
        return self.letters[point]

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of some distinct trigrams."""
        if len(self.rows) > MEMO_VECTORS:
            self.rows.clear()
        for code in codes.tolist():
            if code not in self.rows:
                a, b, c = (self.letter(code >> s & 0x1FFFFF) for s in (42, 21, 0))
                row = len(self.rows)
                if row >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[row] = np.roll(a, 2) * np.roll(b, 1) * c
                self.rows[code] = row
        return self.vectors[[self.rows[c] for c in codes.tolist()]].astype(np.float32)

    def bundles(self, grams: list[np.ndarray], groups: list[int], n: int) -> np.ndarray:
        """Sum of the vectors of the trigram lists of each group, (n, dimensions)."""
        flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        if not len(flat):
            return np.zeros((n, self.dimensions), np.float32)
        codes, at = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.asarray(groups, np.int64), [len(g) for g in grams])
        out = np.zeros((n, self.dimensions), np.float32)
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        for start in range(0, len(codes), CODE_STEP):
            lo, hi = np.searchsorted(at, [start, start + CODE_STEP])
            m = min(CODE_STEP, len(codes) - start)
            counts = np.bincount(owner[lo:hi] * m + at[lo:hi] - start, minlength=n * m).reshape(n, m)
            out += counts.astype(np.float32) @ self.matrix(codes[start : start + m])
        return out

    def texts(self, texts: list[str | None], groups: list[int], n: int) -> np.ndarray:
        """Sum of the trigram vectors of the texts of each group, (n, dimensions); about ``STEP_CHARS`` letters at a time."""
        out = np.zeros((n, self.dimensions))
        grams, owners, size = [], [], 0
        for text, group in zip(texts, groups, strict=True):
            for part in trigram_steps(text):
                grams.append(part)
                owners.append(group)
                size += len(part)
                if size >= STEP_CHARS:
                    out += self.bundles(grams, owners, n)
                    grams, owners, size = [], [], 0
        return out + self.bundles(grams, owners, n)


@lru_cache(maxsize=1)
def _encoder() -> Encoder:
    return Encoder()


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP_CHARS characters, 64 texts at most."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= STEP_CHARS or i - start >= 63:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train_prototypes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes, from rows outside the held-out fold with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _steps(texts):
                names = sorted(set(langs[a:b]))
                part = _encoder().texts(texts[a:b], [names.index(x) for x in langs[a:b]], len(names))
                for name, vector in zip(names, part, strict=True):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        n = DIMENSIONS
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array(np.rint(vector).astype(np.int64))],
                names=["lang", "dimension", "total"],
            )

    usable = (fold(id_col, FOLDS) != HELD_OUT_FOLD) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    source = docs.where(usable).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = map_arrow(source, run, "lang string, dimension int, total long")
    rows = parts.groupBy("lang", "dimension").agg(F.sum("total").alias("total")).collect()
    langs = sorted({r["lang"] for r in rows})
    prototypes = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        prototypes[langs.index(r["lang"]), r["dimension"]] = r["total"]
    return langs, prototypes


def identify_language(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Per document row ``doc_id, held_out, lang_pred, score``.

    ``score`` is the cosine to the prototype, negative ones as 0. Null texts, texts without a letter, and all texts
    if there is nothing to learn from, are ``und`` with score 0; equal cosines go to the first language in
    order; repeated rows each get their row; other columns are ignored.
    """
    langs, prototypes = train_prototypes(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        texts, names, scores = texts.tolist(), [], []
        for a, b in _steps(texts):
            x = _encoder().texts(texts[a:b], list(range(b - a)), b - a).astype(np.float32)
            norms = np.linalg.norm(x, axis=1)
            cosine = (x @ unit.T) / np.maximum(norms, 1e-12)[:, None] if langs else np.zeros((b - a, 0))
            for i in range(b - a):
                known = bool(langs) and norms[i] > 0
                best = int(cosine[i].argmax()) if known else 0
                names.append(langs[best] if known else "und")
                scores.append(float(np.clip(cosine[i, best], 0, 1)) if known else 0.0)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    predicted = docs.select(
        F.col(id_col).alias("doc_id"),
        (fold(id_col, FOLDS) == HELD_OUT_FOLD).alias("held_out"),
        predict(F.col(text_col)).alias("p"),
    )
    return predicted.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
