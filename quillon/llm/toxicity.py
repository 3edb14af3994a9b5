"""Toxicity by class-conditional Kneser-Ney language models over letters.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary labelled texts: after four letters a class's
own counts, then its continuation counts after two letters, then continuation counts after one letter that both
classes share. An n-gram that a class has seen rarely falls back on the lower orders, so rare expressions weigh only as
much as the class evidence carries. A text's log-likelihood ratio is the sum over its letters, normalised by length;
because toxic wording is a few words in a long text, the same ratio is also taken over the text's hottest expressions
(words). A logistic curve over these ratios gives the score. The curve is cross-fitted: every labelled row is measured
with counts that leave out the rows of its own fold (at most ``max_calibration_rows`` rows), while texts are scored with the
counts of all labelled rows outside the held-out fold.

Counts are kept by the exact letters, whatever their alphabet, so no two contexts share a count, and the table grows with the
labelled text. It is counted and turned into ratios in the cluster, for every fold left out and for all in one pass, and texts are
scored against it in blocks of at most ``BLOCK_ROWS`` rows, of which a worker holds one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow, maybe_among, stash, table

DISCOUNT = 0.75
FOLDS, HELD_OUT_FOLD = 5, 0
MAX_CALIBRATION_ROWS = 20_000
#: Rows of the table of ratios that are held at once, and letters that are counted or scored together.
BLOCK_ROWS, CHUNK_LETTERS = 2_000_000, 1 << 20

#: Bits of a letter in a key, and the letter of a context's own row.
_LETTER = 21
_ANY = (1 << _LETTER) - 1

#: High part of the rows of the lower order, whose context is the two letters in the low part.
_LOWER = -1
#: Folds that a row of ratios leaves out, and the last one that leaves out none.
_LEFT_OUT = [f for f in range(FOLDS) if f != HELD_OUT_FOLD] + [None]
_CLASSES = ("ordinary", "toxic")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all else."""
    letters = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            letters[c] = ord(chr(c).lower()[0])
    return letters


def letter_keys(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For every letter (and word end, 0) of a text: the first two letters of its context; the last two and itself."""
    s = _letters()[np.frombuffer((text or "").encode("utf-32-le"), np.uint32)]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    s = np.concatenate([np.zeros(4, np.int64), s[keep].astype(np.int64)])
    n = len(s) - 4
    high = (s[:n] << _LETTER) | s[1 : 1 + n]
    return high, (s[2 : 2 + n] << 2 * _LETTER) | (s[3 : 3 + n] << _LETTER) | s[4 : 4 + n]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK_LETTERS characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_LETTERS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _spread(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    h = high.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + low.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class RatioBlock:
    """Ratios of some contexts by their exact letters, one column for each fold left out and one for none; rows in the order of
    a hash, with the first row of each slot."""

    def __init__(self, high: np.ndarray, low: np.ndarray, ratio: np.ndarray):
        bits = max(1, int(2 * len(high)).bit_length())
        slot = (_spread(high, low) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.bits, self.high, self.low, self.ratio = bits, high[order], low[order], ratio[order].astype(np.float16)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(slot, minlength=1 << bits), out=self.first[1:])

    def _find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = _spread(high, low) >> np.uint64(64 - self.bits)
        at, end = self.first[slot], self.first[slot + np.uint64(1)]
        out = np.full(len(high), -1, np.int32)
        left = np.flatnonzero(at < end)
        at = at[left]
        while len(left):
            hit = (self.low[at] == low[left]) & (self.high[at] == high[left])
            out[left[hit]] = at[hit]
            at = at + 1
            on = ~hit & (at < end[left])
            left, at = left[on], at[on]
        return out

    def ratios(self, high: np.ndarray, low: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """What this block says of each letter: the ratio after its whole context (NaN where it is not known), and what its
        context and the lower order give otherwise (0 where they are in other blocks)."""
        if not len(self.ratio):
            return np.full(len(high), np.nan), np.zeros(len(high))
        of = lambda h, w: np.where((row := self._find(h, w)) >= 0, self.ratio[row, column].astype(np.float64), np.nan)
        exact, rest = of(high, low), np.zeros(len(high))
        left = np.flatnonzero(np.isnan(exact))
        lower = np.full(len(left), _LOWER, np.int64)
        under = of(lower, low[left])
        unknown = np.isnan(under)
        under[unknown] = of(lower[unknown], low[left][unknown] | _ANY)
        rest[left] = np.nan_to_num(of(high[left], low[left] | _ANY)) + np.nan_to_num(under)
        return exact, rest


def letter_ratios(high: np.ndarray, low: np.ndarray, blocks: list[Broadcast], column: int) -> np.ndarray:
    """Ratio of every letter, with one block after the other."""
    exact, rest = np.full(len(high), np.nan), np.zeros(len(high))
    for block in blocks:
        own, other = block.value.ratios(high, low, column)
        exact, rest = np.where(np.isnan(exact), own, exact), rest + other
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)  # read again when its turn comes
    return np.where(np.isnan(exact), rest, exact)


def features(letters: np.ndarray, ratios: np.ndarray) -> list[float]:
    """Length-normalised ratio; ratios of the hottest expression, of the three and of the ten hottest (means), and of the one that
    nine in ten do not reach; log of the number of expressions."""
    n = len(letters)
    if not n:
        return [0.0] * 6
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    edges = np.concatenate([[0], np.flatnonzero(letters == 0) + 1, [n]])
    words = np.sort(np.diff(sums[np.unique(edges)]))
    return [sums[-1] / n, float(words[-1]), float(words[-3:].sum()) / 3, float(words[-10:].mean()), float(words[9 * len(words) // 10]), float(np.log1p(len(words)))]


def all_features(texts: list[str | None], blocks: list[Broadcast], column: int = -1) -> np.ndarray:
    """Features of each text, by the ratios that leave out one fold or (the last column) none."""
    out = []
    for start, end in _chunks(texts):
        keys = [letter_keys(t) for t in texts[start:end]]
        high, low = (np.concatenate(k) for k in zip(*keys, strict=True))
        ratios = letter_ratios(high, low, blocks, column)
        edges = np.cumsum([len(k[0]) for k in keys])[:-1]
        out += [features(a & _ANY, r) for a, r in zip(np.split(low, edges), np.split(ratios, edges), strict=True)]
    return np.array(out).reshape(-1, 6)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on standardised features with balanced classes: mean, scale, weights (bias last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    ridge = np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge @ w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return mean, scale, w


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def _count(kind: str, fold: int) -> str:
    return f"{kind}_{fold}"


def class_counts(labelled: DataFrame) -> DataFrame:
    """``high, low`` and a count for each class and fold (``ordinary_1`` ..): how often each letter follows each context, over all
    rows of ``labelled`` (text, toxic, fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks, folds = (c.to_pylist() for c in batch.columns)
            for start, end in _chunks(texts):
                keys = [letter_keys(t) for t in texts[start:end]]
                high, low = (np.concatenate(k) for k in zip(*keys, strict=True))
                kind = np.repeat(np.array([2 * f + m for f, m in zip(folds[start:end], marks[start:end], strict=True)]), [len(k[0]) for k in keys])
                order = np.lexsort((kind, low, high))
                high, low, kind = high[order], low[order], kind[order]
                new = np.ones(len(high), bool)
                new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (kind[1:] != kind[:-1])
                first = np.flatnonzero(new)
                if len(first):
                    columns = (high[first], low[first], kind[first], np.diff(np.append(first, len(high))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["high", "low", "kind", "n"])

    rows = map_arrow(labelled.select("text", "toxic", "fold"), run, "high long, low long, kind long, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == 2 * f + m, F.col("n"))), F.lit(0)).alias(_count(k, f)) for f in _LEFT_OUT if f is not None for m, k in enumerate(_CLASSES)]
    return rows.groupBy("high", "low").agg(*sums)


def ratio_table(counts: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """``high, low, ratios``: log p(letter | context, toxic) - log p(letter | context, ordinary) for each fold left out and for none
    (null where neither class has seen the letter after the context), for contexts of four letters and, under ``_LOWER``, of two.

    p = max(c - D, 0) / c(h) + D * N(h) / c(h) * lower, where N(h) counts the letters that a class has seen after h. After four letters c
    counts how often, after two in how many contexts of four; below them is the continuation distribution after one letter, of both classes
    and all folds. One more row a context (letter ``_ANY``) is for letters that are not known after it: the ratio of the weights D N / c
    that both classes give to what is below, to which the ratio of the lower order is added.
    """
    context, letter = F.shiftright("low", _LETTER), F.col("low").bitwiseAND(F.lit(_ANY).cast("long"))
    names = {(k, v): f"{k}_without_{v}" for k in _CLASSES for v in _LEFT_OUT}
    seen_by = lambda k, v: sum((F.col(_count(k, f)) for f in _LEFT_OUT if f is not None and f != v), F.lit(0))
    four = counts.select("high", "low", context.alias("context"), *[seen_by(*kv).alias(n) for kv, n in names.items()])
    two = four.groupBy("low").agg(*[F.count_if(F.col(n) > 0).alias(n) for n in names.values()], F.count("*").alias("n"))
    two = two.withColumns({"context": context, "letter": letter, "last": context.bitwiseAND(F.lit(_ANY).cast("long"))})
    pairs = two.groupBy("last", "letter").agg(F.sum("n").alias("n"))  # as many as pairs of letters
    n_letters = pairs.select("letter").distinct().count()
    shared = pairs.select("last", "letter", ((F.col("n") + 0.5) / (F.sum("n").over(Window.partitionBy("last")) + 0.5 * n_letters)).alias("shared"))
    two = two.join(shared, ["last", "letter"])

    def smoothed(rows: DataFrame, keys: list[str], below: Callable[[str], Column]) -> DataFrame:
        """With ``p_<name>`` and the weight of what is below, ``rest_<name>``, of every class and fold left out."""
        one = Window.partitionBy(*keys)
        sums = {f"seen_{n}": F.sum(n).over(one) for n in names.values()} | {f"types_{n}": F.count_if(F.col(n) > 0).over(one) for n in names.values()}
        rows = rows.withColumns(sums)
        rows = rows.withColumns({f"rest_{n}": F.when(F.col(f"seen_{n}") > 0, discount * F.col(f"types_{n}") / F.col(f"seen_{n}")).otherwise(1.0) for n in names.values()})
        own = lambda n: F.when(F.col(f"seen_{n}") > 0, F.greatest(F.col(n) - discount, F.lit(0.0)) / F.col(f"seen_{n}")).otherwise(0.0)
        rows = rows.withColumns({f"p_{n}": own(n) + F.col(f"rest_{n}") * below(n) for n in names.values()})
        return rows.withColumn("first", F.row_number().over(one.orderBy("low")) == 1)

    def ratios(rows: DataFrame, high: Column) -> DataFrame:
        ordinary, toxic = ([names[k, v] for v in _LEFT_OUT] for k in _CLASSES)
        known = [F.when(F.col(o) + F.col(t) > 0, F.log(f"p_{t}") - F.log(f"p_{o}")).cast("float") for o, t in zip(ordinary, toxic, strict=True)]
        rest = [(F.log(f"rest_{t}") - F.log(f"rest_{o}")).cast("float") for o, t in zip(ordinary, toxic, strict=True)]
        own = F.struct("low", F.array(*known).alias("ratios"))
        base = F.struct(F.col("low").bitwiseOR(F.lit(_ANY).cast("long")).alias("low"), F.array(*rest).alias("ratios"))
        found = rows.select(high.alias("high"), F.explode(F.when(F.col("first"), F.array(own, base)).otherwise(F.array(own))).alias("row"))
        return found.select("high", "row.*")

    two = stash(smoothed(two, ["context"], lambda n: F.col("shared")), "letters-after-two")
    lower = two.select("low", *[F.col(f"p_{n}").alias(f"below_{n}") for n in names.values()])
    four = smoothed(four.join(lower, "low"), ["high", "context"], lambda n: F.col(f"below_{n}"))
    return ratios(four, F.col("high")).unionByName(ratios(two, F.lit(_LOWER).cast("long")))


def ratio_blocks(table: DataFrame, block_rows: int = BLOCK_ROWS) -> list[Broadcast]:
    """The table in blocks of about ``block_rows`` rows, all rows of a context in one; the driver holds one at a time."""
    n = max(1, -(-table.count() // block_rows))
    which = F.pmod(F.xxhash64("high", F.shiftright("low", _LETTER)), F.lit(n))
    blocks = []
    for k in range(n):
        found = (table if n == 1 else table.where(which == k)).toArrow()
        ratios = found.column("ratios").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        block = RatioBlock(found.column("high").to_numpy(), found.column("low").to_numpy(), ratios.reshape(-1, len(_LEFT_OUT)))
        blocks.append(table.sparkSession.sparkContext.broadcast(block))
        del found, ratios, block
        blocks[-1].__dict__.pop("_value", None)
    return blocks


def train_scorer(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_calibration_rows: int = MAX_CALIBRATION_ROWS,
) -> Callable[[Column], Column]:
    """A function from a text column to its score column, learnt from the labelled rows.

    Rows of the held-out fold are never read for learning. Null labels are ignored; a document with several label
    rows has the largest. Without labelled rows of both classes every score is 0.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.max(label_col).cast("int").alias("toxic"))
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold(id_col, FOLDS).alias("fold"))
    usable = usable.where((F.col("fold") != HELD_OUT_FOLD) & maybe_among(known.select("id"), F.col("id")))
    labelled = stash(usable.join(known.hint("merge"), "id"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return lambda text: F.lit(0.0)
    blocks = ratio_blocks(stash(ratio_table(stash(class_counts(labelled), "letter-counts")), "letter-ratios"))

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series, folds: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype="object")
        for column, own in enumerate(_LEFT_OUT):
            at = np.flatnonzero(folds.to_numpy() == own) if own is not None else []
            for i, x in zip(at, all_features(texts.iloc[at].tolist(), blocks, column) if len(at) else (), strict=True):
                out.iloc[i] = x
        return out

    share = min(1.0, max_calibration_rows / sum(sizes.values()))
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = sample.select("toxic", measure("text", F.col("fold").cast("int")).alias("x")).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows])
    if len(set(y.tolist())) < 2:
        return lambda text: F.lit(0.0)
    mean, scale, w = fit_logistic(x, y)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        x = all_features(texts.tolist(), blocks)
        z = ((x - mean) / scale) @ w[:-1] + w[-1]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row ``doc_id, held_out, score, predicted``.

    Null and empty texts are scored as texts without letters; very long texts are scored whole, letters by the million; repeated
    rows each get their row, so there are no ties; columns besides id and text are ignored; an empty table gives no rows.
    """
    score = train_scorer(docs, labels, id_col=id_col, text_col=text_col)
    scored = docs.select(
        F.col(id_col).alias("doc_id"),
        (fold(id_col, FOLDS) == HELD_OUT_FOLD).alias("held_out"),
        score(F.col(text_col)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
