"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Text and items are normalised alike: ``A-Z`` become lower case and words are the maximal runs of
``0-9 a-z`` and non-ASCII characters. Every run of ``window`` consecutive item words is a pattern (an
item with fewer words, but not none, is one pattern); the automaton reads each document once, and
matches are mapped back through the word index to character offsets of the original text.

Nothing is shuffled: documents are scanned where they are read. The automaton is shipped to the
executors, so its size is checked first: a benchmark of more than ``max_patterns`` word windows is cut into
blocks by a hash of the item, one scan per block, and the blocks' matches are merged per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow, table

WINDOW = 13
#: Word windows that one automaton holds at most: some 160 MB where it is built, 25 MB on its way to the tasks.
MAX_PATTERNS = 250_000
#: Texts of a batch that are Python strings at a time.
SLICE = 64

#: Byte table of the normalisation: lower-cases A-Z, turns ASCII separators into spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8 bytes; null has none."""
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def item_patterns(items: list[tuple[str, str | None]], window: int) -> dict[str, tuple[int, list[str]]]:
    """Pattern (padded with spaces, one character a byte) -> number of words, items that hold it."""
    patterns: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = normal_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            key = (b" " + b" ".join(words[i : i + n]) + b" ").decode("latin-1")
            patterns.setdefault(key, (n, set()))[1].add(item)
    return {k: (n, sorted(ids)) for k, (n, ids) in patterns.items()}


class _Scanner:
    def __init__(self, patterns: dict[str, tuple[int, list[str]]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for key, value in patterns.items():
            self.automaton.add_word(key, value)
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[dict], list[dict], list[str]]:
        """Number of words, hit word ranges, their character spans in ``text``, matching items."""
        words = normal_words(text)
        if not words or self.empty:
            return len(words), [], [], []
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = list(self.automaton.iter(line))
        if not found:
            return len(words), [], [], []
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # space after word i
        items: set[str] = set()
        ranges: list[list[int]] = []
        for end, (n, ids) in sorted((e, v) for e, v in found):
            items.update(ids)
            hi = int(np.searchsorted(after, end)) + 1
            if ranges and hi - n <= ranges[-1][1]:
                ranges[-1][0] = min(ranges[-1][0], hi - n)
                ranges[-1][1] = max(ranges[-1][1], hi)
            else:
                ranges.append([hi - n, hi])
        merged: list[list[int]] = []
        for lo, hi in sorted(ranges):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        raw = text.encode("utf-8")
        solid = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
        starts, ends = edge[0::2], edge[1::2]
        chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to and with this byte
        spans = [{"start": int(chars[starts[a]]) - 1, "end": int(chars[ends[b - 1] - 1])} for a, b in merged]
        return len(words), [{"lo": a, "hi": b} for a, b in merged], spans, sorted(items)


def _sliced(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, of which ``SLICE`` at most are Python strings at a time."""
    for start in range(0, len(texts), SLICE):
        yield from texts.slice(start, SLICE).to_pylist()


_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SCHEMA = (
    "n_words long, ranges array<struct<lo:int,hi:int>>, spans array<struct<start:int,end:int>>, items array<string>"
)


def _scan_block(docs: DataFrame, id_col: str, text_col: str, patterns: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(patterns)
        for batch in batches:
            rows = [scanner.scan(t) for t in _sliced(batch.column(1))]
            n, ranges, spans, items = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in (0, 2, 3)),
                    pa.array(n, pa.int64()),
                    pa.array(ranges, _RANGES),
                    pa.array(spans, _SPANS),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc_id", "text_hash", "text_length", "n_words", "ranges", "spans", "items"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("text_hash"),
        F.length(text).alias("text_length"),
    )
    return map_arrow(source, run, f"doc_id {kind}, text_hash long, text_length int, {_SCHEMA}")


def _merge(ranges: Column, lo: str, hi: str) -> Column:
    """Union of possibly overlapping ranges, in order."""
    return F.aggregate(
        F.array_sort(ranges),
        F.slice(ranges, 1, 0),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)[hi] >= r[lo]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)[lo].alias(lo), F.greatest(F.element_at(acc, -1)[hi], r[hi]).alias(hi)
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(r))),
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """Per document row: ``doc_id, n_words, ranges, spans, items``.

    ``ranges`` are merged hit word ranges (half open), ``spans`` the same as character offsets into the
    original text, ``items`` the matching item ids as sorted strings. Null or empty text has no words
    and no hits; null item texts and items without words match nothing; items with equal texts are all
    reported; repeated document rows each get their row. Other columns of either table are ignored.
    """
    items, blocks = _items(benchmark, item_col, item_text_col, window, max_patterns)
    if blocks == 1:
        return _scan_block(docs, id_col, text_col, _patterns(items, 0, 1, window)).drop("text_hash", "text_length")
    merged = _merged_blocks(docs, id_col, text_col, items, blocks, window)
    one = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return merged.select("*", one.alias("copy")).drop("copies", "copy", "text_hash", "text_length")


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, max_patterns: int) -> tuple[DataFrame, int]:
    """``item, text`` of the benchmark, and the number of blocks it takes."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(F.greatest(words - (window - 1), F.least(words, F.lit(1)))).alias("n")).first()["n"] or 0
    return items, max(1, math.ceil(total / max_patterns))


def _patterns(items: DataFrame, k: int, blocks: int, window: int) -> dict:
    part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
    return item_patterns([(r["item"], r["text"]) for r in part.toLocalIterator()], window)


def _merged_blocks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """One row per ``doc_id, text_hash, text_length``: the matches of all blocks, and its number of ``copies``."""
    found = _scan_block(docs, id_col, text_col, _patterns(items, 0, blocks, window))
    for k in range(1, blocks):
        found = found.unionByName(_scan_block(docs, id_col, text_col, _patterns(items, k, blocks, window)))
    return found.groupBy("doc_id", "text_hash", "text_length").agg(
        F.first("n_words").alias("n_words"),
        _merge(F.flatten(F.collect_set("ranges")), "lo", "hi").alias("ranges"),
        _merge(F.flatten(F.collect_set("spans")), "start", "end").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count("*") / blocks).cast("int").alias("copies"),
    )


def _is_contaminated() -> tuple[Column, Column]:
    """Number of words hit, and the verdict, from ``ranges`` and ``n_words``."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + (r["hi"] - r["lo"]))
    return n_hit, (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def contamination_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the rows of :func:`find_contamination`."""
    n_hit, contaminated = _is_contaminated()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated.alias("contaminated"),
    )


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, in their columns.

    Each row is judged by its text. With a benchmark of one block that is done where the row is read; with more, the
    blocks' verdicts are met by id, hash and length of the text.
    """
    items, blocks = _items(benchmark, "item_id", "text", window, max_patterns)
    if blocks > 1:
        _, contaminated = _is_contaminated()
        merged = _merged_blocks(docs, id_col, text_col, items, blocks, window)
        bad = merged.where(contaminated).select(*[F.col(c).alias(f"__quillon_{c}") for c in ("doc_id", "text_hash", "text_length")])
        same = (
            F.col(id_col).eqNullSafe(F.col("__quillon_doc_id"))
            & (F.xxhash64(F.col(text_col)) == F.col("__quillon_text_hash"))
            & (F.length(F.col(text_col)) == F.col("__quillon_text_length"))
        )
        return docs.join(bad, same, "left_anti").select(*docs.columns)
    patterns = _patterns(items, 0, 1, window)

    @F.arrow_udf("boolean")
    def contaminated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = _Scanner(patterns)
        for texts in batches:
            out = []
            for text in _sliced(texts):
                n, ranges, _, _ = scanner.scan(text)
                hit = sum(r["hi"] - r["lo"] for r in ranges)
                out.append(hit > 0 and 20 * hit >= n)
            yield pa.array(out, pa.bool_())

    return docs.where(~contaminated(F.col(text_col)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination_digest(found)


#: Word windows of the items met with word windows of the documents, as plain joins.
OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i)
  WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM pat), hits AS (
  SELECT d.doc_id, d.i, d.n, p.item_id
  FROM (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
  ) d JOIN pat p ON p.n = d.n AND p.g = d.g
), words AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits
  ) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
