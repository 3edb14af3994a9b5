"""Periodic runs of words, found by internal pattern matching.

The words of some texts lie as one flat array of symbols, numbered within each text, so that texts never match one another.
Prefix doubling gives for every dyadic length B the class of each block of B words; classes are intervals of the suffix array. A
wavelet tree over the array answers for a block at ``s`` where it begins next after ``s`` (range successor of ``s`` in its
interval). Within a neighbouring window of B words the occurrences of a block form an arithmetic progression, whose difference is
the distance to the first of them: the candidate period. A candidate is extended to both sides by the classes themselves
(dyadic steps of equal blocks) and kept if it is long enough.

No run is missed: for a run of period q and length of 4 q or more let B be the least power of two that is not under q. Blocks
begin at all multiples of B / 2, so one of them lies, with its copy q words later, inside the run (it has 3 q - B + 1 >= B / 2
places to begin). A block of at least q words begins within the run at multiples of q only, so its successor is at q. No candidate
is wrong: a shorter period of the stretch would divide q and would have been the successor.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words that are searched together (a longer text alone).
FLAT_WORDS = 150_000
MIN_LENGTH, MIN_EXPONENT = 6, 4


class WaveletTree:
    """Range successor over an array that holds the numbers 0 .. n-1, each once; queries come as arrays."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(1, int(n - 1).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least number over ``bound`` in places ``low`` to ``high`` (not included), -1 where there is none."""
        rank = self._count(low, high, bound + 1)
        some = np.flatnonzero(rank < high - low)
        out = np.full(len(low), -1, np.int64)
        out[some] = self._select(low[some], high[some], rank[some])
        return out

    def _count(self, low: np.ndarray, high: np.ndarray, under: np.ndarray) -> np.ndarray:
        found = np.where(under >> self.bits > 0, high - low, 0)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            a, b, one = zeros[low], zeros[high], (under >> bit) & 1 == 1
            found += np.where(one & (under >> self.bits == 0), b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found

    def _select(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        value = np.zeros(len(low), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            value |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return value


class BlockClasses:
    """Classes of blocks of 1, 2, 4 .. words of a flat array, as places in its suffix array.

    ``ranks[k][i]`` is where the class of the block of 2**k words at ``i`` begins in the suffix array; position ``n`` is a class of
    its own. Only blocks whose class has other members are sorted again, so texts without long repeats cost little.
    """

    def __init__(self, symbols: np.ndarray, longest: int):
        n = self.n = len(symbols)
        width = int(n).bit_length()
        key = np.sort((symbols.astype(np.int64) << width) | np.arange(n))
        suffixes, sorted_symbols = key & ((1 << width) - 1), key >> width
        start = np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]])
        rank = np.full(n + 1, -1, np.int64)
        rank[suffixes] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        self.suffixes, self.ranks, self.shared = suffixes, [rank], []
        active = suffixes[~(start & np.append(start[1:], True))]
        self.shared.append(active)
        step = 1
        while len(active) and step < longest:
            active = self._refine(active, step, width)
            self.shared.append(active)
            step *= 2

    def _refine(self, active: np.ndarray, step: int, width: int) -> np.ndarray:
        last, n = self.ranks[-1], self.n
        first, second = last[active], last[np.minimum(active + step, n)] + 1
        if 3 * width + 2 < 63:
            key = np.sort((first << (2 * width + 1)) | (second << width) | active)
            active, pair = key & ((1 << width) - 1), key >> width
            first = pair >> (width + 1)
        else:
            order = np.lexsort((second, first))
            active, first, second = active[order], first[order], second[order]
            pair = first * (n + 2) + second
        at = np.arange(len(active))
        old = np.maximum.accumulate(np.where(np.concatenate([[True], first[1:] != first[:-1]]), at, 0))
        start = np.concatenate([[True], pair[1:] != pair[:-1]])
        new = np.maximum.accumulate(np.where(start, at, 0))
        rank = last.copy()
        rank[active] = first + new - old
        self.suffixes[first + at - old] = active
        self.ranks.append(rank)
        return active[~(start & np.append(start[1:], True))]

    def extend(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words before, and from, positions ``i`` < ``j`` are equal."""
        out = []
        for back in (True, False):
            got = np.zeros(len(i), np.int64)
            for k in range(len(self.ranks) - 1, -1, -1):
                rank, step, on = self.ranks[k], 1 << k, np.arange(len(i))
                while len(on):
                    shift = -got[on] - step if back else got[on]
                    a, b = i[on] + shift, j[on] + shift
                    inside = (a >= 0) & (b < self.n)
                    on = on[inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, self.n)])]
                    got[on] += step
                    if k < len(self.ranks) - 1:
                        break  # two equal steps would have been one of the level above
            out.append(got)
        return out[0], out[1]


def find_runs(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run in texts that lie one after another; symbols of different texts differ."""
    longest = int(sizes.max(initial=0)) // MIN_EXPONENT
    if len(symbols) < MIN_LENGTH:
        return (np.empty(0, np.int64),) * 3
    blocks = BlockClasses(symbols, 2 * longest)
    same = np.flatnonzero(symbols[1:] == symbols[:-1])
    starts, periods = [same[np.concatenate([[True], same[1:] != same[:-1] + 1])[: len(same)]]], []  # neighbouring windows of one word
    periods.append(np.ones(len(starts[0]), np.int64))
    if len(blocks.ranks) > 1 and len(blocks.shared[1]):
        spots = np.sort(blocks.shared[1])  # blocks of two words that begin elsewhere too; longer ones are among them
        number = np.full(blocks.n + 1, -1, np.int64)
        number[spots] = np.arange(len(spots))
        kept = number[blocks.suffixes] >= 0
        tree = WaveletTree(number[blocks.suffixes[kept]])
        place = np.concatenate([[0], np.cumsum(kept)])
        for k in range(1, len(blocks.ranks)):
            half, block = 1 << (k - 1), 1 << k
            if half >= longest:
                break
            members = blocks.shared[k]
            ranks, sizes_of = np.unique(blocks.ranks[k][members], return_counts=True)
            at = np.sort(members[members % half == 0])
            low = blocks.ranks[k][at]
            high = low + sizes_of[np.searchsorted(ranks, low)]
            after = tree.successor(place[low], place[high], number[at])
            d = np.where(after >= 0, spots[after] - at, 0)
            hit = (d > half) & (d <= block)
            at, d = at[hit], d[hit]
            fresh = np.ones(len(at), bool)  # the block half a length earlier gave the same run
            fresh[1:] = (at[1:] - at[:-1] != half) | (d[1:] != d[:-1])
            starts.append(at[fresh])
            periods.append(d[fresh])
    at, d = np.concatenate(starts), np.concatenate(periods)
    before, behind = blocks.extend(at, at + d)
    length = before + behind + d
    good = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * d)
    found = np.unique(np.stack([at[good] - before[good], length[good], d[good]], 1), axis=0)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def planted(words: list[str], doc_id: object) -> list[str]:
    """The words with the contract's planted tail: a tenth of all ids gets a repeated stretch (rows without an id stay)."""
    if not words or doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // len(tail) + 1))[: n - a]


def _judge(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """The result columns of one text."""
    if not runs:
        return 0, None, None, None, None, _hash(""), _hash(" ".join(words))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    kept = " ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return len(runs), *best, 1000 * best[1] // best[2], _hash(listed), _hash(kept)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def judge_texts(texts: list[list[str]]) -> list[tuple]:
    """``n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of texts given as word lists."""
    parts, first = [], 0
    for words in texts:
        number: dict[str, int] = {}
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + first)
        first += len(words)
    sizes = np.array([len(w) for w in texts], np.int64)
    start, length, period = find_runs(np.concatenate(parts) if parts else np.empty(0, np.int64), sizes)
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(start, ends)
    out, last = [], 0
    for words, end, cut in zip(texts, ends.tolist(), cuts.tolist(), strict=True):
        own = slice(last, cut)
        shift = end - len(words)
        out.append(_judge(words, list(zip((start[own] - shift).tolist(), length[own].tolist(), period[own].tolist(), strict=True))))
        last = cut
    return out


_COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """Per document row its runs in digest: ``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``.

    A run is a maximal stretch of words of smallest period q and at least ``max(6, 4 q)`` words; a word in a run after its first q
    is left out of the collapsed text. ``plant`` puts the contract's repeats into a tenth of the texts first. Null and empty texts
    have no words and no run (nulls for the longest run, hashes of empty strings). Of runs of equal length the one that starts
    first counts, then the shorter period. Very long texts are searched whole, each alone (some 200 bytes a word); repeated rows each
    get their row; rows without an id are not planted; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, some, held = 0, [], 0
            for k, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                words = WORD.findall(text) if text else []
                some.append(planted(words, doc) if plant else words)
                held += len(words)
                if held >= FLAT_WORDS or k == len(ids) - 1:
                    columns = zip(*judge_texts(some), strict=True)
                    arrays = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *arrays], names=names)
                    at, some, held = k + 1, [], 0

    names = ["doc_id", *(c.split()[0] for c in _COLUMNS.split(", "))]
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, {_COLUMNS}")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)


OP11_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), base AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'),
      lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1),
      lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS h
  FROM documents, tab
), shape AS (
  SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM base
), spelt AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE w[:a] || list_transform(range(n - a), lambda i: w[1 + a + i % (1 + (n - a) // (3 + g % 8))]) END AS w
  FROM shape
), word AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(w) AS x FROM spelt
), three AS (
  SELECT *, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM word WINDOW o AS (PARTITION BY r ORDER BY i)
), pair AS (
  SELECT a.r, b.i - a.i AS p, a.i FROM three a JOIN three b ON a.r = b.r AND a.x = b.x AND a.y = b.y AND a.z = b.z
    AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), island AS (
  SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM pair
), stretch AS (
  SELECT r, p, min(i) AS s, max(i) + 3 + p - min(i) AS l FROM island GROUP BY r, p, k
), long AS (
  SELECT * FROM stretch WHERE l >= greatest(6, 4 * p)
), run AS (
  SELECT * FROM long q WHERE NOT EXISTS (
    SELECT 1 FROM long v WHERE v.r = q.r AND v.p < q.p AND v.s <= q.s AND v.s + v.l >= q.s + q.l)
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS runs,
    min_by([s, l, p], [-l, s, p]) AS best FROM run GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(s + p, s + l)) AS i FROM run
), kept AS (
  SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS t FROM word LEFT JOIN gone ON gone.r = word.r AND gone.i = word.i
  WHERE gone.i IS NULL GROUP BY word.r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
  CAST(1000 * best[2] // best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM spelt LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
