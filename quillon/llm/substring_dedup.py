"""Exact substring deduplication with enhanced suffix arrays.

A byte string of ``length`` bytes that starts in two places, anywhere in the corpus, is a repeat. The corpus is cut so that
equal strings meet: every window of ``length`` bytes belongs to the smallest hash among its ``gram``-byte grams (the
rightmost on ties), which depends on the window's bytes alone; consecutive windows with the same gram form one
stretch. Stretches meet by their gram's hash:

* a gram seen once has no repeats and is dropped at once;
* equal stretches are all repeated, and only their hashes are counted, so thousands of copies are one row;
* where unequal stretches share a gram, the bytes of one stretch of each kind are fetched, and an enhanced
  suffix array (suffixes and common-prefix lengths) over them is scanned with a stack. The scan yields the common-prefix
  intervals of at least ``length``; an interval whose occurrences have different left neighbours is a maximal repeat, put out
  with all its occurrences.

A gram with more than ``max_kinds`` unequal stretches does not go to one task: its windows are hashed (128 bits) and
counted in the cluster, which gives the same verdict on every window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow, maybe_among, stash, table

LENGTH, GRAM = 200, 64
MAX_KINDS = 5_000
#: Bytes of stretches in one suffix array.
BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
#: Positions within one piece of a document; longer documents are read in overlapping pieces.
_PLACE_BITS = 24
_WORD = (1 << 64) - 1
_PLACES = (1 << _PLACE_BITS) - 1
#: Bits of the map of grams seen twice, by which the second pass leaves out most of the others.
_GRAM_MAP_BITS = 26


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_powers_of: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2**64."""
    known = _powers_of.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 15), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers_of[base] = known
    return known[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` consecutive bytes."""
    n = len(data)
    up, down = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def _piece_stretches(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, w = len(data) - length + 1, length - gram + 1
    h = gram_hashes(data, gram)
    m = -(-len(h) // w) * w
    # the place in the low bits, counted down, makes the rightmost of equal grams the smallest
    ranked = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64(_PLACES)
    ranked[: len(h)] = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    blocks = ranked.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[w - 1 : w - 1 + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    places = (low - (least[first] & low)).astype(np.int64)
    return h[places], first, np.diff(np.concatenate([first, [n]]))


def stretches(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with the same smallest gram: its hash, first window, number of windows."""
    data = np.frombuffer(raw, np.uint8)
    parts = [
        (h, first + at, n)
        for at in range(0, len(data) - length + 1, _PLACES - length)
        for h, first, n in [_piece_stretches(data[at : at + _PLACES - 1], length, gram)]
    ]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class SuffixArray:
    """Enhanced suffix array (order and common-prefix lengths) over some byte strings.

    Ranks of prefixes of 8, 16, 32, .. bytes are built by doubling until they cover the longest string; common
    prefixes are read off the same ranks.
    """

    def __init__(self, texts: list[bytes], least: int):
        self.least = least
        joined = b"\0".join(texts) + b"\0" * 8
        data = np.frombuffer(joined, np.uint8)
        n = len(data)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        self.starts = ends - sizes
        self.data = data
        self.ends = ends
        packed = np.zeros(n, np.uint64)
        wide = np.concatenate([data, np.zeros(8, np.uint8)])
        for k in range(8):
            packed |= wide[k : k + n].astype(np.uint64) << np.uint64(8 * (7 - k))
        self.ranks = [np.unique(packed, return_inverse=True)[1].astype(np.int64)]
        self.levels = [8]
        while self.levels[-1] < max(map(len, texts), default=0):
            rank, step = self.ranks[-1], self.levels[-1]
            later = np.zeros(n, np.int64)
            later[:-step] = rank[step:] + 1
            self.levels.append(2 * step)
            self.ranks.append(np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64))
        # only suffixes that leave room for a repeat take part
        owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - least + 1, 0))
        first = np.cumsum(np.maximum(sizes - least + 1, 0))
        at = np.arange(len(owner)) - np.repeat(first - np.maximum(sizes - least + 1, 0), np.maximum(sizes - least + 1, 0))
        places = self.starts[owner] + at
        order = np.argsort(self.ranks[-1][places], kind="stable")
        self.order, self.owner = places[order], owner[order]
        self.common = self._common_prefixes()

    def _common_prefixes(self) -> np.ndarray:
        """Bytes that each suffix in order shares with the one before (0 for the first), within their strings."""
        a, b = self.order[:-1], self.order[1:]
        room = np.minimum(self.ends[self.owner[:-1]] - a, self.ends[self.owner[1:]] - b)
        got = np.zeros(len(a), np.int64)
        last = len(self.data) - 1
        for rank, step in zip(self.ranks[::-1], self.levels[::-1], strict=True):
            same = rank[np.minimum(a + got, last)] == rank[np.minimum(b + got, last)]
            got += np.where(same & (got + step <= room + 8), step, 0)
        for _ in range(8):
            inside = got < room
            same = inside & (self.data[np.minimum(a + got, last)] == self.data[np.minimum(b + got, last)])
            got += same
        return np.concatenate([[0], np.minimum(got, room)])

    def maximal_repeats(self) -> Iterator[tuple[int, np.ndarray]]:
        """Length and all places (in the order array) of every maximal repeat of at least ``least`` bytes."""
        order, common, least = self.order, self.common, self.least
        begins = np.isin(order, self.starts)
        left = np.where(begins, -1, self.data[np.maximum(order - 1, 0)].astype(np.int64))
        diverse = -2
        long = common >= least
        runs = np.flatnonzero(np.diff(np.concatenate([[0], long.view(np.int8), [0]])))
        for lo, hi in zip(runs[0::2], runs[1::2], strict=True):
            heights, before = common[lo:hi].tolist(), left[lo - 1 : hi].tolist()

            def joined(x: int, y: int) -> int:
                return x if x == y and x >= 0 else diverse

            # stack of open intervals: common prefix, first suffix, left neighbour of all or diverse
            stack: list[list[int]] = []
            seen = before[0]
            for k, height in enumerate([*heights, 0]):
                start, neighbour = lo - 1 + k, seen
                while stack and stack[-1][0] > height:
                    size, start, own = stack.pop()
                    neighbour = joined(own, neighbour)
                    if neighbour == diverse:
                        yield size, order[start : lo + k]
                if k < len(heights):
                    if stack and stack[-1][0] == height:
                        stack[-1][2] = joined(stack[-1][2], neighbour)
                    else:
                        stack.append([height, start, neighbour])
                    seen = before[k + 1]
                elif stack:
                    stack.clear()

    def covered(self) -> list[list[tuple[int, int]]]:
        """Byte ranges of each string that lie in a repeat, merged."""
        reach = np.zeros(len(self.data), np.int64)
        for size, places in self.maximal_repeats():
            reach[places] = np.maximum(reach[places], size)
        out: list[list[tuple[int, int]]] = [[] for _ in self.starts]
        hit = np.flatnonzero(reach)
        owner = np.searchsorted(self.ends, hit)
        for o, at, size in zip(owner.tolist(), (hit - self.starts[owner]).tolist(), reach[hit].tolist(), strict=True):
            ranges = out[o]
            if ranges and at <= ranges[-1][1]:
                if at + size > ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], at + size)
            else:
                ranges.append((at, at + size))
        return out


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Bit map of fixed size over the ``gram`` column; collected as at most 2 ** 20 longs."""
    spot = F.shiftrightunsigned("gram", 64 - _GRAM_MAP_BITS)
    low = F.lit(63).cast("long")
    marks = grams.select(
        F.shiftright(spot, 6).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(low).cast("int")).alias("bit"),
    )
    words = marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (_GRAM_MAP_BITS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint64)


def _in_map(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    spot = grams >> np.uint64(64 - _GRAM_MAP_BITS)
    return (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("rid"), F.xxhash64(text).alias("rh"), text.alias("text"))


def _seen_twice(source: DataFrame, length: int, gram: int) -> DataFrame:
    """Grams that are the smallest of windows at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [stretches(t.encode("utf-8"), length, gram)[0] for t in batch.column(0).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["gram"])

    grams = map_arrow(source.select("text"), run, "gram long")
    return grams.groupBy("gram").count().where(F.col("count") > 1).select("gram")


_OCCURRENCE = ["gram", "kind", "rid", "rh", "start", "windows"]


def _occurrences(source: DataFrame, heavy: DataFrame, length: int, gram: int) -> DataFrame:
    """Stretches of the grams of ``heavy``: gram, hash of the bytes, document row, first window, windows."""
    shared = source.sparkSession.sparkContext.broadcast(_bitmap(heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                grams, kinds, rows, starts, windows = [], [], [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    raw = text.encode("utf-8")
                    h, first, n = stretches(raw, length, gram)
                    keep = _in_map(shared.value, h)
                    h, first, n = h[keep], first[keep], n[keep]
                    grams.append(h)
                    starts.append(first)
                    windows.append(n)
                    kinds += [
                        xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)
                    ]
                    rows += [i] * len(h)
                index = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(grams).view(np.int64)),
                        pa.array(np.array(kinds, np.uint64).view(np.int64)),
                        part.column(0).take(index),
                        part.column(1).take(index),
                        pa.array(np.concatenate(starts).astype(np.int32)),
                        pa.array(np.concatenate(windows).astype(np.int32)),
                    ],
                    names=_OCCURRENCE,
                )

    kind = source.schema["rid"].dataType.simpleString()
    rows = map_arrow(source, run, f"gram long, kind long, rid {kind}, rh long, start int, windows int")
    return rows.join(heavy.hint("merge"), "gram", "left_semi")


_RANGES = "array<struct<lo:int,hi:int>>"
_RANGES_TYPE = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _fetch(wanted: DataFrame, source: DataFrame, length: int) -> DataFrame:
    """``gram, kind, bytes`` of the stretches of ``wanted``, cut from their documents."""
    lists = wanted.groupBy("rid", "rh").agg(F.collect_list(F.struct("gram", "kind", "start", "windows")).alias("parts"))
    lists = lists.withColumnsRenamed({"rid": "to_rid", "rh": "to_rh"})
    near = source.where(maybe_among(wanted.select("rh").distinct(), F.col("rh")))
    same = near["rid"].eqNullSafe(lists["to_rid"]) & (near["rh"] == lists["to_rh"])
    met = near.join(lists.hint("merge"), same).select("text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text, cuts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = text.encode("utf-8")
                    rows += [(c["gram"], c["kind"], raw[c["start"] : c["start"] + c["windows"] + length - 1]) for c in cuts]
                grams, kinds, cut = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams, pa.int64()), pa.array(kinds, pa.int64()), pa.array(cut, pa.binary())],
                    names=["gram", "kind", "bytes"],
                )

    # repeated document rows give the same bytes again
    return map_arrow(met, run, "gram long, kind long, bytes binary")


def _covered_by_array(pieces: DataFrame, length: int) -> DataFrame:
    """``gram, kind, ranges`` by enhanced suffix arrays over the stretches of some grams at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            ranges = SuffixArray(list(held.values()), length).covered() if held else []
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in held], pa.int64()),
                    pa.array([k for _, k in held], pa.int64()),
                    pa.array([[{"lo": a, "hi": b} for a, b in r] for r in ranges], _RANGES_TYPE),
                ],
                names=["gram", "kind", "ranges"],
            )
            held.clear()
            return out

        for batch in batches:
            for gram, kind, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if gram != last and size >= BLOCK_BYTES:
                    yield flush()
                    size = 0
                if (gram, kind) not in held:
                    held[gram, kind] = raw
                    size += len(raw)
                last = gram
        yield flush()

    dealt = pieces.repartition("gram").sortWithinPartitions("gram")
    return map_arrow(dealt, run, f"gram long, kind long, ranges {_RANGES}").where(F.size("ranges") > 0)


def _covered_by_count(pieces: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many kinds: every window's hash is counted in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            for gram, kind, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(raw) - length + 1
                if n <= 0:
                    continue
                h = [xxh3_128_intdigest(raw[i : i + length]) for i in range(n)]
                one = np.array([x >> 64 for x in h], np.uint64).view(np.int64)
                two = np.array([x & _WORD for x in h], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gram] * n, pa.int64()), pa.array([kind] * n, pa.int64()), pa.array(one), pa.array(two), pa.array(range(n), pa.int32())],
                    names=["gram", "kind", "one", "two", "at"],
                )

    rows = map_arrow(pieces.dropDuplicates(["gram", "kind"]), run, "gram long, kind long, one long, two long, at int")
    again = rows.groupBy("one", "two").count().where(F.col("count") > 1).select("one", "two")
    hits = rows.join(again.hint("merge"), ["one", "two"], "left_semi")
    ranges = F.collect_list(F.struct(F.col("at").alias("lo"), (F.col("at") + length).alias("hi")))
    return hits.groupBy("gram", "kind").agg(ranges.alias("ranges"))


def repeated_ranges(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    max_kinds: int = MAX_KINDS,
) -> DataFrame:
    """Byte ranges covered by repeats, per document row that has any: ``rid, rh, ranges`` (id, hash of the text;
    ranges may overlap)."""
    source = _source(docs, id_col, text_col)
    heavy = stash(_seen_twice(source, length, gram), "repeated-grams")
    found = stash(_occurrences(source, heavy, length, gram), "stretches")
    one = F.min(F.struct("rid", "rh", "start", "windows")).alias("one")
    kinds = stash(found.groupBy("gram", "kind").agg(F.count("*").alias("n"), one), "kinds")
    bins = kinds.groupBy("gram").agg(F.count("*").alias("n_kinds")).where(F.col("n_kinds") > 1)
    mixed = kinds.join(bins.hint("merge"), "gram").select("gram", "kind", "one.*", "n_kinds")
    mixed = stash(mixed, "mixed-grams")
    pieces = stash(_fetch(mixed, source, length), "stretch-bytes")
    crowded = bins.where(F.col("n_kinds") > max_kinds).select("gram")
    few = pieces.join(crowded.hint("merge"), "gram", "left_anti")
    many = pieces.join(crowded.hint("merge"), "gram", "left_semi")
    whole = kinds.where(F.col("n") > 1).select(
        "gram",
        "kind",
        F.array(F.struct(F.lit(0).alias("lo"), (F.col("one.windows") + (length - 1)).alias("hi"))).alias("ranges"),
    )
    verdicts = whole.unionByName(_covered_by_array(few, length)).unionByName(_covered_by_count(many, length))
    verdicts = stash(verdicts, "verdicts")
    spans = found.join(verdicts.hint("merge"), ["gram", "kind"]).select(
        "rid",
        "rh",
        F.transform("ranges", lambda r: F.struct((r["lo"] + F.col("start")).alias("lo"), (r["hi"] + F.col("start")).alias("hi"))).alias("ranges"),
    )
    return spans.groupBy("rid", "rh").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """Per document row ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that are left).

    A null text counts as empty; texts shorter than ``length`` bytes have no repeats; repeated document rows repeat
    each other's whole texts; other columns are ignored; an empty table gives no rows. Cuts fall between
    bytes, so ``kept`` may not be valid UTF-8.
    """
    source = _source(docs, id_col, text_col)
    ranges = stash(repeated_ranges(docs, id_col=id_col, text_col=text_col, **rule), "repeats")
    near = maybe_among(ranges.select("rh").distinct(), F.col("rh"))
    to = ranges.withColumnsRenamed({"rid": "to_rid", "rh": "to_rh"})
    part = source.where(near)
    same = part["rid"].eqNullSafe(to["to_rid"]) & (part["rh"] == to["to_rh"])
    met = part.join(to.hint("merge"), same, "left").select("rid", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sizes, removed, spans, kept = [], [], [], []
                for text, ranges in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    raw = text.encode("utf-8")
                    merged: list[list[int]] = []
                    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or []):
                        if merged and lo <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], hi)
                        else:
                            merged.append([lo, hi])
                    edges = [0, *(x for m in merged for x in m), len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                    sizes.append(len(raw))
                    removed.append(len(raw) - len(left))
                    spans.append(len(merged))
                    kept.append(left)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    kind = source.schema["rid"].dataType.simpleString()
    cut = map_arrow(met, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(0).cast("long")
    rest = source.where(~near).select(
        F.col("rid").alias("doc_id"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        none.alias("n_removed"),
        none.alias("n_spans"),
        F.encode("text", "utf-8").alias("kept"),
    )
    return cut.unionByName(rest)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
