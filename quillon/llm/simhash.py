"""SimHash near-duplicates found by fuzzy hashing with the perfect Golay code.

A fingerprint's 64 bits are cut into three segments, each read as a word of the (23, 12) Golay code. Every
word is within three bits of exactly one codeword; the indices of the codewords that the word and its one-bit
neighbours decode to are its fuzzy keys (at most six), and two words at most two bits apart share a key.
Four differing bits over three segments leave, by the pigeonhole principle, one of two cases:

* a segment is equal and another differs in two bits at most: key = the equal segment with a fuzzy
  key of the other;
* two segments differ in one bit at most each: one side's own codeword indices are among the other
  side's fuzzy keys, for both segments.

Candidates that share a key are verified by their differing bits. Distinct fingerprints are joined, not
documents, so any number of copies is one row; within a key, groups are linked by a search that leaves a
fingerprint as soon as it is reached, so no table of all pairs arises; components are then formed in the cluster.

Four of 64 bits is the reach of nearly equal texts. For near copies as usually understood (five-word shingles, a
similarity of 0.8 or more) :func:`near_copy_groups` takes two longer fingerprints of a text: one of its words, which a
few changed words hardly turn and whose six segments give the fuzzy keys (the codeword of one segment with a nearby
codeword of another), and one of its distinct shingles, by which each key's texts are joined to their nearest. These
links are then verified by the Jaccard similarity of the whole texts.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import drop_stash, map_arrow, maybe_among, stash, table
from quillon.llm.components import connected_components

SHINGLE, SEED, MAX_DISTANCE = 4, 42, 4
#: Shingle and Jaccard similarity of near copies, and the bits of 96 by which the fingerprints of candidates may differ: at a
#: similarity s they differ in arccos(2 s / (1 + s)) / pi of the bits, 14.6 at 0.8; 22 leaves room for two standard deviations.
NEAR_SHINGLE, NEAR_SIMILARITY, NEAR_DISTANCE = 5, 0.8, 22
#: Segments as (first bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code (fixed value): x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Rows that one step of the linking reads at least.
BLOCK_ROWS = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    k = min(shingle, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    hashes = np.fromiter(
        (xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=True)), np.uint64, len(starts)
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each bit, and error pattern of each syndrome."""
    bits = np.array([_remainder(1 << i) for i in range(23)], np.int64)
    errors = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for at in itertools.combinations(range(23), weight):
            errors[np.bitwise_xor.reduce(bits[list(at)])] = sum(1 << i for i in at)
    return bits, errors


def _syndromes(words: np.ndarray) -> np.ndarray:
    bits, _ = _golay()
    out = np.zeros(len(words), np.int64)
    for i in range(23):
        out ^= np.where(words >> i & 1, bits[i], 0)
    return out


def fuzzy_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices near each word of ``width`` bits: its own first, then those of its one-bit
    neighbours; -1 fills the rest of the six columns."""
    bits, errors = _golay()
    syndromes = _syndromes(words)
    own = (words ^ errors[syndromes]) >> 11
    flips = np.arange(width)
    near = (words[:, None] ^ (1 << flips)[None, :]) ^ errors[syndromes[:, None] ^ bits[None, :width]]
    near = np.sort(np.column_stack([own, near >> 11]), axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    first &= near != own[:, None]
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = own
    row, col = np.nonzero(first)
    out[row, np.cumsum(first, axis=1)[row, col]] = near[row, col]
    return out


def key_rows(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of some fingerprints and the fingerprint of each; the lowest bit is 1 for a key that only probes."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    fuzzy = [fuzzy_keys(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    owner = np.arange(len(prints))
    keys, owners = [], []

    def put(kind: int, value: np.ndarray, probe: np.ndarray, keep: np.ndarray) -> None:
        row, col = np.nonzero(keep)
        keys.append((((np.int64(kind) << 36) | value[row, col]) << 1) | probe[row, col])
        owners.append(owner[row])

    kind = 0
    for equal, other in itertools.permutations(range(3), 2):
        near = fuzzy[other]
        put(kind, (parts[equal][:, None] << 12) | near, np.zeros(near.shape, np.int64), near >= 0)
        kind += 1
    for i, j in itertools.combinations(range(3), 2):
        a, b = np.repeat(fuzzy[i], 6, axis=1), np.tile(fuzzy[j], (1, 6))
        probe = np.ones(a.shape, np.int64)
        probe[:, 0] = 0  # the fingerprint's own codewords
        put(kind, (a << 12) | b, probe, (a >= 0) & (b >= 0))
        kind += 1
    return np.concatenate(keys), prints[np.concatenate(owners)]


class _Forest:
    """Union-find that tells whether a link says something new."""

    def __init__(self, limit: int = 1_000_000):
        self.parent: dict[tuple, tuple] = {}
        self.limit = limit

    def find(self, x: tuple) -> tuple:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def join(self, a: tuple, b: tuple) -> bool:
        if len(self.parent) > self.limit:
            self.parent.clear()
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[a] = b
        return True


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, which are rows of one or two words."""
    return np.bitwise_count(a ^ b).sum(axis=-1)


def link_group(prints: np.ndarray, distance: int = MAX_DISTANCE) -> list[tuple]:
    """Links that connect all of ``prints`` (distinct rows of words) within ``distance`` bits of each other: one a
    fingerprint reached, and none between fingerprints that are connected already."""
    links, left = [], prints
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = _differ(left, x) <= distance
            if near.any():
                hits, left = left[near], left[~near]
                links += [(_name(x), _name(h)) for h in hits]
                frontier += list(hits)
    return links


def _name(words: np.ndarray) -> tuple[int, ...]:
    return tuple(words.tolist())


def _link_sorted(groups: np.ndarray, probing: np.ndarray, prints: np.ndarray, distance: int) -> Iterator[tuple]:
    """Links within equal groups; rows (of one word) sorted by group, those that only probe last, then by fingerprint."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(groups)]]))
    held = probing[starts] == 0
    two = starts[held & (sizes == 2)]
    for i in two[_differ(prints[two], prints[two + 1]) <= distance]:
        yield _name(prints[i]), _name(prints[i + 1])
    for i, n in zip(*(x[held & (sizes > 2)] for x in (starts, sizes)), strict=True):
        yield from link_group(np.unique(prints[i : i + n, 0])[:, None], distance)


def nearest_links(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """The shortest links (of rows) that connect ``prints`` within ``distance`` bits: a spanning forest of least total
    length, so that every fingerprint is linked with its nearest."""
    links, rest = [], np.arange(1, len(prints))
    gap, by = _differ(prints[1:], prints[0]), np.zeros(len(rest), np.int64)
    while len(rest):
        k = int(np.argmin(gap))
        at = int(rest[k])
        if gap[k] <= distance:
            links.append((int(by[k]), at))
        rest, gap, by = (np.delete(x, k) for x in (rest, gap, by))
        own = _differ(prints[rest], prints[at])
        closer = own < gap
        gap, by = np.where(closer, own, gap), np.where(closer, at, by)
    return links


def _whole_groups(batches: Iterator[pa.RecordBatch], unpack: Callable) -> Iterator[list[np.ndarray]]:
    """Rows of sorted batches as arrays (the group first), ``BLOCK_ROWS`` or more at a time, each group whole."""
    kept: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        kept.append(unpack(*(c.to_numpy().view(np.uint64) for c in batch.columns)))
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            held = [np.concatenate(x) for x in zip(*kept, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if cut:
                yield [x[:cut] for x in held]
            kept, rows = [tuple(x[cut:] for x in held)], len(held[0]) - cut if cut else 0
    if kept:
        held = [np.concatenate(x) for x in zip(*kept, strict=True)]
        if len(held[0]):
            yield held


def _link_batch(links: list[tuple], names: list[str]) -> pa.RecordBatch:
    pairs = np.array(links, np.uint64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in np.ascontiguousarray(pairs.T)], names=names)


def find_links(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of distinct ``fp`` within ``distance`` (4 at most) bits."""
    if distance > MAX_DISTANCE:
        raise ValueError(f"the keys find {MAX_DISTANCE} differing bits at most")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 2000):
                keys, owners = key_rows(values[at : at + 2000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(owners.view(np.int64))], names=["key", "fp"]
                )

    keys = map_arrow(prints.select("fp"), emit, "key long, fp long")
    dealt = keys.repartition(F.shiftright("key", 1)).sortWithinPartitions("key", "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for held in _whole_groups(batches, lambda key, fp: (key >> np.uint64(1), key & np.uint64(1), fp[:, None])):
            yield _link_batch([(*a, *b) for a, b in _link_sorted(*held, distance) if forest.join(a, b)], ["a", "b"])

    return map_arrow(dealt, link, "a long, b long")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, run, f"doc_id {kind}, fp long")


def _named_groups(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """``prints`` (with ``doc_id`` and ``node``) with ``component_id``, the smallest id of each component of nodes (``node, root``)."""
    distinct = stash(prints.groupBy("node").agg(F.min("doc_id").alias("first_id")), "nodes")
    named = distinct.join(roots, "node", "left")
    named = named.select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = named.select("node", "root").join(least, "root").select("node", "component_id")
    return prints.join(names, "node")


def simhash_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE
) -> DataFrame:
    """Per document row ``doc_id, fingerprint, component_id``.

    The component is that of all links of ``distance`` or fewer differing bits, named by its smallest id. Null
    and empty texts have fingerprint zero and are linked like any other; texts of fewer words than a shingle
    are one shingle; repeated rows each get their row; a component without any id has a null name; other
    columns are ignored; an empty table gives no rows.
    """
    prints = stash(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    links = find_links(stash(prints.select("fp").distinct(), "distinct-fingerprints"), distance)
    return _named_groups(prints.withColumnRenamed("fp", "node"), connected_components(links)).select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _votes(digests: bytes, weights: np.ndarray | None = None) -> np.ndarray:
    """The 16 bytes of a fingerprint: bits set in more than half (of the weight) of some 16-byte hashes."""
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 16)
    ones, step = np.zeros(128), 1 << 15
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at : at + step], axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[at : at + step] @ bits
    return np.packbits(2 * ones > (len(hashes) if weights is None else weights.sum()), bitorder="little")


def near_print(text: str | None, shingle: int = NEAR_SHINGLE, seed: int = SEED) -> bytes:
    """Two fingerprints of 16 bytes: that of a text's distinct shingles and that of its words, each weighted by the
    root of its count; zeros without words."""
    from xxhash import xxh3_128_digest

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return bytes(32)
    counts = Counter(words)
    first = _votes(b"".join(xxh3_128_digest(x, seed) for x in shingles(text, shingle)))
    second = _votes(b"".join(xxh3_128_digest(x, seed) for x in counts), np.sqrt(np.fromiter(counts.values(), float, len(counts))))
    return first.tobytes() + second.tobytes()


#: Segments of a word fingerprint as (word, first bit), 21 bits each.
NEAR_SEGMENTS = tuple((w, at) for w in (0, 1) for at in (0, 21, 42))


def near_codes(words: np.ndarray) -> np.ndarray:
    """Codeword indices near each segment of some word fingerprints (rows of two words): (rows, 6 segments, 6 codes), own first."""
    mask = np.uint64((1 << 21) - 1)
    return np.stack([fuzzy_keys((words[:, w] >> np.uint64(at) & mask).astype(np.int64), 21) for w, at in NEAR_SEGMENTS], axis=1)


def near_pairs(blocks: np.ndarray, prints: np.ndarray, words: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Candidates (rows) within blocks: texts of a block have the own codeword of one segment in common, and meet if the own
    codeword of another segment of one is near the other's; each is joined to its nearest of those it meets.

    Texts that have several codewords in common meet in the block of the first of them only.
    """
    codes = near_codes(words)
    own, segment = codes[:, :, 0], (blocks >> np.uint64(12)).astype(np.int64)
    for j in range(len(NEAR_SEGMENTS)):
        row, meets = _met(codes, blocks, j)
        found = []
        for members in _groups_with_neighbours(meets, prints[row], distance):
            members = row[members]
            if len(members) == 2:
                found.append(members[None, :])
                continue
            _, first = np.unique(prints[members], axis=0, return_index=True)
            links = nearest_links(prints[members[first]], distance)
            if links:
                found.append(members[first][np.array(links)])
        if found:
            pairs = np.concatenate(found)
            common = own[pairs[:, 0]] == own[pairs[:, 1]]
            yield from pairs[common.argmax(axis=1) == segment[pairs[:, 0]]].tolist()


def _met(codes: np.ndarray, blocks: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that meet in their blocks under a codeword of segment ``j``, in the order of what they meet under (the lowest bit set for
    rows that only probe)."""
    segment = (blocks >> np.uint64(12)).astype(np.int64)
    row, col = np.nonzero((codes[:, j] >= 0) & (segment != j)[:, None])
    meets = blocks[row].astype(np.int64) << 13 | codes[row, j, col] << 1 | (col > 0)
    order = np.argsort(meets, kind="stable")
    return row[order], meets[order]


def _meet(codes: np.ndarray, x: int, others: np.ndarray, segment: int) -> np.ndarray:
    """Which rows of a block (of a codeword of ``segment``) meet row ``x``: the own codeword of another segment of one is near the other's."""
    near = np.zeros(len(others), bool)
    for j in range(len(NEAR_SEGMENTS)):
        if j != segment:
            near |= (codes[others, j] == codes[x, j, 0]).any(axis=1) | (codes[others, j, 0][:, None] == codes[x, j]).any(axis=1)
    return near


def apart_links(segment: int, prints: np.ndarray, words: np.ndarray, roots: np.ndarray, starts: np.ndarray, held: np.ndarray, distance: int, similarity: float) -> list[tuple[int, int]]:
    """Links of the roots of a block's rows: every two rows of different groups that meet within ``distance`` bits are compared by their
    shingles (row i has ``held[starts[i]:starts[i + 1]]``, distinct), unless rows found similar before have made them one group.

    No pair is kept: a row is held against all rows after it, so memory grows with the rows alone.
    """
    codes, groups, sizes, links = near_codes(words), roots.copy(), np.diff(starts), []
    kinds, ids = np.unique(held, return_inverse=True)
    own = np.zeros(len(kinds), bool)
    for x in range(len(roots) - 1):
        others = x + 1 + np.flatnonzero(groups[x + 1 :] != groups[x])
        others = others[_differ(prints[others], prints[x]) <= distance]
        others = others[_meet(codes, x, others, segment)]
        if not len(others):
            continue
        own[ids[starts[x] : starts[x + 1]]] = True
        both = np.fromiter((np.count_nonzero(own[ids[starts[y] : starts[y + 1]]]) for y in others), np.int64, len(others))
        own[ids[starts[x] : starts[x + 1]]] = False
        for y in others[both / (sizes[x] + sizes[others] - both) >= similarity]:
            if groups[y] != groups[x]:
                links.append((int(roots[x]), int(roots[y])))
                groups[groups == groups[y]] = groups[x]
    return links


def _nearest_of_each(pairs: np.ndarray, most: int) -> np.ndarray:
    """Of pairs (two rows and their distance) those that are among the ``most`` nearest of one of their ends."""
    pairs = np.column_stack([np.sort(pairs[:, :2], axis=1), pairs[:, 2]])
    pairs = np.unique(pairs, axis=0)
    keep = np.zeros(len(pairs), bool)
    owner, other = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    order = np.lexsort((other, np.tile(pairs[:, 2], 2), owner))
    owner = owner[order]
    new = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)]
    rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
    keep[order[rank < most] % max(1, len(pairs))] = True
    return pairs[keep]


def _groups_with_neighbours(meets: np.ndarray, prints: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Of each group of rows (sorted by ``meets``, the lowest bit set for rows that only probe; groups of those alone are left
    out) the rows that have another within ``distance`` bits.

    All groups are gone through together, every row against the one some places on, so a group without neighbours (most
    of them) costs no step of its own.
    """
    starts = np.flatnonzero(np.concatenate([[True], meets[1:] >> 1 != meets[:-1] >> 1])) if len(meets) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(meets)]]))
    held = (meets[starts] & 1 == 0) & (sizes > 1)
    ends = np.repeat(np.where(held, starts + sizes, 0), sizes)
    at = np.flatnonzero(ends)
    first, second = np.ascontiguousarray(prints[:, 0]), np.ascontiguousarray(prints[:, 1])
    near, step = np.zeros(len(meets), bool), 1
    while len(at := at[at + step < ends[at]]):
        bits = np.bitwise_count(first[at] ^ first[at + step]) + np.bitwise_count(second[at] ^ second[at + step])
        hit = at[bits <= distance]
        near[hit] = near[hit + step] = True
        step += 1
    rows = np.flatnonzero(near)
    yield from np.split(rows, np.flatnonzero(meets[rows[1:]] >> 1 != meets[rows[:-1]] >> 1) + 1) if len(rows) else ()


def _block_keys(words: np.ndarray) -> np.ndarray:
    """The block of each segment of some word fingerprints: the segment and its own codeword."""
    return np.arange(len(NEAR_SEGMENTS)) << 12 | near_codes(words)[:, :, 0]


def near_links(prints: DataFrame, distance: int = NEAR_DISTANCE) -> DataFrame:
    """Candidates among the distinct ``print`` values, the shortest links that connect the rows of a key: ``a0, a1, b0, b1``, the two
    words of either shingle fingerprint (96 bits)."""
    low = np.uint64(0xFFFFFFFF)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 4)
            for at in range(0, len(both), 5000):
                part = both[at : at + 5000]
                keys = _block_keys(part[:, 2:]).astype(np.uint64) << np.uint64(32) | (part[:, 1] & low)[:, None]
                rows = np.repeat(part, len(NEAR_SEGMENTS), axis=0)
                columns = [keys.ravel(), rows[:, 0], rows[:, 2], rows[:, 3]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=names)

    def unpack(key: np.ndarray, rest: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, ...]:
        return key >> np.uint64(32), np.column_stack([rest, key & low]), np.column_stack([c0, c1])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks, own, words in _whole_groups(batches, unpack):
            pairs = near_pairs(blocks, own, words, distance)
            found = {(*min(x, y), *max(x, y)) for a, b in pairs if (x := _name(own[a])) != (y := _name(own[b]))}
            yield _link_batch(sorted(found), ["a0", "a1", "b0", "b1"])

    names = ["key", "rest", "c0", "c1"]
    keys = map_arrow(prints.select("print"), emit, ", ".join(f"{n} long" for n in names))
    dealt = keys.repartition(F.shiftright("key", 32)).sortWithinPartitions("key", "rest")
    return map_arrow(dealt, link, "a0 long, a1 long, b0 long, b1 long")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of sorted batches, one table for each value of the first column."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for start, end in itertools.pairwise(cuts):
            if kept and kept[0].column(0)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept = []
            kept.append(batch.slice(start, end - start))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def root_links(texts: DataFrame, shingle: int, similarity: float, distance: int = NEAR_DISTANCE) -> DataFrame:
    """Links ``a, b`` of the roots of texts (``print, root, text``): the components are those of all pairs of texts of different roots that
    share a key, are within ``distance`` bits and as similar as asked. Shingles are compared by their 64-bit hashes."""
    count = len(NEAR_SEGMENTS)
    # what a block needs of a text: first which texts have a partner there, then the shingles of those
    light = "block int, print binary, root long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 4)[:, 2:]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), count))
            blocks = pa.array(_block_keys(words).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([blocks, batch.column(0).take(rows), batch.column(1).take(rows)], names=["block", "print", "root"])

    def unpack(rows: pa.Table) -> tuple[np.ndarray, ...]:
        both = np.frombuffer(b"".join(rows.column("print").to_pylist()), np.uint64).reshape(-1, 4)
        own = np.column_stack([both[:, 0], both[:, 1] & np.uint64(0xFFFFFFFF)])
        return own, both[:, 2:], rows.column("root").to_numpy()

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tables(batches):
            prints, _, roots = unpack(rows)
            near = np.zeros(len(roots), bool)
            for x in range(len(roots) - 1):
                others = x + 1 + np.flatnonzero((roots[x + 1 :] != roots[x]) & (_differ(prints[x + 1 :], prints[x]) <= distance))
                near[others] = True
                near[x] |= len(others) > 0
            if near.any():
                yield rows.select(["block", "print"]).filter(pa.array(near)).combine_chunks().to_batches()[0]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tables(batches):
            held = rows.column("shingles").combine_chunks()
            starts = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
            found = apart_links(rows.column("block")[0].as_py() >> 12, *unpack(rows), starts, held.flatten().to_numpy(), distance, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    @F.pandas_udf("array<long>")
    def hashed(values: pd.Series) -> pd.Series:
        from xxhash import xxh3_64_intdigest

        return pd.Series([np.unique(np.fromiter((xxh3_64_intdigest(x, SEED) for x in shingles(t, shingle)), np.uint64)).view(np.int64) for t in values])

    dealt = map_arrow(texts.select("print", "root"), emit, light).repartition("block").sortWithinPartitions("block")
    marked = stash(map_arrow(dealt, partners, "block int, print binary"), "apart-prints")
    lists = texts.join(marked.select("print").distinct().hint("merge"), "print", "left_semi").select("print", "root", hashed("text").alias("shingles"))
    met = marked.join(stash(lists, "apart-shingles").hint("merge"), "print").select("block", "print", "root", "shingles")
    return map_arrow(met.repartition("block").sortWithinPartitions("block"), link, "a long, b long")


def shingles(text: str | None, size: int = NEAR_SHINGLE) -> set[bytes]:
    """Distinct word shingles of a text, A-Z in lower case; fewer words are one shingle, none are the empty one."""
    words = (text or "").encode("utf-8").lower().split()
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    k = min(size, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    return {line[a:b] for a, b in zip(starts, ends[k - 1 :], strict=True)} if words else {b""}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _node_texts(nodes: DataFrame, prints: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``node, text`` of some nodes; a node's texts are one text as a rule, and have one fingerprint anyway: the one of the least hash
    speaks for it."""
    least = prints.groupBy("node").agg(F.min("hash").alias("hash"))
    named = stash(least.join(nodes.hint("merge"), "node", "left_semi"), "near-nodes")
    hashed = docs.select(F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    hashed = hashed.where(maybe_among(named.select("hash"), F.col("hash"))).groupBy("hash").agg(F.first("text").alias("text"))
    texts = stash(named.join(hashed.hint("merge"), "hash").select("node", "text"), "near-texts")
    drop_stash(named)
    return texts


def _similar(pairs: DataFrame, prints: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs of nodes ``a, b`` whose texts (:func:`_node_texts`) are as similar as asked."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        near = (jaccard(shingles(s, shingle), shingles(t, shingle)) >= similarity for s, t in zip(x, y, strict=True))
        return pd.Series(list(near), dtype="bool")

    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "node")
    texts = _node_texts(ends, prints, docs, text_col)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
    links = stash(both.where(alike("x", "y")).select("a", "b"), "near-links")
    drop_stash(texts)
    return links


def near_copy_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = NEAR_SHINGLE,
    similarity: float = NEAR_SIMILARITY,
    distance: int = NEAR_DISTANCE,
) -> DataFrame:
    """Per document row ``doc_id, fingerprint, component_id``: groups of near copies.

    Texts whose word fingerprints share a key and whose shingle fingerprints are within ``distance`` of 96 bits are candidates; those are
    linked whose shingles have a Jaccard ``similarity`` as asked. First each text is tried with its nearest under every key, so that a group
    of many copies costs links in proportion to its texts. Where such a try fails, texts that hung together by it may be copies all
    the same: every two texts of the groups of such ends that share a key and are in different groups are compared, without a limit and
    without a table of pairs. A pair within ``distance`` bits that the first try leaves apart always lies between two such groups, so no
    candidate is left out. The keys are not exhaustive: of pairs right at 0.8 a few are missed (the README has the measured
    share). Nulls, empty texts, repeated rows, other columns and empty tables are as in :func:`simhash_groups`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [near_print(t, shingle) for t in batch.column(2).to_pylist()]
            words = np.frombuffer(b"".join(values), np.int64).reshape(-1, 4)
            low = words[:, 1] & np.int64(0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values, pa.binary()), pa.array(words[:, 0].copy()), pa.array(low)],
                names=["doc_id", "hash", "print", "w0", "w1"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    prints = stash(map_arrow(source, run, f"doc_id {kind}, hash long, print binary, w0 long, w1 long"), "near-prints")
    node = F.xxhash64("w0", "w1")
    distinct = stash(prints.select("print", node.alias("node")).distinct(), "distinct-prints")
    held = F.lower(F.hex(F.substring("print", 1, 12)))
    named = prints.select("doc_id", "hash", held.alias("fingerprint"), node.alias("node"))

    found = near_links(distinct, distance).select(F.xxhash64("a0", "a1").alias("a"), F.xxhash64("b0", "b1").alias("b"))
    tried = stash(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    links = _similar(tried, named, docs, text_col, shingle, similarity)
    roots, failed = stash(connected_components(links), "near-roots"), tried.join(links, ["a", "b"], "left_anti")
    root_of = lambda df, end: df.join(roots.withColumnRenamed("node", end), end, "left").select(F.coalesce("root", end).alias("root"))
    open_roots = root_of(failed, "a").unionByName(root_of(failed, "b")).distinct()
    rooted = distinct.join(roots, "node", "left").select("print", "node", F.coalesce("root", "node").alias("root"))
    again = stash(rooted.join(open_roots, "root", "left_semi"), "open-prints")
    texts = _node_texts(again.select("node").distinct(), named, docs, text_col)
    more = stash(root_links(again.join(texts.hint("merge"), "node"), shingle, similarity, distance), "root-links")
    for part in (again, texts):
        drop_stash(part)
    # groups grow together by links of their roots; texts that were alone are their own roots
    grown = stash(connected_components(more), "grown-roots")
    kept = roots.join(grown.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    alone = grown.join(roots.select("node"), "node", "left_anti")
    roots = stash(kept.unionByName(alone.select("node", "root")), "near-roots")
    return _named_groups(named, roots).select("doc_id", "fingerprint", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
