"""Operators against brute force, on messy rows and on the smallest documents."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import rows
from quillon.llm import decontaminate, line_dedup, packing, quality, sharding, simhash, substring_dedup, token_counts
from quillon.llm.components import connected_components
from quillon.llm.tokenize import default_path, load

BLANK = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def both(docs, messy):
    return docs.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(messy.select("doc_id", "text"))


def held(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


# 1 -----------------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    from xxhash import xxh64_intdigest

    words = re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(both):
    texts = [(i, t) for i, t in held(both) if len(t) < 20_000]
    prints = np.array([plain_simhash(t) for _, t in texts], np.uint64)
    groups = Groups(len(texts))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if int(prints[a] ^ prints[b]).bit_count() <= 4:
            groups.join(a, b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[groups.find(k)] = min(i, least.get(groups.find(k), i))
    want = sorted((str(i), f"{int(p):016x}", str(least.get(groups.find(k)))) for k, ((i, _), p) in enumerate(zip(texts, prints, strict=True)))
    got = simhash.simhash_groups(both.where("text IS NULL OR length(text) < 20000")).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_golay_keys_meet_up_to_four_bits():
    rng = np.random.default_rng(7)
    for distance in range(5):
        a = rng.integers(0, 2**63, 400, dtype=np.uint64)
        b = a.copy()
        for i in range(len(a)):
            for bit in rng.choice(64, distance, replace=False):
                b[i] ^= np.uint64(1 << int(bit))
        for x, y in zip(a, b, strict=True):
            if x == y:
                continue
            keys, owners = simhash.key_rows(np.array([x, y], np.uint64))
            order = np.lexsort((owners, keys))
            assert list(simhash._link_sorted(keys[order] >> 1, keys[order] & 1, owners[order][:, None], 4))


def test_every_golay_word_is_near_one_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    own = simhash.fuzzy_keys(words, 23)
    assert (own[:, 0] >= 0).all() and ((own >= 0).sum(1) <= 6).all()
    _, errors = simhash._golay()
    fixed = words ^ errors[simhash._syndromes(words)]
    assert (simhash._syndromes(fixed) == 0).all()
    assert max(int(x).bit_count() for x in errors) == 3


def test_link_group_in_a_hot_key_spans_without_all_pairs():
    rng = np.random.default_rng(3)
    cluster = np.unique(np.array([(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (500, 2))], np.uint64))
    links = simhash.link_group(cluster[:, None])
    assert len(links) == len(cluster) - 1


def test_near_copies_of_five_words(spark):
    """Copies with some words changed, a chain of them, texts that share a passage only, repeats, nulls and empty texts."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    fresh = lambda n: [vocabulary[int(3000 * rng.random() ** 3)] for _ in range(n)]

    def variant(words, times):
        words = list(words)
        for i in rng.sample(range(len(words)), times):
            words[i] = rng.choice(vocabulary)
        return words

    texts = []
    for _ in range(60):
        base = fresh(rng.randint(60, 400))
        texts += [base, variant(base, max(1, len(base) // 60)), base + fresh(len(base) // 12), fresh(len(base)) + base[: len(base) // 2]]
    link = fresh(300)
    for _ in range(5):
        link = variant(link, 4)
        texts.append(link)
    texts = [" ".join(t) for t in texts] + ["", None, "", "two words", "Two  Words", "two other"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, node int")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copy_groups(df).collect()}
    sets = [simhash.shingles(t) for t in texts]
    whole, found, total = Groups(len(texts)), 0, 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            whole.join(i, j)
            found, total = found + (got[i] == got[j]), total + 1
    assert len(got) == len(texts) and total > 100
    assert found >= 0.95 * total  # some pairs right at 0.8 share no key
    assert all(whole.find(i) == whole.find(c) for i, c in got.items())  # nothing else is together
    assert len({got[i] for i, t in enumerate(texts) if not t}) == 1


def test_nearest_links_span_within_the_distance():
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 1 << 16, (200, 2), dtype=np.uint64), axis=0)
    links = simhash.nearest_links(prints, 7)
    have, want = Groups(len(prints)), Groups(len(prints))
    for a, b in links:
        assert sum((x ^ y).bit_count() for x, y in zip(prints[a].tolist(), prints[b].tolist(), strict=True)) <= 7
        have.join(a, b)
    for i, j in itertools.combinations(range(len(prints)), 2):
        if sum((x ^ y).bit_count() for x, y in zip(prints[i].tolist(), prints[j].tolist(), strict=True)) <= 7:
            want.join(i, j)
    pairs = list(itertools.combinations(range(len(prints)), 2))
    assert all((have.find(i) == have.find(j)) == (want.find(i) == want.find(j)) for i, j in pairs) and len(links) < len(prints)


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(500, x) for x in range(501, 560)]
    groups = Groups(600)
    for a, b in pairs:
        groups.join(a, b)
    members = {}
    for x in {x for p in pairs if p[0] != p[1] for x in p}:
        members.setdefault(groups.find(x), []).append(x)
    want = {x: min(m) for m in members.values() for x in m}
    got = connected_components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


# 2 -----------------------------------------------------------------------------------------------------------------


def plain_jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(both):
    texts = sorted(held(both), key=str)
    got = sorted(sharding.assign_shards(both).collect(), key=lambda r: str((r["doc_id"],)))
    for r in got:
        key = r["doc_id"] or 0
        assert (r["shard"], r["grown_shard"]) == (plain_jump(key, 24), plain_jump(key, 25))
        assert r["grown_shard"] in (r["shard"], 24)
    sizes = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    for shard in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


# 3 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kinds", [5000, 1])
def test_substrings(both, kinds):
    texts = [(i, t.encode()) for i, t in held(both)]
    n = 200
    seen = Counter(t[k : k + n] for _, t in texts for k in range(len(t) - n + 1))
    want = Counter()
    for i, t in texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = 1
        left = bytes(np.frombuffer(t, np.uint8)[gone[:-1] == 0])
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        want[i, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()] += 1
    cut = substring_dedup.remove_repeats(both, max_kinds=kinds)
    got = cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("k")).collect()
    assert Counter(map(tuple, got)) == want


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(8)]
    array = substring_dedup.SuffixArray(texts, 9)
    for size, places in array.maximal_repeats():
        found = {bytes(array.data[p : p + size]) for p in places}
        assert len(found) == 1
        s = found.pop()
        assert len(places) == sum(t[i : i + size] == s for t in texts for i in range(len(t)))


def three_variants():
    """Stretches of 336 bytes with one smallest gram: two share 300 bytes, the third 256 of them."""
    rng = random.Random(12)
    some = lambda n: bytes(rng.choice(b"abcdefghijklmnop") for _ in range(n))
    grams = [some(64) for _ in range(4000)]
    least = min(grams, key=lambda g: substring_dedup.gram_hashes(np.frombuffer(g, np.uint8), 64)[0])
    shared = some(136) + least + some(100)
    texts = [shared + some(36), shared[:256] + some(80), shared + some(36)]
    assert all(list(substring_dedup.stretches(t)[2]) == [137] for t in texts)
    return texts


def test_suffixes_are_ordered_over_whole_stretches():
    texts = three_variants()
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for order in itertools.permutations(texts):
        for t, ranges in zip(order, substring_dedup.SuffixArray(list(order), 200).covered(), strict=True):
            gone = {k + i for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for i in range(200)}
            assert {i for a, b in ranges for i in range(a, b)} == gone


def test_variants_are_cut_alike_by_array_and_count(spark):
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(three_variants())], "doc_id long, text string")
    for kinds in (5000, 1):
        got = substring_dedup.remove_repeats(df, max_kinds=kinds).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got} == {0: 300, 1: 256, 2: 300}


# 4 -----------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, line, times, letters="abcé"):
    line = list(line)
    for _ in range(times):
        i, kind = rng.randrange(len(line) + 1), rng.randrange(3)
        if kind == 0 or i >= len(line):
            line.insert(i, rng.choice(letters))
        elif kind == 1:
            line[i] = rng.choice(letters)
        else:
            del line[i]
    return "".join(line)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rng = random.Random(most)
    bases = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    pairs = [(a, changed(rng, a, rng.randint(0, 5))) for a in bases]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), most).alias("w")).collect()
    assert all(r["w"] == (edits(r["a"], r["b"]) <= most) for r in got)


def test_line_links_are_complete(spark):
    rng = random.Random(9)
    lines = set()
    for _ in range(120):
        base = "".join(rng.choice("abcdé ") for _ in range(rng.randint(9, 40)))
        lines |= {base, *(changed(rng, base, rng.randint(1, 3)) for _ in range(2))}
    lines = sorted(x for x in lines if len(x) >= 8)
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = line_dedup.linked_lines(line_dedup.with_sketch(df), 2).collect()
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(lines), 2) if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    assert {(r["a"], r["b"]) for r in got} == want


def test_lines_are_linked_without_counting_all_their_letters(spark):
    """Only ``id`` and ``line`` are asked for; letters of any script are told apart and count as one each."""
    rng = random.Random(12)
    lines = set()
    for _ in range(60):
        base = "".join(rng.choice("abжя字\U0001f600 ") for _ in range(rng.randint(8, 30)))
        lines |= {base, *(changed(rng, base, rng.randint(1, 3)) for _ in range(2))}
    lines = sorted(x for x in lines if len(x) >= 8)
    df = spark.createDataFrame([*enumerate(lines), (len(lines), None)], "id long, line string")
    got = [(r["a"], r["b"]) for r in line_dedup.linked_lines(df, 2).collect()]
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(lines), 2) if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    assert set(got) == want and len(got) == len(want) > 60


def test_keys_of_a_line_are_compiled(spark):
    """Rows of keys come from a join with the places, not from an array of keys that is exploded."""
    text = "ten letterж and three 😀 more"
    wide = spark.createDataFrame([(5, text)], "id long, line string").select("id", line_dedup.wide_letters(F.col("line")).alias("wide"))
    probing, indexed = [line_dedup.keyed(wide, places(2), 2) for places in (line_dedup.probe_places, line_dedup.index_places)]
    assert "Generate" not in probing._jdf.queryExecution().executedPlan().toString()
    keys, own = [[r["key"] for r in df.collect()] for df in (probing, indexed)]
    assert len(set(keys)) == len(keys) == 12 and len(own) == 3 and set(own) <= set(keys)
    shorter = spark.createDataFrame([(6, text[1:])], "id long, line string").select("id", line_dedup.wide_letters(F.col("line")).alias("wide"))
    assert set(keys) & {r["key"] for r in line_dedup.keyed(shorter, line_dedup.index_places(2), 2).collect()}


@pytest.mark.parametrize("first", [1, 3])
def test_crowded_keys_link_the_same_components(spark, monkeypatch, first):
    """More lines under a key than the first round compares: the components stay those of all pairs, with few links."""
    monkeypatch.setattr(line_dedup, "FIRST_OF_KEY", first)
    rng = random.Random(first)
    base = "every one of these lines has a number at its end, which is "
    lines = {f"{base}{rng.randrange(10_000):04d}" for _ in range(250)}
    lines |= {f"{rng.randrange(1000):03d} heads a line that ends like all the others do" for _ in range(60)}
    other = "a chain of letters, two edits from one to the next: "
    lines |= {other + "x" * (2 * i) + "y" * (40 - 2 * i) for i in range(20)}
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = [(r["a"], r["b"]) for r in line_dedup.linked_lines(line_dedup.with_sketch(df), 2).collect()]
    assert all(edits(lines[a], lines[b]) <= 2 for a, b in got)
    want, have, pairs = Groups(len(lines)), Groups(len(lines)), 0
    for i, j in itertools.combinations(range(len(lines)), 2):
        if abs(len(lines[i]) - len(lines[j])) <= 2 and edits(lines[i], lines[j]) <= 2:
            want.join(i, j)
            pairs += 1
    for a, b in got:
        have.join(a, b)
    least = lambda g: [min(k for k in range(len(lines)) if g.find(k) == g.find(i)) for i in range(len(lines))]
    assert least(have) == least(want)
    assert len(set(got)) < pairs


def test_marks_of_a_line_never_rule_out_two_edits(spark):
    rng = random.Random(21)
    bases = ["".join(rng.choice("abcdжé ") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    pairs = [(a, changed(rng, a, rng.randint(0, 2))) for a in bases] + [("", ""), ("a", ""), ("ab", "b")]
    marks = lambda c: line_dedup.two_marks(line_dedup.wide_letters(F.col(c)))
    df = spark.createDataFrame(pairs, "a string, b string").select(marks("a").alias("x"), marks("b").alias("y"))
    got = df.select(line_dedup.twos_allow(F.col("x"), F.col("y"), 2).alias("may")).collect()
    assert len(got) == len(pairs) and all(r["may"] for r in got)


def test_lines_that_share_no_more_than_a_key_make_no_pairs(spark, monkeypatch):
    """A large group of different lines with a third in common: those within two edits are linked, the others never paired."""
    made, stash = {}, line_dedup.stash

    def counted(df, label):
        out = stash(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "stash", counted)
    rng = random.Random(8)
    letters = [rng.sample("abcdefghijklmnoprstuvw", 6) for _ in range(6)]
    words = [["".join(rng.sample(x, 6)) for _ in range(5)] for x in letters]  # at each place the same letters in another order
    head = "every one of these lines begins with the same words, for more than a third of it, "
    lines = {head + " ".join(map(rng.choice, words)) for _ in range(80)}
    lines |= {f"{x[:-1]}!" for x in sorted(lines)[:15]}
    lines = sorted(lines)
    got = {(r["a"], r["b"]) for r in line_dedup.linked_lines(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), 2).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(lines), 2) if edits(a[len(head):], b[len(head):]) <= 2}
    assert len(want) >= 15 and got == want
    assert sum(made.get(x, 0) for x in ("near-pairs", "crowded-first", "crowded-pairs")) < len(lines)


def test_lines_of_messy_rows(spark, messy):
    line = "All rights to this page are reserved by the press."
    rows_ = [(100 + i, f"{'abcdefgh'[i] * 9} own words of one document only\n{line}{'!' * (i % 2)}\nshort", "en", "s", 1, 0.1, "r") for i in range(8)]
    df = messy.unionByName(spark.createDataFrame(rows_, messy.schema))
    out = line_dedup.dedup_lines(df, max_copies=6)
    assert out.columns == [*df.columns, "n_lines_removed"] and out.count() == df.count()
    got = {r["doc_id"]: r for r in out.where("doc_id >= 100").collect()}
    assert line in got[100]["text"] and got[100]["n_lines_removed"] == 0
    assert all(got[100 + i]["text"] == f"{'abcdefgh'[i] * 9} own words of one document only\nshort" for i in range(1, 8))
    same = {(r["doc_id"], r["text"], r["removed"]) for r in out.where("doc_id < 100 OR doc_id IS NULL").collect()}
    assert same == {(r["doc_id"], r["text"], r["removed"]) for r in messy.collect()}


def test_query_keeps_one_of_every_repeated_line(spark, tmp_path):
    long = "A passage that stands as one line in two documents only, and nowhere else."
    rows_ = [
        (1, f"first own line of a document, long enough\n{long}\nAnd ornd.\n\nAnd ornx."),
        (2, f"{long[:-1]}!\n\nAnd ornd.\nsecond own line of a document, so far unseen"),
        (3, "And ornd.\n \nAnd ornd.\n \nno"),
    ]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in line_dedup.op4_line_dedup(spark, str(tmp_path)).collect()}
    want = {1: rows_[0][1], 2: "\nsecond own line of a document, so far unseen", 3: " \n \nno"}
    assert {i: r["kept_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert {i: r["n_lines_removed"] for i, r in got.items()} == {1: 0, 2: 2, 3: 2}


def test_lines_of_rows_without_an_id(spark):
    line = "All rights to this page are reserved by the press."
    rows_ = [(None, f"{c * 40}\n{line}") for c in "abcdef"] + [(7, f"{'g' * 40}\n{line}")]
    with_one = line_dedup.dedup_lines(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in with_one if line in r["text"]] == [7]
    without = line_dedup.dedup_lines(spark.createDataFrame(rows_[:-1], "doc_id long, text string")).collect()
    assert len(without) == 6 and sum(line in r["text"] for r in without) == 1


# 5, 8 --------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(both):
    tok = load(default_path()).library
    want = Counter()
    for i, t in held(both):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want[i, tuple(ids)] += 1
    pieces = packing.pack_documents(both, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        assert at == 2048 or at & (at - 1) == 0  # nothing is padded
    for (i, ids), n in want.items():
        if n == 1 and sum(k[0] == i for k in want) == 1:
            parts = sorted(by_doc[i, len(ids)])
            assert [p[0] for p in parts] == list(itertools.accumulate([0, *(len(p[1]) for p in parts[:-1])]))
            assert tuple(x for p in parts for x in p[1]) == ids
    assert sum(r["length"] for r in pieces) == sum(len(ids) * n for (_, ids), n in want.items())


def test_sum_of_squares_choice():
    rng = random.Random(5)
    packer = packing.SumOfSquaresPacker(16)
    for k in range(300):
        size, n = rng.randint(1, 15), packer.levels.copy()
        packer.add(k, np.arange(size))
        costs = {}
        for level in range(16 - size + 1):
            if level and not n[level]:
                continue
            after = n.copy()
            if level:
                after[level] -= 1
            if level + size < 16:
                after[level + size] += 1
            costs[level] = (int((after[1:16] ** 2).sum()), -level)
        best = min(costs, key=costs.get)
        want = n.copy()
        if best:
            want[best] -= 1
        if best + size < 16:
            want[best + size] += 1
        assert (packer.levels == want).all()


def test_open_windows_stay_bounded():
    packer = packing.SumOfSquaresPacker(64, max_open=8)
    for k in range(500):
        packer.add(k, np.arange(33 + k % 3))
        assert packer.n_open <= 9
    packer.finish()
    assert sum(len(p.ids) for s in packer.done for p in s) == sum(33 + k % 3 for k in range(500))


def test_token_counts(both):
    tok = load(default_path()).library
    want = Counter((i, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in held(both))
    assert Counter(map(tuple, token_counts.token_counts(both).collect())) == want


def test_tokens_of_odd_strings():
    tok = load(default_path())
    rng = random.Random(1)
    odd = [chr(c) for c in range(0x250)] + list("‐  €　中😀̀٠ ​﻿�")
    for k in range(3000):
        pool = odd if k % 2 else list(" \t\n\r\x0b\x0c\x1c\x85\xa0ab1'sé.") + ["<|endoftext|>"]
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        ids = tok.library.encode(s, add_special_tokens=False).ids
        assert tok.ids(s) == ids
        assert token_counts.count_batch([s], default_path(), memo_entries=50) == [len(ids)]


# 6 -----------------------------------------------------------------------------------------------------------------


def plain_base(text):
    words = re.findall(BLANK, text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_quality(spark, sf, both):
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(1000, 1150)] + [(None, 1), (5, None), (99_999, 1)], "doc_id long, quality int")
    got = quality.judge_quality(both, labels).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[f] for f in fields)) for r in got) == Counter((i, *plain_base(t)) for i, t in held(both))
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD) for r in got)
    # the ratio by hand
    tokens = lambda t: re.findall(r"[\w]+|[^\w\s]+", t)
    grams = lambda t: [(x,) for x in tokens(t)] + list(zip(tokens(t), tokens(t)[1:], strict=False))
    names = sorted({g for _, t in held(both) for g in grams(t) if t.isascii()})
    one = spark.createDataFrame([(" ".join(g),) for g in names], "t string").select("t", quality.buckets_of(F.col("t"), 10_000).alias("b")).collect()
    bucket = {tuple(r["t"].split(" ")): r["b"][-1] if " " in r["t"] else r["b"][0] for r in one}
    if all(t.isascii() for _, t in held(both)):
        pytest.fail("the fixture should have other letters")
    ratios = quality.log_ratio_table(both, labels, id_col="doc_id", text_col="text", label_col="quality", buckets=10_000)
    scores = {(r["doc_id"], r["n_words"]): r["score"] for r in got}
    for i, t in held(both):
        if t.isascii() and tokens(t):
            mean = sum(ratios[bucket[g]] for g in grams(t)) / len(grams(t))
            assert abs(scores[i, len(re.findall(BLANK, t))] - mean) < 1e-9


def test_nothing_trusted_keeps_what_passes_the_rules(messy, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.judge_quality(messy, none).collect()} == {0.0}


# 7 -----------------------------------------------------------------------------------------------------------------


def bench_rows(spark):
    passage = "Every evening the harbour lights were lit one after another until the whole bay seemed to float"
    rows_ = [(1, passage), (2, passage.upper()), (3, "lazy dog"), (4, None), (5, "..."), (6, ""), (10, "漢字"), (11, "zzz")]
    return spark.createDataFrame([(*r, "x") for r in rows_], "item_id long, text string, items string")


def contaminated_by_hand(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = Counter()
    for i, t in docs:
        words, hit, ids = split(t), set(), set()
        for item, text in items:
            own = split(text)
            n = min(13, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(words) - n + 1 if windows else 0):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out[i, len(words), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(words)] += 1
    return out


@pytest.mark.parametrize("block", [1 << 24, 2])
def test_contamination(spark, messy, block):
    bench = bench_rows(spark)
    found = decontaminate.find_contamination(messy, bench, max_patterns=block)
    got = decontaminate.contamination_digest(found).collect()
    want = contaminated_by_hand(held(messy), [(r["item_id"], r["text"]) for r in bench.collect()])
    assert Counter(map(tuple, got)) == want
    for r in found.where("size(spans) > 0").collect():
        text = next(t for i, t in held(messy) if i == r["doc_id"])
        for s, w in zip(r["spans"], r["ranges"], strict=True):
            assert len(decontaminate.normal_words(text[s["start"] : s["end"]])) == w["hi"] - w["lo"]


def test_texts_of_a_batch_are_strings_in_slices(monkeypatch):
    """A batch of documents stays in Arrow; ``SLICE`` of its texts at most become Python strings at once."""
    monkeypatch.setattr(decontaminate, "SLICE", 4)
    sizes = []

    class Texts:
        def __init__(self, texts):
            self.texts = texts

        def __len__(self):
            return len(self.texts)

        def slice(self, start, length):
            return Texts(self.texts[start : start + length])

        def to_pylist(self):
            sizes.append(len(self.texts))
            return self.texts

    texts = [None, "", *map(str, range(9))]
    assert list(decontaminate._sliced(Texts(texts))) == texts and sizes == [4, 4, 3]


def test_remove_contaminated(spark, messy):
    bench = bench_rows(spark)
    bad = {r["doc_id"] for r in decontaminate.contamination_digest(decontaminate.find_contamination(messy, bench)).where("contaminated").collect()}
    assert bad and None not in bad
    left = decontaminate.remove_contaminated(messy, bench)
    assert left.columns == messy.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, _ in held(messy) if i not in bad)


@pytest.mark.parametrize("block", [1 << 24, 2])
def test_rows_are_removed_by_their_text(spark, block):
    item = "seven small ships sailed past the old stone pier at dawn with grain"
    other = "a second item of the benchmark that only serves to make another block of it here"
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    rows_ = [(5, item), (5, "clean words"), (None, item), (None, "clean too"), (None, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    left = decontaminate.remove_contaminated(df, bench, max_patterns=block).collect()
    assert Counter(map(tuple, left)) == Counter([rows_[1], rows_[3], rows_[4]])


@pytest.mark.parametrize("name", ["op2_shard", "op7_decontaminate"])
def test_same_as_sql(spark, sf, name):
    from quillon import llm

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = llm.queries()[name](spark, sf)
    res = con.execute(llm.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in res.description], res.fetchall())


def made_copies(groups, seed):
    """Texts in groups of variants with some words changed."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice(["ba", "ke", "ri", "to", "mu", "sha", "len"]) for _ in range(rnd.randint(1, 4))) for _ in range(3000)]
    out = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 300))]
        for _ in range(6):
            share = rnd.choice([0.005, 0.01, 0.02, 0.03])
            out.append(" ".join(rnd.choice(vocabulary) if rnd.random() < share else w for w in base))
    return out


def test_no_pair_is_lost_between_candidates_and_links(spark):
    """Groups are the components of all similar pairs that meet under a key, however links of other texts fail."""
    texts = made_copies(40, 11)
    prints = np.frombuffer(b"".join(simhash.near_print(t) for t in texts), np.uint64).reshape(-1, 4)
    short = np.column_stack([prints[:, 0], prints[:, 1] & np.uint64(0xFFFFFFFF)])
    codes, sets = simhash.near_codes(prints[:, 2:]), [simhash.shingles(t) for t in texts]

    def meet(a, b):
        for i in range(len(simhash.NEAR_SEGMENTS)):
            if codes[a, i, 0] == codes[b, i, 0] and any(j != i and (codes[a, j, 0] in codes[b, j] or codes[b, j, 0] in codes[a, j]) for j in range(codes.shape[1])):
                return int(np.bitwise_count(short[a] ^ short[b]).sum()) <= simhash.NEAR_DISTANCE
        return False

    groups = Groups(len(texts))
    near = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if a // 6 == b // 6 and meet(a, b):
            near += 1
            if simhash.jaccard(sets[a], sets[b]) >= 0.8:
                groups.join(a, b)
    least = {}
    for i in range(len(texts)):
        least.setdefault(groups.find(i), i)
    got = simhash.near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: least[groups.find(i)] for i in range(len(texts))}
    assert near > 300


def test_nearest_of_each_end():
    pairs = np.array([(0, 1, 5), (1, 0, 5), (0, 2, 3), (0, 3, 4), (4, 3, 9), (5, 0, 1)])
    kept = simhash._nearest_of_each(pairs, 1)
    assert sorted(map(tuple, kept[:, :2])) == [(0, 1), (0, 2), (0, 3), (0, 5), (3, 4)]  # each is the nearest of one of its ends
    many = np.array([(0, k, k) for k in range(1, 9)] + [(k, 20, 1) for k in range(1, 9)])
    assert sorted(map(tuple, simhash._nearest_of_each(many, 2)[:, :2])) == sorted([(0, k) for k in range(1, 9)] + [(k, 20) for k in range(1, 9)])
    assert sorted(map(tuple, simhash._nearest_of_each(many, 1)[:, :2])) == sorted([(0, 1)] + [(k, 20) for k in range(1, 9)])


def test_similar_texts_behind_nearer_others_are_linked(spark):
    """Two texts, each with five nearer fingerprints of other texts around it: the nearest four of each never made them meet."""
    def made(bits):
        short = sum(1 << b for b in bits)
        return np.array([short & (1 << 64) - 1, short >> 64, 12345, 67], np.uint64).tobytes()

    far = list(range(40, 60))
    words = [f"w{i}" for i in range(80)]
    texts = [(made([]), -1, " ".join(words)), (made(far), 2, " ".join([*words[:79], "other"]))]
    texts += [(made([i]), 10 + i, f"near the first {i}") for i in range(5)]
    texts += [(made([*far, 60 + i]), 20 + i, f"near the second {i}") for i in range(5)]
    texts += [(made([*range(70, 93)]), 30, " ".join(words))]  # 23 bits away from the first: no candidate
    df = spark.createDataFrame(texts, "print binary, root long, text string")
    found = simhash.root_links(df, simhash.NEAR_SHINGLE, simhash.NEAR_SIMILARITY).collect()
    assert {tuple(sorted((r["a"], r["b"]))) for r in found} == {(-1, 2)}
    assert simhash.root_links(df.limit(0), 5, 0.8).count() == 0
