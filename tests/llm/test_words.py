"""Periodic runs, spelling variants and pieces against brute force and the library, on messy rows and on random texts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import rows
from quillon.llm import periodic_runs, piece_codec, spelling_variants


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def against_sql(df, sql, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


# 11 ----------------------------------------------------------------------------------------------------------------


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(6, 4 * q) and j > i and all(own[r:] != own[:-r] for r in range(1, q)):
                found.append((i, len(own), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(words):
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0])) if runs else (None,) * 3
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def plain_planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_runs_of_random_texts(letters):
    rnd = random.Random(letters)
    for _ in range(60):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            words = [str(rnd.randrange(letters)) for _ in range(rnd.randint(0, 130))]
            for _ in range(rnd.randint(0, 3) if len(words) > 20 else 0):
                a, p = rnd.randrange(len(words)), rnd.randint(1, 20)
                for i in range(a + p, min(len(words), a + rnd.randint(p, 6 * p + 12))):
                    words[i] = words[i - p]
            texts.append(words)
        assert periodic_runs.judge_texts(texts) == [plain_digest(t) for t in texts]


def test_wavelet_tree():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = rnd.permutation(n)
        low, high, bound = rnd.integers(0, n + 1, 300), rnd.integers(0, n + 1, 300), rnd.integers(-1, n + 2, 300)
        low, high = np.minimum(low, high), np.maximum(low, high)
        got = periodic_runs.WaveletTree(values).successor(low, high, bound)
        want = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(low, high, bound, strict=True)]
        assert got.tolist() == want


def test_a_long_periodic_text():
    one = periodic_runs.judge_texts([["a"] * 50_000, ["a", "b"] * 3 + ["c"], [str(i % 7) for i in range(60_000)]])
    assert [r[:4] for r in one] == [(1, 0, 50_000, 1), (0, None, None, None), (1, 0, 60_000, 7)]


def test_runs_of_messy_rows(docs, messy, empty):
    got = periodic_runs.periodic_runs(messy, plant=True).collect()
    held = [(r["doc_id"], r["text"] or "") for r in messy.select("doc_id", "text").collect()]
    assert len(got) == len(held)
    short = sorted(str((i, *plain_digest(plain_planted(re.findall(r"[^\x20\x09-\x0D]+", t), i)))) for i, t in held if len(t) < 9_000)
    assert sorted(str(tuple(r)) for r in got if r["doc_id"] != 7) == short
    assert periodic_runs.periodic_runs(empty).collect() == []
    assert [f.name for f in periodic_runs.periodic_runs(empty).schema][:2] == ["doc_id", "n_runs"]


def test_op11_equals_its_sql(spark, sf):
    against_sql(periodic_runs.op11_periodic_runs(spark, sf), periodic_runs.OP11_SQL, sf)


# 12 ----------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def made_words(rnd, letters):
    words = set()
    for _ in range(50):
        w = "".join(rnd.choice(letters) for _ in range(rnd.randint(6, 17)))
        words.add(w)
        for _ in range(3):
            i, c = rnd.randrange(len(w) + 1), rnd.choice(letters)
            words.add(rnd.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]]))
    return sorted(w for w in words if len(w) >= 6)


@pytest.mark.parametrize("letters", ["a", "ab", "abcé", "abcdefghijklmnopqrstuvwxyz"])
def test_near_words_share_a_key(letters):
    rnd = random.Random(len(letters))
    for floor in (0, 1, 4, 30):
        words = made_words(rnd, letters)
        counts = Counter(w[p : p + n] for w in words for p in range(len(w)) for n in range(2, 6) if p + n <= len(w))
        part = spelling_variants.Decomposer({g: n for g, n in counts.items() if n > floor})
        lists = {}
        for w in words:
            for c, gram, place, kind in spelling_variants._keys(w, part, 6, 6):
                lists.setdefault((c, gram, place), []).append((w, kind))
        met = {tuple(sorted((a, b))) for some in lists.values() for a, k in some if not k for b, j in some if j or a < b}
        assert {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)} <= met


@pytest.mark.parametrize("dictionary", [8, 1 << 16])
def test_variant_pairs(spark, dictionary):
    words = made_words(random.Random(5), "abcdé")
    df = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in spelling_variants.variant_pairs(df, dictionary=dictionary).collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def test_chains_and_ties(spark):
    counts = {"abcdefgh": 5, "abcdefg": 30, "abcdefgx": 30, "abcdef": 200, "xbcdef": 1000, "zzzzzz": 9}
    text = " ".join(" ".join([w] * n) for w, n in counts.items())
    df = spark.createDataFrame([(1, text), (None, "ABCDEFGHÀ abcdefghÀ " * 3)], "doc_id long, text string")
    got = {r["word"]: (r["n"], r["form"], r["form_n"], r["n_near"], r["root"]) for r in spelling_variants.spelling_variants(df, delete=10**9).collect()}
    assert got["abcdefgh"] == (5, "abcdefg", 30, 3, "xbcdef")  # a tie of 30 goes to the smaller word; abcdefghÀ is near too
    assert got["abcdefg"] == (30, "abcdef", 200, 3, "xbcdef")
    assert got["abcdefghÀ"] == (6, None, None, 1, "abcdefghÀ")
    assert got["xbcdef"] == (1000, None, None, 1, "xbcdef")
    assert got["zzzzzz"] == (9, None, None, 0, "zzzzzz")


def test_variants_of_messy_rows(messy, empty):
    got = {r["word"]: r["n"] for r in spelling_variants.spelling_variants(messy).collect()}
    assert got["evening"] == 5 and got["golden"] == 5 and all(len(w) >= 6 and n >= 5 for w, n in got.items())
    assert spelling_variants.spelling_variants(empty).collect() == []


def test_op12_equals_its_sql(spark, sf):
    against_sql(spelling_variants.op12_spelling_variants(spark, sf), spelling_variants.OP12_SQL, sf)


# 13 ----------------------------------------------------------------------------------------------------------------


def odd_texts():
    rnd = random.Random(2)
    pieces = [piece_codec.load(piece_codec.default_path()).library.id_to_piece(i).replace("▁", " ") for i in range(259, 32_000)]
    texts = ["", " ", "  ", "\n", "\n foo", "a" * 3000, "x" + " " * 33, "the" * 300, "漢字かな交じり文" * 50, "<s> </s> <unk> <0x41>", "▁▁ a▁b", "\t\r\n\x00z", "😀👍🏽é́"]
    texts += [f"{a}{' ' * n}{b}" for a in ("", "x") for b in ("", "foo", "漢", "é", "\n") for n in (14, 15, 16, 17, 31, 32, 33, 47, 48, 200)]
    for letters, n in (("abcdeinth \n▁é字.,0", 400), ("an ", 300), (["the", " ", "  ", "in", "g", "ing", "er", "▁t", "he", "a"], 400), (pieces, 400)):
        texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(n)]
    return texts


def test_pieces_equal_the_library():
    model, texts = piece_codec.load(piece_codec.default_path()), odd_texts()
    for encoded, text in zip(model.encode(texts), texts, strict=True):
        ids = np.frombuffer(encoded, "<u4").tolist()
        assert ids == model.library.encode(text, add_bos=True, add_eos=True), text
        assert model.decode(np.array(ids)) == model.library.decode(ids), text


def test_decoding_any_ids():
    model, rnd = piece_codec.load(piece_codec.default_path()), random.Random(4)
    for _ in range(300):
        ids = [rnd.choice([0, 1, 2, rnd.randrange(3, 259), rnd.randrange(32_000)]) for _ in range(rnd.randint(0, 8))]
        assert model.decode(np.array(ids, np.int64)) == model.library.decode(ids), ids


def test_a_small_table_of_words_gives_the_same(spark, docs):
    model = piece_codec.PieceModel(piece_codec.default_path(), memo_entries=50)
    texts = [r["text"] or "" for r in docs.limit(20).collect()]
    assert [model.encode([t])[0] for t in texts] == piece_codec.load(piece_codec.default_path()).encode(texts)


def test_pieces_of_messy_rows(docs, messy, empty):
    library = piece_codec.load(piece_codec.default_path()).library
    both = docs.unionByName(messy.select("doc_id", "text"))
    want = []
    for r in both.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append(str((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in piece_codec.encode_pieces(both).collect()) == sorted(want)
    assert piece_codec.encode_pieces(empty).collect() == []
    full = piece_codec.encode_pieces(messy, with_ids=True).where("doc_id = 5").first()
    assert full["decoded"] == "one" and full["n_tokens"] == len(full["ids"])


def test_op13_reads_its_whole_table(spark, sf, docs):
    got = piece_codec.op13_piece_codec(spark, sf)
    assert got.count() == docs.count() and got.where(F.col("n_tokens") < 2).isEmpty()
