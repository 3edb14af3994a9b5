"""Models: held-out accuracy and odd rows; empty tables for all; the pipeline against its rules."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import decontaminate, language_id, line_dedup, packing, quality, sharding, simhash, substring_dedup, token_counts, toxicity
from quillon.llm.tokenize import default_path, load
from test_contracts import contaminated_by_hand, edits

BIG = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels).cache()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored.collect())
    assert scored.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0
    right = scored.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right >= 0.85
    assert scored.count() == docs.count()


def test_toxicity_ignores_held_out_labels_and_odd_rows(spark, messy):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text").limit(300)
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    both = docs.unionByName(messy.select((F.col("doc_id") - 100_000).alias("doc_id"), "text"))
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(both, labels).collect()}
    two = {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(both, flipped).collect()}
    assert one == two


def test_toxicity_without_labels(spark, messy):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity.score_toxicity(messy, none).collect()} == {(0.0, 0)}


class PlainModels:
    """Kneser-Ney over letter strings: after four letters, then two, then one, written out with dictionaries."""

    def __init__(self, rows, left_out=None):
        self.counts, self.after = {}, {}
        every = {}
        for text, toxic, fold in rows:
            s = "\0" * 4 + plain_letters(text)
            for i in range(4, len(s)):
                every.setdefault((s[i - 4 : i], s[i]), [0, 0])[toxic] += fold != left_out
        self.n_letters = len({x for _, x in every})
        self.pairs = {}
        for context, letter in every:
            self.pairs.setdefault(context[-1], {}).setdefault(letter, set()).add(context)
        for (context, letter), c in every.items():
            for k in (0, 1):
                if c[k]:
                    self.counts.setdefault((k, context), {})[letter] = c[k]
                    own = self.after.setdefault((k, context[-2:]), {})
                    own[letter] = own.get(letter, 0) + 1

    def p(self, k, context, letter):
        after = self.pairs.get(context[-1], {})
        found = (len(after.get(letter, ())) + 0.5) / (sum(map(len, after.values())) + 0.5 * self.n_letters)
        for c in (self.after.get((k, context[-2:])), self.counts.get((k, context))):
            if c:
                found = max(c.get(letter, 0) - 0.75, 0) / sum(c.values()) + 0.75 * len(c) / sum(c.values()) * found
        return found

    def ratios(self, text):
        s = "\0" * 4 + plain_letters(text)
        return np.array([np.log(self.p(1, s[i - 4 : i], s[i]) / self.p(0, s[i - 4 : i], s[i])) for i in range(4, len(s))])

    def features(self, text):
        s, r = plain_letters(text), self.ratios(text)
        if not s:
            return [0.0] * 6
        words, at = [], 0
        for part in re.findall("[^\0]*\0|[^\0]+$", s):
            words.append(r[at : at + len(part)].sum())
            at += len(part)
        words.sort()
        return [r.mean(), words[-1], sum(words[-3:]) / 3, np.mean(words[-10:]), words[9 * len(words) // 10], np.log1p(len(words))]


def plain_letters(text):
    """Lower-case letters with one end sign after every word, without leading ones."""
    out, last = [], "\0"
    for c in text or "":
        x = c.lower()[0] if c.isalpha() else "\0"
        if x != "\0" or last != "\0":
            out.append(x)
        last = x
    if (text or "") and not text[0].isalpha():
        out.insert(0, "\0")
    return "".join(out)


@pytest.fixture(scope="module")
def lettered():
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnop éøжщ漢字あ")
    draw = lambda n: " ".join("".join(rng.choice(letters, n)).split())
    return [(draw(1500), k % 2, 1 + k % 4) for k in range(16)]


def test_plain_probabilities_sum_to_one(lettered):
    model = PlainModels(lettered)
    letters = {x for after in model.pairs.values() for x in after}
    for context in [c for _, c in list(model.counts)[:20]] + ["zzzz"]:
        for k in (0, 1):
            assert abs(sum(model.p(k, context, x) for x in letters) - 1) < 1e-9


def test_ratios_by_exact_letters(spark, lettered):
    counts = toxicity.class_counts(spark.createDataFrame(lettered, "text string, toxic int, fold int")).cache()
    table = toxicity.ratio_table(counts).cache()
    for block_rows in (10**9, table.count() // 7 + 1):
        blocks = toxicity.ratio_blocks(table, block_rows)
        for column, left_out in ((-1, None), (0, 1), (3, 4)):
            model = PlainModels(lettered, left_out)
            for text in (lettered[0][0][:300], "щ!漢 zz " + lettered[1][0][:50], ""):
                got = toxicity.letter_ratios(*toxicity.letter_keys(text), blocks, column)
                want = model.ratios(text)
                assert np.allclose(got, want, atol=2e-2, rtol=2e-3), (block_rows, left_out)  # ratios are kept in 16 bits
                assert np.allclose(toxicity.all_features([text], blocks, column)[0], model.features(text), atol=5e-2)


def test_scores_equal_plain_ones(spark, lettered):
    rng = np.random.default_rng(8)
    plain = ["river", "house", "garden", "table", "letter", "window", "morning", "paper"]
    rows = [(i, " ".join([*rng.choice(plain, 12), *["grumbag"] * (i % 3 == 0)]), int(i % 3 == 0)) for i in range(200)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [(t, y, fold(i)) for i, t, y in rows if fold(i)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    models = {k: PlainModels(known, k) for k in (1, 2, 3, 4)}
    mean, scale, w = toxicity.fit_logistic(np.array([models[k].features(t) for t, _, k in known]), np.array([y for _, y, _ in known]))
    model = PlainModels(known)
    for i, t, _ in rows:
        z = ((np.array(model.features(t)) - mean) / scale) @ w[:-1] + w[-1]
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 0.02, i


def test_toxic_wording_of_every_fold_is_learnt(spark, monkeypatch):
    tables, make = [], toxicity.ratio_blocks
    monkeypatch.setattr(toxicity, "ratio_blocks", lambda t: tables.append(t) or make(t))
    rng = np.random.default_rng(5)
    plain = ["river", "house", "garden", "table", "letter", "window", "morning", "paper"]
    rows = []
    for i in range(300):
        bad, last = i % 3 == 0, zlib.crc32(str(i).encode()) % 5 == 4
        own = ["grumbag", *(["zzyqx"] * last)] if bad else []
        rows.append((i, " ".join([*rng.choice(plain, 14 - len(own)), *own]), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    score = toxicity.train_scorer(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    common = " ".join(rng.choice(plain, 13))
    probe = spark.createDataFrame([(f"{common} zzyqx",), (f"{common} kkjwv",)], "text string")
    known, unknown = (r[0] for r in probe.select(score(F.col("text"))).collect())
    assert known > unknown
    high, low = (int(k[-1]) for k in toxicity.letter_keys(" zzyqx"))  # x after zzyq
    assert tables[-1].where((F.col("high") == high) & (F.col("low") == low)).count() == 1


def test_language_held_out_and_odd_rows(spark, messy):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    found = language_id.identify_language(docs).cache()
    assert found.where("score < 0 OR score > 1").count() == 0
    right = found.where("held_out").join(docs, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_language(messy).collect()}
    assert odd[3] == odd[4] == odd[6] == "und" and odd[7] == "en"
    none = language_id.identify_language(messy.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_bundles_are_sums_of_bound_rotated_letters():
    e = language_id.Encoder(64)
    grams = language_id.trigrams("Ab c")
    vector = e.bundles([grams], [0], 1)[0]
    want = np.zeros(64)
    for g in grams.tolist():
        a, b, c = (e.letter(g >> s & 0x1FFFFF).astype(int) for s in (42, 21, 0))
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.array_equal(vector, want) and len(grams) == 4


def test_long_texts_are_bundled_in_steps(monkeypatch):
    """A text of many steps and many distinct trigrams gives the same bundle as all its trigrams together."""
    rng = np.random.default_rng(8)
    text = "".join(chr(c) for c in rng.integers(0x4E00, 0x4E40, 5_000)) + " short words 12 after it"
    e = language_id.Encoder(64)
    want = e.bundles([language_id.trigrams(text)], [0], 1)
    monkeypatch.setattr(language_id, "STEP_CHARS", 700)
    monkeypatch.setattr(language_id, "CODE_STEP", 50)
    monkeypatch.setattr(language_id, "MEMO_VECTORS", 300)
    small = language_id.Encoder(64)
    assert np.array_equal(small.texts([None, text, ""], [0, 1, 1], 2), np.vstack([np.zeros((1, 64)), want]))
    assert len(small.vectors) <= 1024


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        simhash.simhash_groups(empty),
        simhash.near_copy_groups(empty),
        sharding.assign_shards(empty),
        substring_dedup.remove_repeats(empty),
        line_dedup.dedup_lines(empty),
        packing.pack_documents(empty),
        quality.judge_quality(empty, labels),
        decontaminate.find_contamination(empty, bench),
        decontaminate.remove_contaminated(empty, bench),
        token_counts.token_counts(empty),
        toxicity.score_toxicity(empty, labels),
        language_id.identify_language(empty),
    ):
        assert out.collect() == []


def test_packing_of_string_ids_in_empty_partitions(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string").repartition(3)
    assert [r["doc_id"] for r in packing.pack_documents(df).collect()] and packing.pack_documents(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != "packing":
            docs = docs.cache()
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").dtypes
    for _, _, after in stages[:-1]:
        assert after.dtypes == columns


def test_each_stage_by_its_rule(stages, spark, sf):
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    by = {name: (before, after) for name, before, after in stages}
    before, after = by["toxicity"]
    assert ids(after) == ids(toxicity.score_toxicity(before, labels).where("predicted = 0"))
    before, after = by["line_dedup"]
    assert ids(after) == ids(before)
    before, after = by["simhash"]
    assert ids(after) == ids(simhash.near_copy_groups(before).where("doc_id = component_id"))
    before, after = by["decontamination"]
    found = decontaminate.contamination_digest(decontaminate.find_contamination(before, bench))
    assert ids(after) == ids(found.where("NOT contaminated"))
    before, after = by["packing"]
    assert sorted({r["doc_id"] for r in after.collect()}) == ids(before)


def test_run(spark, sf, stages):
    """Windows depend on how the rows are dealt out; documents and tokens do not."""
    tokens = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()))
    assert tokens(corpus_pipeline.run(spark, sf)) == tokens(stages[-1][2])


def _plain_line_classes(lines):
    """Class of each distinct line by comparing all pairs of lines of 32 characters and more."""
    up = {x: x for x in lines}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    long = sorted((x for x in lines if len(x) >= line_dedup.MIN_CHARS), key=len)
    bags = [Counter(x) for x in long]
    for j, b in enumerate(long):
        for i in range(j - 1, -1, -1):
            if len(b) - len(long[i]) > 2:
                break
            if sum(((bags[i] - bags[j]) + (bags[j] - bags[i])).values()) <= 4 and edits(long[i], b) <= 2:
                up[find(b)] = find(long[i])
    return {x: find(x) for x in lines}


def test_pipeline_against_a_plain_version(spark, sf, stages):
    """Lines, near copies and benchmark passages by comparing everything with everything; what the toxicity models reject is
    taken from their scores, which cannot be had plainly."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).where("score >= 0.5").collect()}
    left = {r["doc_id"]: r["text"] for r in docs.orderBy("doc_id").collect() if r["doc_id"] not in bad}
    seen = [(i, n, x) for i, t in sorted(left.items()) for n, x in enumerate((t or "").split("\n")) if x and not x.isspace()]
    classes = _plain_line_classes({x for _, _, x in seen})
    first = {}
    for i, n, x in seen:
        first.setdefault(classes[x], (i, n))
    gone = {(i, n) for i, n, x in seen if first[classes[x]] != (i, n)}
    left = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in left.items()}
    by = {name: after for name, _, after in stages}
    assert {r["doc_id"]: r["text"] for r in by["line_dedup"].collect()} == left
    sets, group = {i: simhash.shingles(t) for i, t in left.items()}, {i: i for i in left}
    for j in sorted(left):
        near = {group[i] for i in left if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} | {group[j]}
        group = {i: min(near) if g in near else g for i, g in group.items()}
    left = {i: t for i, t in left.items() if group[i] == i}
    assert {r["doc_id"] for r in by["simhash"].collect()} == set(left)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {row[0] for row in contaminated_by_hand(list(left.items()), items) if not row[-1]}
    left = {i: t for i, t in left.items() if i in clean}
    assert {r["doc_id"] for r in by["decontamination"].collect()} == set(left)
    tok = load(default_path()).library
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got = Counter()
    for r in by["packing"].collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_near_copies_with_repeated_and_null_ids(spark, sf):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("lake", "hill", "wood"))
    rows = [(1, one), (1, two), (1, two), (2, two), (3, one), (None, one), (None, three), (None, three), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.near_copies_out(spark, df, sf).collect()]
    assert sorted(left, key=str) == sorted([(1, one), (1, two), (None, three), (None, None)], key=str)
