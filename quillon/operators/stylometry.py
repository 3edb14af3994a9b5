"""Stylometric features, most frequent words, Burrows' Delta and rolling votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import rolling_window, tokens


#: References that a target is compared with at a time.
BLOCK = 500


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def six_digits(value: Column) -> Column:
    """A measure of at least 0 in six digits as the SQL rounds it: its millionfold to the nearest whole number, so that a share of
    41/640, whose millionfold is just under 64062.5 as a double, is 0.064062 (``F.round`` goes by the decimal and gives 0.064063)."""
    return F.round(value * F.lit(1e6)) / F.lit(1e6)


def occurrences(words: Column | str, word: str) -> Column:
    """How often a word stands in an array column."""
    return F.size(F.filter(words, lambda x: x == word))


def feature_places(words: Column, features: list[str]) -> Column:
    """Of every word that is a feature its place in the list (from 1), in one pass over the words."""
    listed = F.array(*map(F.lit, features)).cast("array<string>")
    return F.filter(F.transform(words, lambda w: F.array_position(listed, w)), lambda p: p > 0)


def feature_shares(words: Column, features: list[str]) -> Column:
    """Share of each feature among the words (of at least one), in one pass over them: words become places in the list, and only
    those that are features are counted."""
    places = feature_places(words, features)
    share = lambda hits, i: F.size(F.filter(hits, lambda p: p == i)) / F.greatest(F.size(words), F.lit(1))
    counts = lambda hits: F.array(*[share(hits, i) for i in range(1, len(features) + 1)])
    return let(places, counts)


def scalar_fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Tokens, types, hapax rate, type-token ratio and mean word length per row; zeros for texts without words."""
    return word_scalars(docs.select(id_col, tokens(F.col(text_col)).alias("w")), "w").drop("w")


def word_scalars(rows: DataFrame, words: str) -> DataFrame:
    """The columns of :func:`scalar_fingerprint` beside those of ``rows``, which have an array of words.

    Each row is measured where it is read: its words are sorted in place, and a hapax differs from both neighbours.
    """
    kept = rows.columns
    row = rows.select(*kept, F.sort_array(words).alias("_sorted"))
    other = lambda a, b: F.coalesce(a != b, F.lit(True))
    hapax = let(
        F.col("_sorted"),
        lambda w: F.size(F.filter(w, lambda x, i: other(x, F.get(w, i - 1)) & other(x, F.get(w, i + 1)))),
    )
    letters = F.aggregate("_sorted", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    sizes = row.select(
        *kept,
        F.size("_sorted").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("_sorted")).cast("long").alias("n_types"),
        hapax.alias("_hapax"),
        letters.alias("_letters"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, six_digits(F.col(a) / F.col(b))).otherwise(F.lit(0.0))
    return sizes.select(
        *kept,
        "n_tokens",
        "n_types",
        ratio("_hapax", "n_types").alias("hapax_rate"),
        ratio("n_types", "n_tokens").alias("ttr"),
        ratio("_letters", "n_tokens").alias("mean_word_len"),
    )


def type_token_ratio(words: Column) -> Column:
    return let(words, lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0)))


def page_ttr_variance(pages: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """Population variance of the pages' type-token ratios per document; 0 below two pages."""
    per = pages.select(doc_col, type_token_ratio(tokens(F.col(text_col))).alias("ttr")).groupBy(doc_col)
    variance = F.when(F.count("*") > 1, six_digits(F.var_pop("ttr"))).otherwise(F.lit(0.0))
    return per.agg(F.count("*").alias("n_pages"), variance.alias("ttr_variance"))


def gram_count(line: str, gram: str) -> Column:
    """How often an n-gram stands in a line; occurrences may overlap. Those that cannot are counted by what is left without them."""
    if any(gram.startswith(gram[i:]) for i in range(1, len(gram))):
        return F.regexp_count(line, F.lit(f"(?={gram})"))
    rest = F.octet_length(F.replace(F.col(line), F.lit(gram), F.lit("")))
    return ((F.octet_length(line) - rest) / F.lit(len(gram.encode()))).cast("int")


def gram_profile(docs: DataFrame, id_col: str, text_col: str, grams: list[str]) -> DataFrame:
    """Share of each n-gram of a fixed list among all occurrences of the list, within words; zeros are kept."""
    line = F.concat(F.lit(" "), F.array_join(tokens(F.col(text_col)), " "))
    counts = F.array(*[F.struct(F.lit(g).alias("gram"), gram_count("line", g).alias("n")) for g in grams])
    rows = docs.select(id_col, line.alias("line")).select(id_col, counts.alias("counts"))
    total = F.aggregate("counts", F.lit(0), lambda s, c: s + c["n"])
    rows = rows.select(id_col, "counts", total.alias("total")).select(id_col, "total", F.explode_outer("counts").alias("c"))
    share = F.when(F.col("total") > 0, six_digits(F.col("c.n") / F.col("total"))).otherwise(F.lit(0.0))
    return rows.select(id_col, "c.gram", share.alias("share"))


def word_profile(docs: DataFrame, id_col: str, text_col: str, words: list[str]) -> DataFrame:
    """Per listed word: share among listed words (their sum at least 1) and rate among all words; zeros are kept."""
    row = docs.select(id_col, tokens(F.col(text_col)).alias("w"))
    counts = F.transform(
        F.array(*map(F.lit, words)), lambda v: F.struct(v.alias("word"), F.size(F.filter("w", lambda x: x == v)).alias("n"))
    )
    row = row.select(id_col, F.size("w").alias("size"), counts.alias("counts"))
    total = F.aggregate("counts", F.lit(0), lambda s, c: s + c["n"])
    row = row.withColumn("total", total).select(id_col, "size", "total", F.explode_outer("counts").alias("c"))
    return row.select(
        id_col,
        "c.word",
        six_digits(F.col("c.n") / F.greatest("total", F.lit(1))).alias("share"),
        six_digits(F.col("c.n") / F.greatest("size", F.lit(1))).alias("rate"),
        F.when(F.col("size") > 0, six_digits(1 - F.col("total") / F.col("size"))).otherwise(F.lit(0.0)).alias("density"),
    )


def _growth(points: int):
    """Sums of a least-squares fit to the logs of vocabulary growth, from the sorted places at which words are first seen."""

    def sums(firsts: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(n), 5))
        for row, (seen, size) in enumerate(zip(firsts, n, strict=True)):
            if size >= 20:
                at = np.append(np.arange(0, size, max(1, size // points)), size - 1)
                x, y = np.log(at + 1), np.log(np.searchsorted(seen, at, side="right"))
                dx, dy = x - x.mean(), y - y.mean()
                out[row] = x.mean(), y.mean(), dx @ dx, dx @ dy, dy @ dy
        return pd.DataFrame(out, columns=["x", "y", "xx", "xy", "yy"])

    return F.pandas_udf(sums, "x double, y double, xx double, xy double, yy double")


def heaps_fit(docs: DataFrame, id_col: str, text_col: str, points: int = 500) -> DataFrame:
    """Vocabulary growth V(n) = k n^beta by least squares on logs; (1, 0.5, 0) below 20 words.

    The growth curve is sampled every ``n // points`` words; the last point enters once more. The places at which words are first seen
    are one sorted array a row; only these leave the JVM, where the curve counts them, and nothing is shuffled.
    """
    return word_growth(docs.select(id_col, tokens(F.col(text_col)).alias("w")), "w", points).drop("w")


def word_growth(rows: DataFrame, words: str, points: int = 500) -> DataFrame:
    """The columns of :func:`heaps_fit` beside those of ``rows``, which have an array of words."""
    kept = rows.columns
    row = rows.select(*kept, F.size(words).alias("_n"), let(F.col(words), lambda w: F.sort_array(F.transform(_runs(w), lambda r: r["first"]))).alias("_firsts"))
    fitted = row.select(*kept, "_n", _growth(points)("_firsts", "_n").alias("_f"))
    short, beta = F.col("_n") < 20, F.col("_f.xy") / F.nullif(F.col("_f.xx"), F.lit(0.0))
    return fitted.select(
        *kept,
        F.when(short, F.lit(1.0)).otherwise(F.round(F.exp(F.col("_f.y") - beta * F.col("_f.x")), 4)).alias("k"),
        F.when(short, F.lit(0.5)).otherwise(F.round(beta, 4)).alias("beta"),
        F.when(short | (F.col("_f.yy") <= 0), F.lit(0.0)).otherwise(F.round(F.col("_f.xy") * F.col("_f.xy") / (F.col("_f.xx") * F.col("_f.yy")), 4)).alias("r2"),
    )


def most_frequent_words(docs: DataFrame, text_col: str, limit: int, excluded: list[str], shortest: int = 3) -> DataFrame:
    """The ``limit`` most frequent words of a corpus without the excluded ones; ties in letter order."""
    words = docs.select(F.explode_outer(tokens(F.col(text_col))).alias("word"))
    words = words.where((F.length("word") >= shortest) & ~F.col("word").isin(excluded))
    return words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(limit)


def _runs(words: Column) -> Column:
    """``word, n, first`` of the distinct words of an array, by one sort (the native one; ``array_sort`` asks a lambda for every
    comparison): equal words stand together."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def counted(p: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i)["w"] != F.get(p, i - 1)["w"]))

        def run(b: Column) -> Column:
            end = lambda k: F.coalesce(F.get(b, k + 1), F.size(p))
            return F.transform(b, lambda i, k: F.struct(F.get(p, i)["w"].alias("word"), (end(k) - i).alias("n"), F.get(p, i)["i"].alias("first")))

        return let(begins, run)

    return F.when(F.size(words) > 0, let(placed, counted))


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, word, n``: how often each word stands in a document; counted where the text is read."""
    rows = docs.select(id_col, tokens(F.col(text_col)).alias("w")).select(id_col, F.explode(_runs(F.col("w"))).alias("r"))
    return rows.select(id_col, "r.word", F.col("r.n").cast("long").alias("n"))


def ranked_words(words: Column, most: int) -> Column:
    """The most frequent words of an array as structs of ``n`` (negative), ``first`` and ``word``, best first; null without words."""
    keyed = lambda r: F.struct((-r["n"]).alias("n"), r["first"].alias("first"), r["word"].alias("word"))
    return F.slice(F.sort_array(F.transform(_runs(words), keyed)), 1, most)


def top_words(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """``id, place, word, n``: the most frequent words of each document, the one seen first winning ties."""
    rows = docs.select(id_col, tokens(F.col(text_col)).alias("w")).select(id_col, F.posexplode(ranked_words(F.col("w"), most)).alias("place", "r"))
    return rows.select(id_col, (F.col("place") + 1).cast("long").alias("place"), "r.word", (-F.col("r.n")).cast("long").alias("n"))


def relative_frequencies(docs: DataFrame, keys: list[str], text_col: str, features: list[str]) -> DataFrame:
    """``keys, feature, freq``: occurrences of each feature over all words (at least 1), zeros kept."""
    row = docs.select(*keys, let(tokens(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("size"), feature_places(w, features).alias("hits"))).alias("f"))
    row = row.select(*keys, "f.size", F.col("f.hits").alias("hits"))
    count = lambda i: F.size(F.filter("hits", lambda p: p == i + 1)).cast("long").alias(f"c{i}")
    counts = [count(i) for i in range(len(features))]
    sums = row.select(*keys, "size", *counts).groupBy(*keys)
    sums = sums.agg(F.sum("size").alias("size"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(features))])
    pairs = F.explode_outer(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("n")) for i, f in enumerate(features)]))
    rows = sums.select(*keys, "size", pairs.alias("p"))
    return rows.select(*keys, "p.feature", (F.col("p.n") / F.greatest("size", F.lit(1))).alias("freq"))


def delta_ranking(targets: DataFrame, references: DataFrame, target_col: str) -> DataFrame:
    """Burrows' Delta of targets (``target_col, feature, freq``) to references (``label, ref, feature, freq``).

    Frequencies are z-scored by the references' mean and population deviation (0 counts as 1e-6); the distance is the
    mean absolute difference, averaged per label; labels are ranked by distance, then name. Every target and reference is one
    array of scores; references come in blocks of ``BLOCK``, so a task holds one block, and no row is made for a feature of a pair.
    """
    stats = references.groupBy("feature").agg(F.avg("freq").alias("mean"), F.stddev_pop("freq").alias("std"))
    stats = stats.withColumn("std", F.when(F.col("std") == 0, 1e-6).otherwise(F.col("std")))

    def scores(df: DataFrame, keys: list[str]) -> DataFrame:
        scored = df.join(F.broadcast(stats), "feature")  # one row a feature
        part = F.struct("feature", ((F.col("freq") - F.col("mean")) / F.col("std")).alias("z"))
        return scored.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["z"]).alias("z"))

    right = scores(references, ["label", "ref"])
    blocks = max(1, -(-right.count() // BLOCK))
    held = right.select(F.pmod(F.xxhash64("label", "ref"), F.lit(blocks)).alias("_block"), F.struct("label", "ref", "z").alias("r")).groupBy("_block").agg(F.collect_list("r").alias("rs"))
    left = scores(targets, [target_col]).select(target_col, "z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))
    gap = lambda r: F.aggregate(F.zip_with("z", r["z"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / F.size("z")
    found = left.join(held, "_block").select(target_col, F.explode(F.transform("rs", lambda r: F.struct(r["label"].alias("label"), r["ref"].alias("ref"), F.round(gap(r), 9).alias("d")))).alias("e"))
    each = found.select(target_col, "e.*")
    per = each.groupBy(target_col, "label").agg(
        F.round(F.avg("d"), 6).alias("distance"), F.min(F.struct("d", "ref"))["ref"].alias("nearest")
    )
    rank = F.row_number().over(Window.partitionBy(target_col).orderBy("distance", "label")).cast("long")
    return per.withColumn("rank", rank)


def rolling_slices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, slice_no, words``: overlapping windows; a first short window (under max(80, size / 2)) ends the text, unless it
    is the first of all; texts under 120 words have none."""

    def cut(w: Column) -> Column:
        def of(r: Column) -> Column:
            length = lambda s: F.least(r["size"], F.size(w) - s)
            kept = F.filter(F.sequence(F.lit(0), F.size(w) - 1, r["step"]), lambda s, i: (i == 0) | (length(s) >= F.greatest(F.lit(80.0), r["size"] / 2)))
            return F.when(r["size"].isNotNull(), F.transform(kept, lambda s, i: F.struct(i.cast("long").alias("slice_no"), F.slice(w, s + 1, r["size"]).alias("words"))))

        return let(rolling_window(F.size(w)), of)

    # windows are cut before rows are made of them: a row would else carry all words of its text
    found = docs.select(id_col, F.inline_outer(let(tokens(F.col(text_col)), cut)))
    return found.where(F.col("slice_no").isNotNull())


def rolling_vote(slices: DataFrame, id_col: str, references: DataFrame, features: list[str]) -> DataFrame:
    """Each slice votes for the label of smallest Delta (then name): ``id, label, votes``.

    ``references``: ``label, feature, freq``, labels x features rows; they are collected and become constants, so
    every slice is judged where its text is, and only votes are shuffled.
    """
    rows = references.collect()
    labels = sorted({r["label"] for r in rows})
    freq = {(r["label"], r["feature"]): r["freq"] for r in rows}
    means = {f: sum(freq[x, f] for x in labels) / len(labels) for f in features}
    stds = {f: (sum((freq[x, f] - means[f]) ** 2 for x in labels) / len(labels)) ** 0.5 or 1e-6 for f in features}
    shared = slices.select(id_col, feature_shares(F.col("words"), features).alias("s"))

    def distance(label: str) -> Column:
        gaps = [
            F.abs((F.col("s")[i] - means[f]) / stds[f] - (freq[label, f] - means[f]) / stds[f]) for i, f in enumerate(features)
        ]
        return F.round(sum(gaps[1:], gaps[0]) / len(features), 6)

    best = F.array_min(F.array(*[F.struct(distance(x).alias("d"), F.lit(x).alias("label")) for x in labels]))
    votes = shared.select(id_col, best["label"].alias("label"))
    return votes.groupBy(id_col, "label").agg(F.count("*").alias("votes"))
