"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Texts are cut into runs of letters and digits and runs of other signs; single tokens and pairs are hashed
into a fixed number of buckets. Two add-one smoothed multinomials over the buckets are counted, one over
the trusted texts (label ``quality`` 1) and one over the whole corpus; a text's score is the
mean of log(trusted / corpus) over its n-grams, so long and short texts are alike, and a text is kept if
the score reaches a fixed threshold. Every text is counted and every text is judged.

What leaves the executors is one row a bucket, whatever the size of the corpus; it comes back as a
constant inside the scoring expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import maybe_among, table

BUCKETS = 10_000
THRESHOLD = -0.15
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_TOKENS = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def buckets_of(text: Column, buckets: int) -> Column:
    """Buckets of all tokens and token pairs of a text, in order."""

    def hashed(t: Column) -> Column:
        pairs = F.when(F.size(t) > 1, F.sequence(F.lit(0), F.size(t) - 2)).otherwise(F.array().cast("array<int>"))
        return F.concat(
            F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")),
            F.transform(pairs, lambda i: F.pmod(F.xxhash64(F.get(t, i), F.get(t, i + 1)), F.lit(buckets)).cast("int")),
        )

    return let(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), hashed)


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window occurring twice or more.

    Windows are sorted as longs (44 bits of a hash over 20 bits of position) and equal neighbours are compared
    word by word; a text with a hash collision, or with more words than 20 bits can number, is done
    again with the windows themselves.
    """

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            at,
            start,
            lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + (p + 3 - F.greatest(p, s["end"]))).alias("n")),
            lambda s: s["n"],
        )

    def positions(w: Column) -> Column:
        return F.sequence(F.lit(0), F.size(w) - 3)

    def window_hash(w: Column, i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def slow(w: Column) -> Column:
        windows = F.sort_array(
            F.transform(
                positions(w),
                lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")),
            )
        )

        def found(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
            hit = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        return covered(let(windows, found))

    def fast(w: Column) -> Column:
        low = F.lit((1 << 20) - 1).cast("long")
        packed = F.sort_array(
            F.transform(positions(w), lambda i: F.shiftleft(window_hash(w, i), 20).bitwiseOR(i.cast("long")))
        )

        def hash_equal(x: Column, y: Column) -> Column:
            return F.coalesce(F.shiftright(x, 20) == F.shiftright(y, 20), F.lit(False))

        def differ(s: Column, x: Column, j: Column) -> Column:
            a, b = x.bitwiseAND(low).cast("int"), F.get(s, j + 1).bitwiseAND(low).cast("int")
            other = F.lit(False)
            for k in range(3):
                other = other | (F.get(w, a + k) != F.get(w, b + k))
            return hash_equal(x, F.get(s, j + 1)) & F.coalesce(other, F.lit(False))

        def count(s: Column) -> Column:
            hit = F.filter(s, lambda x, j: hash_equal(x, F.get(s, j - 1)) | hash_equal(x, F.get(s, j + 1)))

            def checked(h: Column) -> Column:
                collision = F.size(F.filter(h, lambda x, j: differ(h, x, j))) > 0
                at = F.sort_array(F.transform(h, lambda x: x.bitwiseAND(low).cast("int")))
                return F.when(F.size(h) == 0, F.lit(0).cast("long")).when(collision, slow(w)).otherwise(covered(at))

            return let(hit, checked)

        return let(packed, count)

    return let(
        words,
        lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).when(F.size(w) > (1 << 20), slow(w)).otherwise(fast(w)),
    )


def base_measures(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` appended."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    measured = docs.withColumns(
        {
            "_words": words,
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    ).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).drop("_words")


def _bucket_counts(grams: DataFrame, buckets: int) -> list[int]:
    """Occurrences of each bucket in a column of bucket lists, one added to each."""
    # the outer form, since for the inner one the optimizer computes the lists a second time in a filter
    counts = grams.select(F.explode_outer(grams.columns[0]).alias("bucket")).where("bucket IS NOT NULL")
    counts = counts.groupBy("bucket").count()
    total = [1] * buckets
    for row in counts.collect():  # at most one row a bucket
        total[row["bucket"]] += row["count"]
    return total


def log_ratio_table(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, buckets: int
) -> list[float]:
    """log(trusted / corpus) of each bucket, counted over all texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct()
    known = docs.where(maybe_among(trusted, F.col(id_col))).select(F.col(id_col).alias("id"), text.alias("text"))
    target = _bucket_counts(known.join(trusted.hint("merge"), "id").select(buckets_of(F.col("text"), buckets)), buckets)
    corpus = _bucket_counts(docs.select(buckets_of(text, buckets)), buckets)
    if sum(target) == buckets:  # nothing is trusted: no verdict beyond the rules
        return [0.0] * buckets
    shift = math.log(sum(corpus)) - math.log(sum(target))
    return [math.log(t) - math.log(c) + shift for t, c in zip(target, corpus, strict=True)]


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per document row ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score,
    kept``.

    Null and empty texts have no words and fail the rules; a text without n-grams has score 0; repeated
    rows each count and get their row; null labels and label rows without a document are ignored; other
    columns are ignored.
    """
    ratios = log_ratio_table(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, buckets=buckets)
    ratio = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one constant
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    measured = base_measures(source)
    total = let(
        buckets_of(F.col("text"), buckets),
        lambda b: F.aggregate(b, F.lit(0.0), lambda s, x: s + F.get(ratio, x)) / F.greatest(F.size(b), F.lit(1)),
    )
    return measured.withColumn("score", total).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "score",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
