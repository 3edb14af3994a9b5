"""Spelling variants of words: a variable-length gram index with affected-gram bounds.

Gram dictionary. From every place of a word a gram grows, from two characters on, while what it holds so far is frequent among the
words, up to a longest length. What must be known for that is the set of frequent grams; "frequent" is a share of all places
(one in ``DICTIONARY`` and more), so the set has at most ``DICTIONARY`` grams of each length, whatever the number of words.

Decomposition. A word becomes its grams with their places, without those that lie inside an earlier one. An edit changes only
grams near it: those it touches, those before it that could grow through it, those behind it that a gram grown through it could
swallow. The most that any edit of a word can change is its bound ``b``; two words one edit apart then share every gram but ``b``
of either, so they share one of the ``b + 1`` rarest of both (all grams equal to the last of these are taken too).

Lists. Only those rarest grams (infrequent ones first, then by how frequent they are) are indexed, with their place. Words of
length c meet those of lengths c and c + 1 in class c, and grams of class c are at most c / 2 long, so that every word keeps a gram
whatever the edit: the first one if the edit is at c / 2 or later, otherwise the last one. Words that meet are verified by their
edit distance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow, stash, table

LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, TIMES, DELETE = 6, 5, 5, 199
SHORTEST, LONGEST = 2, 6
#: A gram is frequent if it stands in more than one of so many places.
DICTIONARY = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, delete: int = DELETE
) -> DataFrame:
    """``word, n`` of the lower-cased letter runs of all texts; where ``delete`` divides the hash of id and run, a letter is left out."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(LETTERS), F.lit(0))).alias("run"))
    lower = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.coalesce(F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("run"))), F.lit(1))
    marked = lower.select("run", h.alias("h")).withColumn("at", F.pmod("h", F.length("run").cast("long")).cast("int"))
    cut = F.concat(F.substring(F.col("run"), F.lit(1), F.col("at")), F.substring(F.col("run"), F.col("at") + 2, F.length("run")))
    word = F.when(F.col("h") % delete == 0, cut).otherwise(F.col("run"))
    long = marked.select(word.alias("word")).where(F.length("word") >= min_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def frequent_grams(words: DataFrame, *, longest: int = LONGEST, dictionary: int = DICTIONARY) -> dict[str, int]:
    """The grams of 2 to ``longest`` - 1 characters that stand in more than one in ``dictionary`` of all places (so fewer than
    ``dictionary`` of each length), and their counts."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    lengths = F.sequence(F.lit(SHORTEST), F.lit(longest - 1))
    end = F.length("word") + 1
    starts = F.transform(
        F.sequence(F.lit(1), F.length("word") - 1),
        lambda p: F.transform(lengths, lambda n: F.when(p + n <= end, F.substring(F.col("word"), p, n))),
    )
    grams = words.select(F.explode(F.flatten(starts)).alias("gram")).where("gram IS NOT NULL")
    counted = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > total / dictionary)
    return {r["gram"]: r["n"] for r in counted.collect()}


class Decomposer:
    """Grams of words under one dictionary, and how many of them an edit can change."""

    def __init__(self, frequent: dict[str, int]):
        self.frequent = frequent
        self.tails = {g[i:] for g in frequent for i in range(1, len(g))}

    def grams(self, word: str, longest: int) -> list[tuple[int, int]]:
        """Start and end (not included) of each gram of the word, from left to right."""
        found, reached, size = [], 0, len(word)
        for p in range(size - SHORTEST + 1):
            end = p + SHORTEST
            while end < size and end - p < longest and word[p:end] in self.frequent:
                end += 1
            if end > reached:
                found.append((p, end))
                reached = end
        return found

    def bound(self, word: str, grams: list[tuple[int, int]], longest: int) -> int:
        """The most grams that one inserted, deleted or replaced character can change."""
        most, size = 0, len(word)
        for at in range(size + 1):
            # grams that end by ``at`` and could reach through it, because they or an earlier one could grow so far
            grows = size + 1
            for s in range(max(0, at - longest + 1), at):
                if at - s < SHORTEST or word[s:at] in self.frequent:
                    grows = s
                    break
            for gap in (True, False):  # an insertion before ``at``, or the character at ``at`` itself
                if not gap and at == size:
                    continue
                behind, changed = (at if gap else at + 1), 0
                for s, e in grams:
                    if e <= at:
                        changed += s >= grows
                    elif s < behind:
                        changed += 1
                    # behind the edit: swallowed by a gram that holds something before it, and ends no earlier
                    elif e - behind + 1 <= longest and word[behind : e - 1] in self.tails:
                        changed += 1
                    else:
                        break
                most = max(most, changed)
        return most


_decomposers: dict[str, Decomposer] = {}


def _decomposer(name: str, held) -> Decomposer:
    """The decomposer of a broadcast dictionary, made once a worker."""
    if name not in _decomposers:
        _decomposers.clear()
        _decomposers[name] = Decomposer(held.value)
    return _decomposers[name]


def _longest(length: int, longest: int) -> int:
    """Longest gram of the class of words of ``length`` and ``length`` + 1 characters."""
    return min(longest, length // 2)


def _keys(word: str, part: Decomposer, longest: int, min_length: int) -> Iterator[tuple[int, str, int, int]]:
    """Class, gram, place and kind of every key of a word: kind 0 asks and is found (same length), kind 1 is found by shorter words."""
    size = len(word)
    for kind in (0, 1):
        c = size - kind
        if c < min_length:
            continue
        most = _longest(c, longest)
        grams = part.grams(word, most)
        texts = sorted((part.frequent.get(word[s:e], 0), word[s:e], s) for s, e in grams)
        taken = part.bound(word, grams, most) + 1
        last = texts[min(taken, len(texts)) - 1][:2]
        for n, g, s in texts:
            if (n, g) > last:
                break
            yield c, g, s, kind
            if kind:
                yield c, g, s - 1, kind


def variant_pairs(words: DataFrame, *, min_length: int = MIN_LENGTH, longest: int = LONGEST, dictionary: int = DICTIONARY) -> DataFrame:
    """Pairs ``a, b`` of different words exactly one inserted, deleted or replaced character apart, each pair once.

    ``words`` has distinct words in column ``word``, of at least ``min_length`` (2 ``SHORTEST`` or more) characters, and their
    counts ``n``, which come along as ``n_a`` and ``n_b``.
    """
    if min_length < 2 * SHORTEST:
        raise ValueError(f"words of fewer than {2 * SHORTEST} characters keep no gram through every edit")
    spark = words.sparkSession
    held, name = spark.sparkContext.broadcast(frequent_grams(words, longest=longest, dictionary=dictionary)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _decomposer(name, held)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                rows = [
                    (w, n, *key)
                    for w, n in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)
                    for key in _keys(w, part, longest, min_length)
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = ["word", "n", "class", "gram", "place", "kind"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    keys = map_arrow(words.select("word", "n"), run, "word string, n long, class int, gram string, place int, kind int")
    keys = stash(keys, "gram-keys")
    asks = keys.where("kind = 0").select("class", "gram", "place", F.col("word").alias("a"), F.col("n").alias("n_a"))
    found = keys.select("class", "gram", "place", "kind", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = asks.join(found, ["class", "gram", "place"]).where((F.col("kind") == 1) | (F.col("a") < F.col("b")))
    near = met.where(F.levenshtein("a", "b", 1) == 1)
    return near.select("a", "n_a", "b", "n_b").distinct()


def near_words(words: DataFrame, *, times: int = TIMES, **how) -> DataFrame:
    """Per word ``word, n, form, form_n, n_near``: its most frequent near word (ties: the smallest) if that is ``times`` as frequent."""
    pairs = variant_pairs(words, **how)
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (``word, form``, ..) with ``root``, the last word that forms lead to.

    Every step leads to a word at least ``TIMES`` as frequent, so chains are short (27 steps at most among 64-bit counts); in each
    round a word takes over where its target has got to, which doubles the steps, until nothing moves.
    """
    known = stash(forms, "forms")
    links = stash(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "form-links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stash(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "form-links")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return known.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", delete: int = DELETE) -> DataFrame:
    """Per distinct word of 6 characters and 5 occurrences or more: ``word, n, form, form_n, n_near, root``.

    Null and empty texts have no words; in rows without an id no letter is left out; repeated rows count as often as they stand;
    very long texts are split into words where they are read. Of near words equal in count the smallest in code-point order is the
    form. Other columns are ignored; an empty table gives no rows.
    """
    words = stash(word_counts(docs, id_col=id_col, text_col=text_col, delete=delete), "words")
    return with_roots(near_words(words)).select("word", "n", "form", "form_n", "n_near", "root")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), run AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents
), lower_run AS (
  SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x, count(*) AS n FROM run GROUP BY ALL
), hashed AS (
  SELECT x, n, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(doc_id || ':' || x)), '..'),
      lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1),
      lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS h
  FROM lower_run, tab
), word AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(x, 1, h % length(x)) || substr(x, h % length(x) + 2) ELSE x END AS word, sum(n) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), cut AS (
  SELECT word, n, unnest(list_distinct([word] || list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS k
  FROM word
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS u, b.n AS m FROM cut a JOIN cut b ON a.k = b.k AND a.word <> b.word
    AND CASE WHEN length(a.word) = length(b.word) THEN len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1
      ELSE a.k IN (a.word, b.word) END
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS n, max(m) AS m FROM near GROUP BY word
), form AS (
  SELECT b.word, b.n_near, min(near.u) AS u, b.m FROM best b JOIN near ON near.word = b.word AND near.m = b.m
  WHERE b.m >= 5 * b.n GROUP BY b.word, b.n_near, b.m
), walk AS (
  SELECT word, u AS root FROM form
  UNION ALL
  SELECT w.word, f.u FROM walk w JOIN form f ON f.word = w.root
), last AS (
  SELECT word, root FROM walk WHERE root NOT IN (SELECT word FROM form)
)
SELECT w.word, CAST(w.n AS BIGINT) AS n, f.u AS form, CAST(f.m AS BIGINT) AS form_n, coalesce(b.n_near, 0) AS n_near, coalesce(l.root, w.word) AS root
FROM word w LEFT JOIN best b USING (word) LEFT JOIN form f ON f.word = w.word LEFT JOIN last l ON l.word = w.word
"""
