"""Stylometry over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import stylometry as S
from quillon.plans.registry import query, table

#: Our own lists for the synthetic corpus: frequent letter pairs and triples, and function words.
BIGRAMS = ["th", "he", "er", "en", "on", "an", "re", "ti", "es", "de", "le", "qu", "la", "os", "in", "ch", "un", "nd", "st", "ou"]
TRIGRAMS = ["the", "ent", "ion", "que", "ing", "and", "der", "ein", "ich", "sch", "les", "des", "est", "cio", "par"]
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "de", "la", "le", "les", "des", "que", "der", "die", "und", "en", "el", "los", "un", "is", "for"]

TOK = "regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[a-z]{2,}')"


def listing(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""
WITH t AS (SELECT doc_id, {TOK} AS w FROM documents),
c AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM t) GROUP BY doc_id, x),
s AS (SELECT doc_id, sum(n) AS n_tokens, count(*) AS n_types, count(*) FILTER (n = 1) AS hapax, sum(n * length(x)) AS letters FROM c GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, coalesce(n_types, 0) AS n_types,
  coalesce(round(hapax / n_types, 6), 0.0) AS hapax_rate, coalesce(round(n_types / n_tokens, 6), 0.0) AS ttr,
  coalesce(round(letters / n_tokens, 6), 0.0) AS mean_word_len
FROM t LEFT JOIN s USING (doc_id)
""")
def fingerprint_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scalar_fingerprint(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
WITH t AS (SELECT conv_id, {TOK} AS w FROM conversations)
SELECT conv_id, count(*) AS n_pages, CASE WHEN count(*) > 1 THEN round(var_pop(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END), 6) ELSE 0.0 END AS ttr_variance
FROM t GROUP BY conv_id
""")
def page_ttr_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_ttr_variance(table(spark, sf_dir, "conversations"), "conv_id", "text")


def _gram_sql(grams: list[str]) -> str:
    return f"""
WITH t AS (SELECT doc_id, ' ' || array_to_string({TOK}, ' ') AS s FROM documents),
c AS (SELECT doc_id, g AS gram, (length(s) - length(replace(s, g, ''))) // length(g) AS n FROM t, (SELECT unnest({listing(grams)}) AS g))
SELECT doc_id, gram, CASE WHEN sum(n) OVER (PARTITION BY doc_id) > 0 THEN round(n / sum(n) OVER (PARTITION BY doc_id), 6) ELSE 0.0 END AS share FROM c
"""


@query(_gram_sql(BIGRAMS))
def char_bigram_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gram_profile(table(spark, sf_dir, "documents"), "doc_id", "text", BIGRAMS)


@query(_gram_sql(TRIGRAMS))
def char_trigram_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gram_profile(table(spark, sf_dir, "documents"), "doc_id", "text", TRIGRAMS)


@query(f"""
WITH t AS (SELECT doc_id, {TOK} AS w FROM documents),
c AS (SELECT doc_id, word, len(w) AS size, len(list_filter(w, lambda x: x = word)) AS n FROM t, (SELECT unnest({listing(FUNCTION_WORDS)}) AS word)),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c)
SELECT doc_id, word, round(n / greatest(total, 1), 6) AS share, round(n / greatest(size, 1), 6) AS rate,
  CASE WHEN size > 0 THEN round(1 - total / size, 6) ELSE 0.0 END AS density FROM s
""")
def function_word_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.word_profile(table(spark, sf_dir, "documents"), "doc_id", "text", FUNCTION_WORDS)


@query(f"""
WITH t AS (SELECT doc_id, {TOK} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, i - 1 AS pos, w[i] AS x FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x ORDER BY pos) = 1 AS is_first FROM p),
v AS (SELECT doc_id, n, pos, sum(is_first::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS v FROM f),
s AS (
  SELECT doc_id, ln(pos + 1) AS x, ln(v) AS y FROM v WHERE n >= 20 AND pos % greatest(1, n // 500) = 0
  UNION ALL SELECT doc_id, ln(pos + 1), ln(v) FROM v WHERE n >= 20 AND pos = n - 1
), r AS (SELECT doc_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, var_pop(y) AS spread FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(w) < 20 THEN 1.0 ELSE round(exp(a), 4) END AS k, CASE WHEN len(w) < 20 THEN 0.5 ELSE round(b, 4) END AS beta,
  CASE WHEN len(w) < 20 OR spread <= 0 THEN 0.0 ELSE round(r2, 4) END AS r2
FROM t LEFT JOIN r USING (doc_id)
""")
def heaps_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.heaps_fit(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
SELECT x AS word, count(*) AS count FROM (SELECT unnest({TOK}) AS x FROM documents)
WHERE length(x) >= 3 AND NOT list_contains({listing(FUNCTION_WORDS)}, x) GROUP BY x ORDER BY count(*) DESC, x LIMIT 100
""")
def mfw_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.most_frequent_words(table(spark, sf_dir, "documents"), "text", 100, FUNCTION_WORDS)


@query(f"""
WITH t AS (SELECT source, lang, {TOK} AS w FROM documents),
f AS (
  SELECT source || '/' || lang AS grp, word, sum(len(list_filter(w, lambda x: x = word))) / greatest(sum(len(w)), 1) AS freq
  FROM t, (SELECT unnest({listing(FUNCTION_WORDS)}) AS word) GROUP BY ALL
)
SELECT a.grp AS a, b.grp AS b,
  round(CASE WHEN sqrt(sum(a.freq * a.freq)) * sqrt(sum(b.freq * b.freq)) < 1e-12 THEN 1.0 ELSE 1 - sum(a.freq * b.freq) / (sqrt(sum(a.freq * a.freq)) * sqrt(sum(b.freq * b.freq))) END, 6) AS cosine_distance,
  round(sum(abs(a.freq - b.freq)), 6) AS l1
FROM f a JOIN f b ON a.word = b.word AND a.grp < b.grp GROUP BY ALL
""")
def fingerprint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and L1 distance of the function-word profiles of all pairs of (source, language) groups."""
    docs = table(spark, sf_dir, "documents").withColumn("grp", F.concat_ws("/", "source", "lang"))
    f = S.relative_frequencies(docs, ["grp"], "text", FUNCTION_WORDS)
    a = f.select(F.col("grp").alias("a"), "feature", F.col("freq").alias("x"))
    b = f.select(F.col("grp").alias("b"), "feature", F.col("freq").alias("y"))
    norms = F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))
    cosine = F.when(norms < 1e-12, F.lit(1.0)).otherwise(1 - F.sum(F.col("x") * F.col("y")) / norms)
    return a.join(b, "feature").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(
        F.round(cosine, 6).alias("cosine_distance"), F.round(F.sum(F.abs(F.col("x") - F.col("y"))), 6).alias("l1")
    )


@query(f"""
WITH t AS (SELECT lang, source, {TOK} AS w FROM documents),
r AS (SELECT lang AS label, source AS ref, word, sum(len(list_filter(w, lambda x: x = word))) / greatest(sum(len(w)), 1) AS freq
  FROM t, (SELECT unnest({listing(FUNCTION_WORDS)}) AS word) GROUP BY ALL),
st AS (SELECT word, avg(freq) AS mean, CASE WHEN stddev_pop(freq) = 0 THEN 1e-6 ELSE stddev_pop(freq) END AS std FROM r GROUP BY word),
g AS (SELECT item_id, word, len(list_filter(w, lambda x: x = word)) / greatest(len(w), 1) AS freq
  FROM (SELECT item_id, {TOK} AS w FROM benchmark), (SELECT unnest({listing(FUNCTION_WORDS)}) AS word)),
d AS (SELECT item_id, label, ref, round(avg(abs((g.freq - mean) / std - (r.freq - mean) / std)), 9) AS d
  FROM g JOIN r USING (word) JOIN st USING (word) GROUP BY ALL),
p AS (SELECT item_id, label, round(avg(d), 6) AS distance, arg_min(ref, (d, ref)) AS nearest FROM d GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, label) AS rank FROM p
""")
def delta_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta of every benchmark item to the languages, the references being (language, source) groups."""
    docs = table(spark, sf_dir, "documents").withColumns({"label": F.col("lang"), "ref": F.col("source")})
    targets = S.relative_frequencies(table(spark, sf_dir, "benchmark"), ["item_id"], "text", FUNCTION_WORDS)
    return S.delta_ranking(targets, S.relative_frequencies(docs, ["label", "ref"], "text", FUNCTION_WORDS), "item_id")


@query(f"""
WITH t AS (SELECT doc_id, lang, {TOK} AS w FROM documents),
r AS (SELECT lang AS label, word, sum(len(list_filter(w, lambda x: x = word))) / greatest(sum(len(w)), 1) AS freq
  FROM t, (SELECT unnest({listing(FUNCTION_WORDS)}) AS word) GROUP BY ALL),
st AS (SELECT word, avg(freq) AS mean, CASE WHEN stddev_pop(freq) = 0 THEN 1e-6 ELSE stddev_pop(freq) END AS std FROM r GROUP BY word),
z AS (SELECT doc_id, w, len(w) AS n,
  CASE WHEN len(w) < 500 THEN greatest(80, len(w) // 3) WHEN len(w) < 1500 THEN 250 ELSE 400 END AS size,
  CASE WHEN len(w) < 500 THEN greatest(40, len(w) // 6) WHEN len(w) < 1500 THEN 150 ELSE 250 END AS step
  FROM t WHERE len(w) >= 120),
sl AS (SELECT doc_id, s, w[s + 1:s + size] AS x FROM (SELECT *, unnest(range(0, n, step)) AS s FROM z)
  WHERE s = 0 OR least(size, n - s) >= greatest(80.0, size / 2)),
f AS (SELECT doc_id, s, word, len(list_filter(x, lambda v: v = word)) / len(x) AS freq FROM sl, (SELECT unnest({listing(FUNCTION_WORDS)}) AS word)),
d AS (SELECT doc_id, s, label, round(avg(abs((f.freq - mean) / std - (r.freq - mean) / std)), 6) AS d
  FROM f JOIN r USING (word) JOIN st USING (word) GROUP BY ALL),
b AS (SELECT doc_id, s, arg_min(label, (d, label)) AS label FROM d GROUP BY ALL)
SELECT doc_id, label, count(*) AS votes FROM b GROUP BY ALL
""")
def rolling_delta_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the rolling windows of every document for the language of smallest Delta."""
    docs = table(spark, sf_dir, "documents")
    refs = S.relative_frequencies(docs.withColumn("label", F.col("lang")), ["label"], "text", FUNCTION_WORDS)
    slices = S.rolling_slices(docs, "doc_id", "text")
    return S.rolling_vote(slices, "doc_id", refs, FUNCTION_WORDS)
