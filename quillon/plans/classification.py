"""Lexicon scoring and tagging over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import classify as C
from quillon.plans.registry import query, table
from quillon.plans.stylometry import TOK

#: Our own small lexicons for the languages of the synthetic corpus.
LEXICON = {
    "de": {"der": 1.0, "die": 1.0, "und": 0.8, "ein": 0.7, "nicht": 1.2},
    "en": {"the": 1.0, "and": 0.8, "of": 0.7, "with": 1.2, "that": 0.9},
    "es": {"los": 1.0, "las": 1.0, "que": 0.5, "del": 0.9, "por": 1.1},
    "fr": {"les": 1.0, "des": 1.0, "que": 0.5, "une": 0.9, "dans": 1.1},
}


def _scores(keys: str, source: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {keys}, '{label}' AS label, (" + " + ".join(f"CASE WHEN len(list_filter(w, lambda x: x = '{t}')) > 0 THEN {v}::DOUBLE * (1 + ln(len(list_filter(w, lambda x: x = '{t}')))) ELSE 0.0::DOUBLE END" for t, v in sorted(terms.items())) + ") / sqrt(greatest(len(w), 1) / 80.0::DOUBLE) AS score FROM t"
        for label, terms in sorted(LEXICON.items())
    )
    return f"t AS (SELECT {keys}, {TOK} AS w FROM {source}), sc AS ({parts})"


def _probs(keys: str, source: str) -> str:
    return _scores(keys, source) + f""", pr AS (
  SELECT {keys}, label, exp(score - max(score) OVER (PARTITION BY {keys})) / sum(exp(score - mx)) OVER (PARTITION BY {keys}) AS prob
  FROM (SELECT *, max(score) OVER (PARTITION BY {keys}) AS mx FROM sc))"""


@query(f"WITH {_scores('doc_id', 'documents')} SELECT doc_id, label, round(score, 6) AS score FROM sc")
def lexicon_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lexicon_evidence(table(spark, sf_dir, "documents"), ["doc_id"], "text", LEXICON)


@query(f"WITH {_probs('doc_id', 'documents')} SELECT doc_id, label, round(prob, 6) AS prob FROM pr")
def label_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.label_probs(table(spark, sf_dir, "documents"), ["doc_id"], "text", LEXICON)
    return rows.select("doc_id", F.explode_outer("probs").alias("p")).select("doc_id", "p.label", F.round("p.prob", 6).alias("prob"))


@query(f"""
WITH {_probs('conv_id, turn', 'conversations')},
s AS (SELECT conv_id, turn, arg_min(label, (-round(prob, 12), label)) AS best, max(prob) AS sure, list(prob ORDER BY label) AS p FROM pr GROUP BY conv_id, turn),
f AS (SELECT *, lag(best) OVER w AS lb, lag(sure) OVER w AS ls, list(best) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pb,
  list(p) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pp, list(best) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS cb,
  list(p) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS cp FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT *, CASE WHEN len(pb) = 3 AND pb[2] = pb[3] THEN pb[2] ELSE pb[1] END AS pt, CASE WHEN len(cb) = 3 AND cb[2] = cb[3] THEN cb[2] ELSE cb[1] END AS ct FROM f WHERE len(pb) > 0)
SELECT conv_id, turn FROM m WHERE (lb <> best AND least(ls, sure) >= 0.08)
  OR (pt <> ct AND abs(list_avg(list_transform(cp, lambda x: x[list_position(['de', 'en', 'es', 'fr'], ct)])) - list_avg(list_transform(pp, lambda x: x[list_position(['de', 'en', 'es', 'fr'], pt)]))) >= 0.08)
""")
def genre_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = C.label_probs(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", LEXICON)
    rounded = F.transform("probs", lambda p: F.struct(p["label"].alias("label"), F.round(p["prob"], 12).alias("prob")))
    return C.boundaries(segments.withColumn("probs", rounded), "conv_id", "turn", 3, 0.08)


@query(r"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS l, text,
  greatest(len(regexp_extract_all(strip_accents(lower(text)), '[a-z]{2,}')), 1) AS words FROM documents),
m AS (SELECT doc_id, greatest(len(l), 1) AS n, len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 3)) AS pipes,
  len(regexp_extract_all(text, '[0-9]+')) AS digits, words, list_transform(l, lambda x: len(string_split_regex(x, '\s+'))) AS sizes FROM t)
SELECT doc_id, round(least(1.0, greatest(0.0, pipes / n * 2.0::DOUBLE)), 6) AS table_density, round(least(1.0, greatest(0.0, digits / words * 18.0::DOUBLE)), 6) AS digit_density,
  round(CASE WHEN n >= 6 THEN len(list_filter(sizes, lambda s: s BETWEEN 3 AND 9)) / n ELSE 0.0 END, 6) AS short_lines,
  round(least(1.0, greatest(0.0, (10 - coalesce(list_sum(sizes), 0) / n) / 8)), 6) AS low_line_length FROM m
""")
def structural_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.structural_features(table(spark, sf_dir, "documents"), "doc_id", "text")


KEYWORDS = {"prose": {"the": 1.0, "of the": 2.0, "que": 1.0}, "notice": {"license": 3.0, "licensed under": 5.0}, "abuse": {"idiot": 4.0, "scum": 4.0}}


def _count(key: str) -> str:
    if " " in key:
        return f"(length(t) - length(replace(t, '{key}', ''))) // {len(key)}"
    return f"len(list_filter(w, lambda x: x = '{key}'))"


_TAGS = ", ".join("CAST(" + " + ".join(f"{_count(k)} * {v}" for k, v in keys.items()) + f" AS DOUBLE) AS {name}" for name, keys in KEYWORDS.items())


@query(f"""
WITH b AS (SELECT doc_id, strip_accents(lower(text)) AS t, {TOK} AS w FROM documents), s AS (SELECT doc_id, len(w) AS n, {_TAGS} FROM b)
SELECT doc_id, round(prose, 4) AS score_prose, round(notice, 4) AS score_notice, round(abuse, 4) AS score_abuse,
  CASE WHEN greatest(prose, notice, abuse) <= 0 THEN NULL WHEN prose = greatest(prose, notice, abuse) THEN 'prose' WHEN notice = greatest(prose, notice, abuse) THEN 'notice' ELSE 'abuse' END AS dominant,
  round((prose + notice + abuse) / greatest(n, 1) * 1000, 4) AS density FROM s
""")
def keyword_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.keyword_tags(table(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS)


_HITS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS keyword, '{name}' AS category, {v}::DOUBLE AS weight, CAST({_count(k)} AS BIGINT) AS n FROM b" for name, keys in KEYWORDS.items() for k, v in keys.items())


@query(f"""
WITH b AS (SELECT doc_id, strip_accents(lower(coalesce(text, ''))) AS t, {TOK} AS w FROM documents), h AS ({_HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -weight, -weight * n, keyword, category) - 1 AS place FROM h WHERE n > 0)
SELECT doc_id, place, keyword, category, weight, n FROM r WHERE place < 3
""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heaviest keywords of every document."""
    return C.keyword_hits(table(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS, 3)


TITLE_RULES = [("article", ["the ", "of the"]), ("romance", [" que", " de "]), ("german", ["sch", "der "])]


@query("""
WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), f AS (SELECT *, strip_accents(lower(title)) AS x FROM t)
SELECT page_id, title, CASE WHEN contains(x, 'the ') OR contains(x, 'of the') THEN 'article' WHEN contains(x, ' que') OR contains(x, ' de ') THEN 'romance' WHEN contains(x, 'sch') OR contains(x, 'der ') THEN 'german' END AS label FROM f
""")
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", title.alias("title"))
    return rows.select("page_id", "title", C.title_label(F.col("title"), TITLE_RULES).alias("label"))


@query("""
WITH t AS (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), f AS (SELECT strip_accents(lower(title)) AS x FROM t)
SELECT CASE WHEN contains(x, 'the ') OR contains(x, 'of the') THEN 'article' WHEN contains(x, ' que') OR contains(x, ' de ') THEN 'romance' WHEN contains(x, 'sch') OR contains(x, 'der ') THEN 'german' ELSE '(unmatched)' END AS label, count(*) AS count FROM f GROUP BY 1
""")
def title_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_rules(spark, sf_dir).groupBy(F.coalesce("label", F.lit("(unmatched)")).alias("label")).count()


@query(r"""
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading,
  CAST(len(regexp_extract_all(html, '<a href="')) AS BIGINT) AS n_links, CAST(len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS BIGINT) AS n_targets,
  CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs FROM pages
""")
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"),
        F.size(links).cast("long").alias("n_links"),
        F.size(F.array_distinct(links)).cast("long").alias("n_targets"),
        F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"),
    )
