"""Evaluation, geometry, vocabulary and registry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import protocol as P
from quillon.functions.text import ascii_edit_form
from quillon.operators import evaluate as E
from quillon.operators import search
from quillon.plans.registry import query, table

#: Folded item, and the same with every 17th letter lost and "th" misread.
_PAIRS = r"""
p AS (SELECT item_id, replace(strip_accents(lower(text)), 'ß', 'ss') AS truth FROM benchmark),
q AS (SELECT *, replace(regexp_replace(truth, '([a-z ,.]{16})[a-z ,.]', '\1', 'g'), 'th', 'ih') AS guess FROM p)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = ascii_edit_form(F.col("text"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", truth.alias("truth"))
    guess = F.replace(F.regexp_replace("truth", "([a-z ,.]{16})[a-z ,.]", "$1"), F.lit("th"), F.lit("ih"))
    return rows.withColumn("guess", guess)


_CASES = f"""{_PAIRS},
c AS (SELECT item_id, length(truth) AS n_chars, levenshtein(truth, guess) AS edits FROM q),
r AS (SELECT *, CASE WHEN n_chars > 0 THEN round(edits / n_chars * 100, 4) ELSE 0.0 END AS cer FROM c)"""
_DISPOSITION = "CASE WHEN cer < 1 THEN 'PASS' WHEN cer < 3 THEN 'COND_PASS' ELSE 'FAIL' END"


@query(f"WITH {_CASES} SELECT *, {_DISPOSITION} AS disposition FROM r")
def cer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = E.cer_cases(_pairs(spark, sf_dir), ["item_id"], "truth", "guess")
    return cases.withColumn("disposition", E.disposition(F.col("cer"), F.lit(0.0)))


@query(f"""WITH {_CASES} SELECT item_id % 4 AS grp, count(*) AS n_cases, CAST(sum(edits) AS BIGINT) AS edits, round(sum(edits) / sum(n_chars) * 100, 4) AS cer,
count(*) FILTER ({_DISPOSITION} = 'FAIL') AS failed FROM r GROUP BY 1""")
def cer_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = cer_cases(spark, sf_dir).withColumn("grp", F.col("item_id") % 4)
    return cases.groupBy("grp").agg(
        F.count("*").alias("n_cases"),
        F.sum("edits").alias("edits"),
        F.round(F.sum("edits") / F.sum("n_chars") * 100, 4).alias("cer"),
        F.count_if(F.col("disposition") == "FAIL").alias("failed"),
    )


@query(rf"""WITH {_PAIRS}, w AS (SELECT item_id, list_filter(regexp_split_to_array(truth, '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(guess, '\s+'), lambda x: x <> '') AS b FROM q),
d AS (SELECT *, list_distinct(list_concat(a, b)) AS names FROM w), c AS (SELECT item_id, len(a) AS n, array_to_string(list_transform(a, lambda x: chr(CAST(list_position(names, x) AS INT))), '') AS x, array_to_string(list_transform(b, lambda x: chr(CAST(list_position(names, x) AS INT))), '') AS y FROM d)
SELECT item_id, CAST(n AS BIGINT) AS n_words, CASE WHEN n > 0 THEN round(100 * levenshtein(x, y) / n, 4) ELSE 0.0 END AS wer FROM c""")
def wer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of the misread items; in SQL each word of a pair is one letter."""
    n = F.size(F.filter(F.split("truth", r"\s+"), lambda x: x != ""))
    return _pairs(spark, sf_dir).select("item_id", n.cast("long").alias("n_words"), E.word_error_rate("truth", "guess").alias("wer"))


#: Distances a row of the table at a time; blocks by the longest common run of each open stretch (of frequent words only where
#: nothing else is common, as the library has it), which is then cut around them.
_WER_CASES = r"""
WITH RECURSIVE t AS (
  SELECT q.conv_id, q.turn, p.text AS x, q.text AS y FROM conversations q JOIN conversations p ON p.conv_id = q.conv_id AND p.turn = q.turn - 1
), p AS (
  SELECT row_number() OVER () AS id, conv_id, turn, list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '') AS a, list_filter(regexp_split_to_array(y, '\s+'), lambda w: w <> '') AS b FROM t
), n AS (
  SELECT *, len(a) AS n, len(b) AS m FROM p
), dp AS (
  SELECT id, 0 AS i, unnest(range(m + 1)) AS j, unnest(range(m + 1)) AS v FROM n
  UNION ALL
  SELECT id, i, j, j + min(u - j) OVER (PARTITION BY id ORDER BY j) FROM (
    SELECT d.id, d.i + 1 AS i, d.j, least(d.v + 1, CASE WHEN d.j > 0 THEN lag(d.v) OVER (PARTITION BY d.id ORDER BY d.j) + (n.a[d.i + 1] <> n.b[d.j])::INT ELSE 1e9 END) AS u
    FROM dp d JOIN n ON n.id = d.id AND d.i < n.n)
), edits AS (
  SELECT dp.id, v FROM dp JOIN n ON n.id = dp.id AND dp.i = n.n AND dp.j = n.m
), aw AS (SELECT id, unnest(range(n)) AS i, unnest(a) AS w FROM n), bw AS (SELECT id, m, unnest(range(m)) AS j, unnest(b) AS w FROM n),
hit AS (
  SELECT aw.id, i, j, m >= 200 AND count(*) OVER (PARTITION BY aw.id, i) > m // 100 + 1 AS often FROM aw JOIN bw ON aw.id = bw.id AND aw.w = bw.w
), seg AS (
  SELECT id, 0::BIGINT AS la, n AS ha, 0::BIGINT AS lb, m AS hb, 0::BIGINT AS bi, 0::BIGINT AS bj, 0::BIGINT AS bk FROM n
  UNION ALL
  SELECT id, unnest([la, bi + bk]), unnest([bi, ha]), unnest([lb, bj + bk]), unnest([bj, hb]), bi, bj, bk FROM (
    SELECT id, la, ha, lb, hb, best[4] AS bi, best[4] + best[3] AS bj, best[5] AS bk FROM (
      SELECT id, la, ha, lb, hb, min([-k, i0, -d, fi, fk]) AS best FROM (
        SELECT id, la, ha, lb, hb, d, CASE WHEN often THEN 0 ELSE count(*) END AS k, min(i) AS i0, min(fi) AS fi, min(fk) AS fk FROM (
          SELECT *, min(i) OVER (PARTITION BY id, la, lb, d, f) AS fi, count(*) OVER (PARTITION BY id, la, lb, d, f) AS fk FROM (
            SELECT s.id, s.la, s.ha, s.lb, s.hb, i, j, often, i - j AS d, i - row_number() OVER (PARTITION BY s.id, s.la, s.lb, i - j ORDER BY i) AS f,
              i - row_number() OVER (PARTITION BY s.id, s.la, s.lb, i - j, often ORDER BY i) AS g
            FROM seg s JOIN hit h ON h.id = s.id AND h.i >= s.la AND h.i < s.ha AND h.j >= s.lb AND h.j < s.hb))
        WHERE NOT often OR (i = la AND j = lb) GROUP BY id, la, ha, lb, hb, d, often, g)
      GROUP BY id, la, ha, lb, hb))
), block AS (
  SELECT DISTINCT id, bi, bj, bk FROM seg WHERE bk > 0 UNION ALL SELECT id, n, m, 0 FROM n
), gap AS (
  SELECT id, bi - coalesce(lag(bi + bk) OVER w, 0) AS x, bj - coalesce(lag(bj + bk) OVER w, 0) AS y FROM block WINDOW w AS (PARTITION BY id ORDER BY bi, bj, bk DESC)
), counted AS (
  SELECT id, sum(CASE WHEN x > 0 AND y > 0 THEN greatest(x, y) ELSE 0 END) AS subs, sum(CASE WHEN x = 0 THEN y ELSE 0 END) AS adds, sum(CASE WHEN y = 0 THEN x ELSE 0 END) AS omits FROM gap GROUP BY id
)
SELECT conv_id, turn, CASE WHEN n > 0 THEN round(100 * v / n, 4) ELSE 0.0 END AS wer, CAST(subs AS BIGINT) AS subs, CAST(adds AS BIGINT) AS adds, CAST(omits AS BIGINT) AS omits
FROM n JOIN edits USING (id) JOIN counted USING (id)
"""


@query(_WER_CASES)
def wer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of every answer against the turn before it."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("truth"))
    pairs = turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", E.word_errors("truth", "text").alias("e"))
    return pairs.select("conv_id", "turn", "e.*")


@query(rf"""WITH {_PAIRS}, l AS (SELECT item_id, unnest(string_split(truth, chr(10))) AS a, generate_subscripts(string_split(truth, chr(10)), 1) AS line_no FROM q),
d AS (SELECT item_id, CAST(line_no - 1 AS BIGINT) AS line_no, a, replace(replace(a, 'en', 'n'), 'th', 'ht') AS b FROM l),
e AS (SELECT *, CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0 ELSE levenshtein(a, b) / greatest(length(a), length(b)) END AS x FROM d)
SELECT item_id, line_no, round(x, 6) AS cer, CASE WHEN regexp_matches(a, '[^a-z ,.]') THEN 'review' WHEN x <= 0.05::DOUBLE THEN 'confident' WHEN x <= 0.30::DOUBLE THEN 'review' ELSE 'low' END AS tier FROM e""")
def line_cer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _pairs(spark, sf_dir).select("item_id", F.posexplode_outer(F.split("truth", "\n")).alias("line_no", "a"))
    rows = lines.withColumn("b", F.replace(F.replace("a", F.lit("en"), F.lit("n")), F.lit("th"), F.lit("ht")))
    x = E.line_cer(F.col("a"), F.col("b"))
    rare = F.col("a").rlike("[^a-z ,.]")
    return rows.select("item_id", F.col("line_no").cast("long").alias("line_no"), F.round(x, 6).alias("cer"), E.tier(x, rare).alias("tier"))


_BOX = "{{'x0': CAST(floor({v}[1] * 100) AS BIGINT), 'y0': CAST(floor({v}[2] * 100) AS BIGINT), 'x1': CAST(floor({v}[1] * 100) + 20 + floor(abs({v}[3]) * 100) AS BIGINT), 'y1': CAST(floor({v}[2] * 100) + 20 + floor(abs({v}[4]) * 100) AS BIGINT)}}"
_BOXES = "b AS (SELECT vec_id, label, " + _BOX.format(v="CAST(embedding AS DOUBLE[])") + " AS box FROM embeddings)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.col("embedding")[i].cast("double") * 100
    x0, y0 = F.floor(part(0)), F.floor(part(1))
    box = F.struct(
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 20 + F.floor(F.abs(F.col("embedding")[2].cast("double")) * 100)).alias("x1"),
        (y0 + 20 + F.floor(F.abs(F.col("embedding")[3].cast("double")) * 100)).alias("y1"),
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", box.alias("box"))


@query(f"""WITH {_BOXES}, j AS (SELECT a.vec_id, a.box AS p, c.box AS q FROM b a JOIN b c ON c.vec_id = a.vec_id + 1),
i AS (SELECT vec_id, p, q, greatest(least(p.x1, q.x1) - greatest(p.x0, q.x0), 0) * greatest(least(p.y1, q.y1) - greatest(p.y0, q.y0), 0) AS n FROM j)
SELECT vec_id, round(CASE WHEN n > 0 THEN n / ((p.x1 - p.x0) * (p.y1 - p.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - n) ELSE 0.0 END, 6) AS iou,
  CASE WHEN n > 0 AND n / ((p.x1 - p.x0) * (p.y1 - p.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - n) >= 0.3::DOUBLE THEN 'iou' ELSE 'order' END AS method FROM i""")
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box of each row against the next one's: matched by overlap from 0.3 on, else by order."""
    boxes = _boxes(spark, sf_dir)
    after = boxes.select((F.col("vec_id") - 1).alias("vec_id"), F.col("box").alias("q"))
    share = E.iou(F.col("box"), F.col("q"))
    return boxes.join(after, "vec_id").select(
        "vec_id", F.round(share, 6).alias("iou"), F.when(share >= 0.3, "iou").otherwise("order").alias("method")
    )


@query(f"WITH {_BOXES} SELECT label, min(box.x0) AS x0, min(box.y0) AS y0, max(box.x1) AS x1, max(box.y1) AS y1, count(*) AS n FROM b GROUP BY label")
def bbox_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).groupBy("label")
    return b.agg(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"), F.count("*").alias("n"))


#: Points of a line at equal arc lengths, and the greedy match as a walk over a page's references.
_GREEDY = f"""
WITH RECURSIVE {_BOXES}, l AS (
  SELECT vec_id // 10 AS page, vec_id % 10 AS line_no, CAST(box.x0 AS DOUBLE) AS x0, CAST(box.x1 AS DOUBLE) AS x1, CAST(box.y1 + vec_id % 10 * 40 AS DOUBLE) AS y, label, vec_id FROM b
), made AS (
  SELECT page, line_no, 0 AS side, [{{'x': x0, 'y': y}}, {{'x': x1, 'y': y}}] AS p FROM l
  UNION ALL SELECT page, line_no, 1, [{{'x': x0 + label, 'y': y}}, {{'x': x1 + label, 'y': y}}] FROM l WHERE vec_id % 7 <> 0
), arc AS (
  SELECT *, list_transform(range(len(p)), lambda i: list_sum(list_transform(range(i), lambda k: sqrt((p[k + 2].x - p[k + 1].x) ** 2 + (p[k + 2].y - p[k + 1].y) ** 2)))) AS s FROM made
), target AS (
  SELECT *, list_transform(range(32), lambda i: coalesce(s[-1], 0.0) * i / 31) AS ts FROM arc
), spot AS (
  SELECT *, list_transform(ts, lambda t: {{'t': t, 'k': least(greatest(len(list_filter(s, lambda c: coalesce(c, 0.0) < t)), 1), len(p) - 1)}}) AS ks FROM target
), sampled AS (
  SELECT page, line_no, side, {{'x': list_avg(list_transform(p, lambda q: q.x)), 'y': list_avg(list_transform(p, lambda q: q.y))}} AS c,
    list_transform(ks, lambda z: {{'x': p[z.k].x + (p[z.k + 1].x - p[z.k].x) * coalesce((z.t - coalesce(s[z.k], 0.0)) / nullif(s[z.k + 1] - coalesce(s[z.k], 0.0), 0), 0.0),
      'y': p[z.k].y + (p[z.k + 1].y - p[z.k].y) * coalesce((z.t - coalesce(s[z.k], 0.0)) / nullif(s[z.k + 1] - coalesce(s[z.k], 0.0), 0), 0.0)}}) AS q FROM spot
), ref AS (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY c.y, c.x, line_no) AS r FROM sampled WHERE side = 0
), hyp AS (
  SELECT page, list({{'i': line_no, 'c': c, 'q': q}} ORDER BY line_no) AS hs FROM sampled WHERE side = 1 GROUP BY page
), walk AS (
  SELECT page, 0::BIGINT AS r, []::BIGINT[] AS taken, []::DOUBLE[] AS gaps FROM (SELECT DISTINCT page FROM l)
  UNION ALL
  SELECT page, r, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best.i) END,
    CASE WHEN best IS NULL THEN gaps ELSE list_append(gaps, (list_avg(list_transform(q, lambda u: list_min(list_transform(best.q, lambda v: sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2)))))
      + list_avg(list_transform(best.q, lambda u: list_min(list_transform(q, lambda v: sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2)))))) / 2) END
  FROM (
    SELECT w.page, w.r + 1 AS r, w.taken, w.gaps, ref.q, list_sort(list_filter(list_transform(list_filter(coalesce(hs, []), lambda h: NOT list_contains(w.taken, h.i)),
      lambda h: {{'gap': sqrt((ref.c.x - h.c.x) ** 2 + (ref.c.y - h.c.y) ** 2), 'i': h.i, 'q': h.q}}), lambda g: g.gap < 60))[1] AS best
    FROM walk w JOIN ref ON ref.page = w.page AND ref.r = w.r + 1 LEFT JOIN hyp ON hyp.page = w.page)
), last AS (SELECT page, max(r) AS n_ref, arg_max(gaps, r) AS gaps FROM walk GROUP BY page)
SELECT page, n_ref, CAST(coalesce(len(hs), 0) AS BIGINT) AS n_hyp, CAST(len(gaps) AS BIGINT) AS n_matched, CASE WHEN n_ref > 0 THEN len(gaps) / n_ref ELSE 1.0 END AS recall,
  CASE WHEN coalesce(len(hs), 0) > 0 THEN len(gaps) / len(hs) ELSE 1.0 END AS precision, CASE WHEN len(gaps) > 0 THEN round(round(list_avg(gaps), 9), 6) END AS chamfer
FROM last LEFT JOIN hyp USING (page)
"""


@query(_GREEDY)
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines made of the boxes, ten to a page, against the same ones shifted by their label."""
    rows = _boxes(spark, sf_dir).withColumns({"page": F.floor(F.col("vec_id") / 10), "line_no": F.col("vec_id") % 10})

    def points(dx) -> F.Column:
        y = (F.col("box.y1") + F.col("line_no") * 40).cast("double")
        at = lambda x: F.struct((x + dx).cast("double").alias("x"), y.alias("y"))
        return F.array(at(F.col("box.x0")), at(F.col("box.x1")))

    refs = rows.select("page", "line_no", points(F.lit(0)).alias("points"))
    hyps = rows.where("vec_id % 7 <> 0").select("page", "line_no", points(F.col("label")).alias("points"))
    return E.compare_lines(refs, hyps, "page", 60.0)


_POSITIONS = ["Main Text", "right-margin note", "Headers", "Table Row", "Bylines", "Top  Left", "marginalia", "Main-Body", "corner note", "page--number", "bottom_corner_x", "top_left_margins", "Upper Left Margins", "lower-right corners", "corners", "glosses"]


@query(r"""
SELECT event_id, CASE event_id % 17 WHEN 0 THEN 'Main Text' WHEN 1 THEN 'margin_right' WHEN 2 THEN 'header' WHEN 3 THEN 'table_row' WHEN 4 THEN 'body' WHEN 5 THEN 'margin_top' WHEN 6 THEN 'margin_left' WHEN 7 THEN 'body'
  WHEN 8 THEN 'corner note' WHEN 9 THEN 'footer' WHEN 10 THEN 'margin_bottom' WHEN 11 THEN 'margin_left' WHEN 12 THEN 'margin_left' WHEN 13 THEN 'margin_right' WHEN 14 THEN 'corners' WHEN 15 THEN 'glosses' ELSE event_type END AS position FROM events
""")
def position_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as they are written, in the protocol's names; what is unknown stays."""
    raw = F.col("event_type")
    for i, value in enumerate(_POSITIONS):
        raw = F.when(F.col("event_id") % 17 == i, value).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", P.position(raw).alias("position"))


@query(r"""
WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '[*#%&$]{3}')) AS marks, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM documents)
SELECT doc_id, CAST(marks AS BIGINT) AS n_uncertain, CAST(words AS BIGINT) AS n_words, marks / greatest(words, 1) > 0.30::DOUBLE AS needs_note FROM m
""")
def protocol_fixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which more than 0.3 of the words carry a mark of doubt, so that a note is due."""
    marks = F.regexp_count("text", F.lit("[*#%&$]{3}")).cast("long")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", marks.alias("n_uncertain"), words.alias("n_words"))
    return rows.withColumn("needs_note", F.col("n_uncertain") / F.greatest("n_words", F.lit(1)) > 0.30)


_REGISTRY = """
m AS (SELECT s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'la' WHEN 2 THEN 'fr,la' WHEN 3 THEN 'de' ELSE '*' END AS languages, CASE s_suppkey % 4 WHEN 0 THEN '*' WHEN 1 THEN '13,14' WHEN 2 THEN '15,16' ELSE '' END AS eras,
  CASE s_suppkey % 3 WHEN 0 THEN 'c1' ELSE 'r' || (s_suppkey % 9) END AS round, (s_suppkey % 37) / 100.0::DOUBLE AS cer FROM supplier),
w AS (SELECT n_nationkey AS job_id, CASE n_nationkey % 4 WHEN 0 THEN 'la' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS lang, CASE n_nationkey % 3 WHEN 0 THEN '14' WHEN 1 THEN '15' ELSE '12' END AS era FROM nation)"""


@query(f"""
WITH {_REGISTRY},
c AS (SELECT job_id, name, cer, CASE WHEN regexp_matches(round, '^r[0-9]+$') THEN CAST(substr(round, 2) AS INTEGER) ELSE 0 END AS rnd,
  list_contains(string_split(languages, ','), lang) AS has_lang, list_contains(string_split(eras, ','), era) AS has_era,
  languages = '' OR list_contains(string_split(languages, ','), '*') OR list_contains(string_split(languages, ','), lang) AS ok_lang,
  eras = '' OR list_contains(string_split(eras, ','), '*') OR list_contains(string_split(eras, ','), era) AS ok_era FROM m, w)
SELECT CAST(job_id AS BIGINT) AS job_id, name, row_number() OVER (PARTITION BY job_id ORDER BY (ok_lang AND ok_era)::INT DESC, has_lang::INT DESC, has_era::INT DESC, rnd DESC, cer, name) AS rank FROM c
""")
def registry_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as models of a registry, ranked for the jobs of every nation."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    pick = lambda key, *values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    models = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), pick(k, "", "la", "fr,la", "de", "*").alias("languages"), pick(k, "*", "13,14", "15,16", "").alias("eras"),
        F.when(k % 3 == 0, "c1").otherwise(F.concat(F.lit("r"), (k % 9).cast("string"))).alias("round"), ((k % 37) / 100).alias("cer"),
    )
    wanted = table(spark, sf_dir, "nation").select(n.cast("long").alias("job_id"), pick(n, "la", "fr", "de", "es").alias("lang"), pick(n, "14", "15", "12").alias("era"))
    return search.rank_models(models, wanted)


@query("""
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q.e, v.e), 5) AS similarity FROM q, v WHERE query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 5
""")
def embedding_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other rows of every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return search.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)


@query(r"""WITH q AS (SELECT item_id, trim(regexp_replace(regexp_replace(translate(strip_accents(lower(text)), 'vj', 'ui'), '[''.,;:!?"`’‘“”…—\-()\[\]]+', ' ', 'g'), '\s+', ' ', 'g')) AS a FROM benchmark),
g AS (SELECT item_id, a, trim(regexp_replace(replace(a || ' ', 'en ', 'n '), '\s+', ' ', 'g')) AS b FROM q)
SELECT item_id, 'exact' AS how, CAST(length(a) AS BIGINT) AS n_chars, CAST(len(list_filter(string_split(a, ' '), lambda w: w <> '')) AS BIGINT) AS n_words, CASE WHEN length(a) > 0 THEN round(levenshtein(a, b) / length(a) * 100, 4) ELSE 0.0 END AS cer FROM g""")
def score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as truths and with letters left out as hypotheses, both in the scoring form."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), "text")
    from quillon.functions.forms import scoring_form

    wrong = F.replace(F.concat(scoring_form(F.col("text")), F.lit(" ")), F.lit("en "), F.lit("n "))
    rows = E.score_run(items.select("item_id", wrong.alias("text")), items, "item_id", "text")
    kind = table(spark, sf_dir, "benchmark").schema["item_id"].dataType
    return rows.select(F.col("item_id").cast(kind).alias("item_id"), "how", "n_chars", "n_words", "cer")
