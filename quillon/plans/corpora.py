"""Labels, manifests, queues, splits, model records and runs over stand-in records made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import corpora as C
from quillon.plans.forms import _TITLE
from quillon.plans.registry import query, table

_LABELS = ["PROMO", "PROMO B", "STANDARD", "STANDARD P", "LARGE"]


@query("""SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD P') THEN 'STANDARD P' WHEN starts_with(p_type, 'STANDARD') THEN 'STANDARD' WHEN starts_with(p_type, 'PROMO B') THEN 'PROMO B' WHEN starts_with(p_type, 'PROMO') THEN 'PROMO' WHEN starts_with(p_type, 'LARGE') THEN 'LARGE' END AS label,
  CASE WHEN starts_with(p_type, 'STANDARD') THEN 'plain' WHEN starts_with(p_type, 'PROMO') THEN 'offer' END AS coarse FROM part""")
def name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest label that a type starts with, and the coarser label it folds into."""
    label = C.label_from_name(F.col("p_type"), _LABELS)
    fold = {"PROMO": "offer", "PROMO B": "offer", "STANDARD": "plain", "STANDARD P": "plain"}
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), C.remap(label, fold).alias("coarse"))


@query("""SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id % 100 AS VARCHAR) END AS INT), TRY_CAST(CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS INT), 0) AS score,
  coalesce(contains(lower(event_type), 'ic'), false) OR coalesce(contains(lower(CASE WHEN event_id % 4 = 0 THEN 'ICe' END), 'ic'), false) AS speaks FROM events""")
def fallback_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First whole number of two messy columns, and a language code sought in two others."""
    k = F.col("event_id")
    first = F.when(k % 3 == 0, "x").otherwise((k % 100).cast("string"))
    second = F.when(k % 2 != 0, F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", C.first_int(first, second).alias("score"), C.speaks("IC", F.col("event_type"), F.when(k % 4 == 0, "ICe")).alias("speaks"))


_META = "mt AS (SELECT doc_id, source AS corpus, lang AS script, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id || '.xml' END AS xml, CASE doc_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'train' END AS split FROM documents)"


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    split = F.when(k % 4 == 0, "val").when(k % 4 == 1, "test").when(k % 4 == 2, "train")
    xml = F.when(k % 11 != 0, F.concat(k.cast("string"), F.lit(".xml")))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("corpus"), F.col("lang").alias("script"), xml.alias("xml"), split.alias("split"))


@query(f"""WITH {_META}, c AS (SELECT DISTINCT corpus FROM mt ORDER BY corpus LIMIT 2), k AS (SELECT doc_id, corpus, CASE WHEN corpus = (SELECT min(corpus) FROM c) OR split = 'val' THEN 'val' WHEN coalesce(split, 'train') = 'train' THEN 'train' END AS part FROM mt WHERE xml IS NOT NULL AND script = 'en' AND corpus <> (SELECT max(corpus) FROM c))
SELECT doc_id, corpus, part FROM k WHERE part IS NOT NULL""")
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of one script, one corpus left out and one for validation only."""
    rows = _meta(spark, sf_dir)
    first, second = [r["corpus"] for r in rows.select("corpus").distinct().orderBy("corpus").limit(2).collect()]
    return C.manifest_rows(rows, script="en", excluded=[second], val_corpora=[first]).select("doc_id", "corpus", "part")


@query(f"""WITH {_META}, k AS (SELECT corpus, CASE WHEN split = 'val' THEN 'val' WHEN coalesce(split, 'train') = 'train' THEN 'train' END AS part FROM mt WHERE xml IS NOT NULL)
SELECT corpus, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'val') AS val FROM k WHERE part IS NOT NULL GROUP BY corpus""")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.manifest_stats(C.manifest_rows(_meta(spark, sf_dir)), "corpus", "part")


@query("""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/old/' || page_id || '.png' WHEN 1 THEN page_id || '.png' ELSE '/new/' || page_id || '.png' END AS raw FROM pages), f AS (SELECT '/new/' || page_id || '.png' AS path FROM pages WHERE page_id % 5 <> 0 UNION SELECT '/docs/' || page_id || '.png' FROM pages WHERE page_id % 2 = 0),
c AS (SELECT page_id, unnest([raw, CASE WHEN NOT starts_with(raw, '/') THEN '/docs/' || raw END, CASE WHEN contains(raw, '/old/') THEN replace(raw, '/old/', '/new/') END, '/new/' || page_id || '.png']) AS path, unnest([0, 1, 2, 3]) AS place FROM p)
SELECT page_id, arg_min(path, place) AS path FROM c WHERE path IN (SELECT path FROM f) GROUP BY page_id""")
def path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image paths of documents: as written, beside the document, with a prefix rewritten, or of the same stem."""
    pages, k = table(spark, sf_dir, "pages").select("page_id"), F.col("page_id")
    name = F.concat(k.cast("string"), F.lit(".png"))
    raw = F.when(k % 3 == 0, F.concat(F.lit("/old/"), name)).when(k % 3 == 1, name).otherwise(F.concat(F.lit("/new/"), name))
    listed = pages.where("page_id % 5 <> 0").select(F.concat(F.lit("/new/"), name).alias("path")).unionByName(pages.where("page_id % 2 = 0").select(F.concat(F.lit("/docs/"), name).alias("path")))
    tried = F.concat(C.rewritten(raw, F.lit("/docs"), [("/old/", "/new/")]), F.array(F.concat(F.lit("/new/"), name)))
    return C.first_existing(pages.select("page_id", tried.alias("c")), ["page_id"], "c", listed, "path")


@query("""SELECT item_id, CASE length(text) % 4 WHEN 0 THEN trim(text) WHEN 1 THEN 'norm ' || item_id WHEN 2 THEN 'inner ' || item_id ELSE trim(text) END AS text FROM benchmark WHERE length(trim(text)) > 0""")
def layer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised layer of segments that have it as a string, as an object, blank, or not at all."""
    rows = table(spark, sf_dir, "benchmark").where("length(trim(text)) > 0").select("item_id", "text")
    k, text, n = F.length("text") % 4, F.struct(F.col("text")), F.col("item_id").cast("string")
    segment = (
        F.when(k == 0, F.to_json(text))
        .when(k == 1, F.to_json(F.struct("text", F.concat(F.lit("norm "), n).alias("normalized"))))
        .when(k == 2, F.to_json(F.struct("text", F.lit(" ").alias("normalizedLayer"), F.struct(F.concat(F.lit("inner "), n).alias("text")).alias("expanded"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("transcription"), F.lit("").alias("normalized_text"))))
    )
    return rows.select("item_id", C.layer_text(segment, "normalized").alias("text"))


@query("""WITH r AS (SELECT event_id, event_type, CASE event_id % 5 WHEN 0 THEN NULL ELSE (event_id % 7) / 10.0 END AS cer FROM events)
SELECT event_id, coalesce(nullif(CAST(cer AS DOUBLE), 0.0), 1.0) AS queue_key FROM r""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue by error rate; rows without one come as late as those of 1."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k % 5 != 0, (k % 7) / 10).alias("cer"))
    return C.review_order(rows, "event_id", cer="cer").select("event_id", "queue_key")


@query("""SELECT count(*) AS total, count(*) FILTER (t = 'confident') AS confident, count(*) FILTER (t = 'review') AS review, count(*) FILTER (t = 'low') AS low, count(*) FILTER (t = 'review' AND p) AS rare_promoted
FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'confident' WHEN 1 THEN 'review' ELSE 'low' END AS t, event_type = 'click' AS p FROM events)""")
def tier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    tier = F.when(k == 0, "confident").when(k == 1, "review").otherwise("low")
    return C.filter_stats(table(spark, sf_dir, "events").withColumn("t", tier), "t", (F.col("t") == "review") & (F.col("event_type") == "click"))


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT source, line, arg_min(doc_id, (doc_id, n)) AS doc_id FROM l WHERE length(trim(line)) >= 60 GROUP BY source, line""")
def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of every long line of a source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return C.first_lines(rows.withColumn("o", F.struct("doc_id", "n")), ["source", "line"], "line", "o", 60).select("source", "line", "doc_id")


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('split|' || doc_id), doc_id) <= floor(0.95 * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split FROM documents""")
def global_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.global_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 40 ORDER BY md5('pairs|' || c_custkey), c_custkey) AS p, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 40) AS n FROM customer)
SELECT c_nationkey * 40 + c_custkey % 40 AS grp, c_custkey, CASE WHEN n > 1 AND p <= greatest(1, floor(n * 0.3)) THEN 'val' ELSE 'train' END AS split FROM r""")
def pair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small groups, singletons to training."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 40 + F.col("c_custkey") % 40).alias("grp"), "c_custkey")
    return C.pair_split(rows, "grp", "c_custkey", 0.3)


@query("""SELECT s_suppkey, least(CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 17) / 100.0::DOUBLE END, CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey % 13) / 100.0::DOUBLE END) AS cer FROM supplier""")
def best_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    corpora = F.when(k % 5 == 0, F.create_map(F.lit("a"), (k % 13) / 100, F.lit("b"), F.lit(None).cast("double")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.best_cer(F.when(k % 3 != 0, (k % 17) / 100), corpora).alias("cer"))


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS suggested, count(*) AS n_files, min(doc_id || '.png') AS first FROM documents GROUP BY 1""")
def batch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("suggested"), F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return C.batch_groups(rows, "suggested", "path")


@query("""WITH r AS (SELECT user_id, event_type, value, epoch(ts) AS b, epoch(ts) + value AS e FROM events) SELECT user_id, count(*) AS n_rows, round(max(e) - min(b), 3) AS wall, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0.0 END), 3) AS serial,
CASE WHEN max(e) - min(b) > 0 THEN round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0.0 END) / (max(e) - min(b)), 3) END AS efficiency FROM r GROUP BY user_id""")
def run_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall time, clicks' time and their ratio, users being runs."""
    rows = table(spark, sf_dir, "events").withColumn("b", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("e", F.col("b") + F.col("value"))
    return C.timing_report(rows, "user_id", "event_type", "value", "b", "e", "click")


@query("""SELECT o_orderkey, CAST(o_orderkey % 100 + CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 ELSE 0 END AS BIGINT) AS input_tokens, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 11 END AS BIGINT) AS output_tokens,
CAST(o_orderkey % 100 + CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 11 END AS BIGINT) AS total_tokens FROM orders""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input, output and total tokens of made-up usage maps with cached tokens beside."""
    k = F.col("o_orderkey")
    usage = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("in").alias("k"), (k % 100).alias("v")), F.when(k % 2 == 0, F.struct(F.lit("cached").alias("k"), (k % 7).alias("v"))), F.when(k % 3 != 0, F.struct(F.lit("out").alias("k"), (k % 11).alias("v"))))))
    parts = C.token_usage(F.col("u"), {"input_tokens": ["in", "cached"], "output_tokens": ["out"]})
    return table(spark, sf_dir, "orders").select("o_orderkey", usage.alias("u")).select("o_orderkey", *parts)


_RULES = [("metal", ["steel", "copper", "tin"]), ("shine", ["polished", "burnished"])]
_AUTHORS = [(["brand#1"], "first"), (["brand#2", "brand#3"], "second")]


@query(f"""WITH t AS (SELECT p_partkey, p_brand, p_type AS text, p_size FROM part), g AS (SELECT p_partkey, p_size, CASE WHEN regexp_matches({_TITLE}, 'steel|copper|tin') THEN 'metal' WHEN regexp_matches({_TITLE}, 'polished|burnished') THEN 'shine' WHEN contains(lower(p_brand || ' ' || text), 'brand#1') THEN 'first' WHEN regexp_matches(lower(p_brand || ' ' || text), 'brand#2|brand#3') THEN 'second' END AS genre FROM t)
SELECT p_partkey, genre, CASE WHEN 1200 + p_size * 10 <= 1500 THEN genre END AS medieval, coalesce(CASE WHEN p_partkey % 4 = 0 THEN 'given' END, genre) AS kept, coalesce(genre, CASE WHEN p_partkey % 4 = 0 THEN 'given' END) AS overwritten FROM g""")
def title_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre by title and author rules, within a period, and filled into records that have one or not."""
    rows = table(spark, sf_dir, "part").withColumn("given", F.when(F.col("p_partkey") % 4 == 0, "given")).withColumn("none", F.lit(" "))
    year = F.concat(F.lit("c. "), (F.col("p_size") * 10 + 1200).cast("string"))
    by = {"author": F.col("p_brand"), "authors": _AUTHORS}
    genre = C.title_genre(F.col("p_type"), _RULES, **by)
    more = {"genre": "given", "title": "none", "fallbacks": ("p_type",), **by}
    kept = C.tag_records(rows, _RULES, **more).select("p_partkey", F.col("given").alias("kept"))
    over = C.tag_records(rows, _RULES, overwrite=True, **more).select("p_partkey", F.col("given").alias("overwritten"))
    own = rows.select("p_partkey", genre.alias("genre"), C.title_genre(F.col("p_type"), _RULES, year=year, years=(1000, 1500), **by).alias("medieval"))
    return own.join(kept, "p_partkey").join(over, "p_partkey")


@query("""SELECT DISTINCT p_brand AS provider, p_type AS model FROM part UNION SELECT DISTINCT c_mktsegment, 'model ' || (c_custkey % 40) FROM customer""")
def model_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of two listings together, each once."""
    listed = table(spark, sf_dir, "part").select(F.col("p_brand").alias("provider"), F.col("p_type").alias("model"))
    named = F.concat(F.lit("model "), (F.col("c_custkey") % 40).cast("string"))
    return C.model_choices(listed, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("provider"), named.alias("model")), "provider", "model")


@query("""SELECT p_brand, arg_max(p_name, (coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_size END, 0), p_partkey)) AS name, arg_max(p_type, (coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_size END, 0), p_partkey)) AS preset FROM part WHERE p_partkey % 7 <> 0 GROUP BY p_brand""")
def preset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preset of largest priority of every brand, the last of equal ones."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_brand", k, F.col("p_name").alias("name"), F.when(k % 7 != 0, F.col("p_type")).alias("preset"), F.when(k % 3 != 0, F.col("p_size")).alias("priority"))
    return C.presets(rows, "p_brand", "priority", "p_partkey")


@query("""SELECT c_custkey, coalesce(nullif(CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '' END, ''), CASE WHEN c_custkey % 2 = 0 THEN 'type model' END, 'preset model') AS model, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'deu' END, 'lat') AS lang FROM customer""")
def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit settings over those of a type over those of a preset."""
    k = F.col("c_custkey")
    one = lambda name, value: F.create_map(F.lit(name), value)
    explicit = F.when(k % 3 == 0, one("model", F.col("c_name"))).when(k % 3 == 1, one("model", F.lit("")))
    own = F.map_concat(F.when(k % 2 == 0, one("model", F.lit("type model"))).otherwise(one("x", F.lit("y"))), F.when(k % 5 == 0, one("lang", F.lit("deu"))).otherwise(one("z", F.lit("y"))))
    preset = F.create_map(*map(F.lit, ("model", "preset model", "lang", "lat")))
    return table(spark, sf_dir, "customer").select("c_custkey", C.overlay(explicit, own, preset).alias("s")).select("c_custkey", F.col("s")["model"].alias("model"), F.col("s")["lang"].alias("lang"))


@query(r"""WITH b AS (SELECT item_id, regexp_split_to_array(strip_accents(lower(text)), '\s+') AS t, item_id AS k FROM benchmark), c AS (SELECT item_id, list_distinct(list_filter(t, lambda w: w <> '')) AS t, list_distinct(list_filter(t, lambda w: w <> '' AND length(w) % 3 <> 0)) AS a FROM b)
SELECT item_id, CASE WHEN length(CAST(item_id AS VARCHAR)) % 2 = 0 AND ends_with(CAST(item_id AS VARCHAR), '4') THEN NULL WHEN len(t) = 0 THEN 100.0 ELSE round(100 * len(list_intersect(t, a)) / len(t), 4) END AS accuracy,
  CASE WHEN length(CAST(item_id AS VARCHAR)) % 2 = 0 AND ends_with(CAST(item_id AS VARCHAR), '4') THEN 'ERROR: no answer' END AS error FROM c""")
def run_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of items that made-up answers have; some answers failed."""
    from quillon.functions.text import fold

    name = F.col("item_id").cast("string")
    failed = (F.length(name) % 2 == 0) & name.endswith("4")
    kept = F.array_join(F.filter(F.split(fold(F.col("text")), r"\s+"), lambda w: F.length(w) % 3 != 0), " ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.when(failed, "ERROR: no answer").otherwise(kept).alias("raw"))
    return C.run_accuracy(rows, ["item_id"], "raw", "text")


@query("""SELECT n_name, n_regionkey FROM nation WHERE n_name IN (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 3)""")
def corpus_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows by a list of names of which one is unknown."""
    nations = table(spark, sf_dir, "nation")
    names = [r["n_name"] for r in nations.orderBy(F.desc("n_nationkey")).limit(3).collect()]
    return C.chosen_corpora(nations, "n_name", names=[*names, "Atlantis"]).select("n_name", "n_regionkey")


@query(r"""WITH p AS (SELECT p_partkey, p_brand AS corpus, p_type || '/' || p_partkey || '.bin.png' AS path, p_name FROM part ORDER BY p_partkey LIMIT 100), u AS (SELECT *, regexp_replace(regexp_replace(corpus || '__' || regexp_replace(replace(path, '/', '_'), '\.[^.]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS id FROM p)
SELECT id, corpus, id || '.png' AS png, id || '.gt.txt' AS txt, p_name || chr(10) AS text FROM u""")
def ocr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred line pairs of a capped run."""
    path = F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".bin.png"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("corpus"), path.alias("path"), "p_name")
    return C.line_pairs(rows, "corpus", "path", "p_name", "path", "p_partkey", 100).select("id", "corpus", "png", "txt", "text")


@query("""WITH d AS (SELECT doc_id, source AS corpus, '/c/' || CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'cache' END || '/' || doc_id || '.xml' AS path, doc_id AS stem FROM documents),
m AS (SELECT DISTINCT corpus, dense_rank() OVER (ORDER BY corpus) % 3 AS k FROM d)
SELECT d.corpus, path AS xml, 'img/' || stem || '.png' AS image, CASE k WHEN 0 THEN 'train' WHEN 1 THEN CASE doc_id % 3 WHEN 0 THEN 'train' ELSE 'val' END ELSE 'holdout_pending' END AS split, k = 0 AS human_gt FROM d JOIN m ON m.corpus = d.corpus WHERE doc_id % 3 <> 2 AND doc_id % 5 <> 0""")
def corpus_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an image, of corpora with different split modes, caches left out."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    folder = F.when(k % 3 == 0, "train").when(k % 3 == 1, "test").otherwise("cache")
    listed = docs.select(F.col("source").alias("corpus"), F.concat(F.lit("/c/"), folder, F.lit("/"), k.cast("string"), F.lit(".xml")).alias("path"), k.alias("stem"))
    images = docs.where("doc_id % 5 <> 0").select(F.col("source").alias("corpus"), k.alias("stem"), F.concat(F.lit("img/"), k.cast("string"), F.lit(".png")).alias("path"))
    names = sorted(r["source"] for r in docs.select("source").distinct().collect())
    modes = [(n, {0: "train", 1: "upstream", 2: "holdout"}[(i + 1) % 3], "gt-mss" if (i + 1) % 3 == 0 else "htr") for i, n in enumerate(names)]
    registry = spark.createDataFrame(modes, "corpus string, split_mode string, source string").selectExpr("*", "array('lat') AS languages", "'medieval' AS era", "'Latn' AS script")
    return C.samples(listed, images, registry, ["cache"]).select("corpus", "xml", "image", "split", "human_gt")


@query("""WITH f AS (SELECT page_id, 'a' || page_id || '.xml' AS xml FROM pages), s AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'Cover.PNG' ELSE 'Img' || page_id || '.PNG' END AS name FROM pages WHERE page_id % 4 <> 0)
SELECT f.page_id AS folder, xml, CASE WHEN name IS NOT NULL AND f.page_id % 5 <> 0 THEN '/i/img' || f.page_id || '.png' END AS image, CASE WHEN name IS NULL THEN 'no sidecar' WHEN f.page_id % 5 = 0 THEN 'image not found' END AS problem FROM f LEFT JOIN s USING (page_id) WHERE coalesce(name, '') <> 'Cover.PNG'""")
def segmentation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with the images of their checksum files; covers are left out."""
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id")
    named = lambda a, b: F.concat(F.lit(a), k.cast("string"), F.lit(b))
    folders = rows.select(k.alias("folder"), named("a", ".xml").alias("xml")).unionByName(rows.select(k.alias("folder"), named("b", ".xml").alias("xml")))
    sidecars = rows.where("page_id % 4 <> 0").select(k.alias("folder"), F.when(k % 6 == 0, "Cover.PNG").otherwise(named("Img", ".PNG")).alias("name"))
    images = rows.where("page_id % 5 <> 0").select(named("img", ".png").alias("name"), named("/i/img", ".png").alias("path"))
    return C.segmentation_pairs(folders, sidecars, images, ["cover"])


@query("""SELECT source, count(*) FILTER (NOT d AND NOT f) AS ok, count(*) FILTER (d) AS skipped, count(*) FILTER (NOT d AND f) AS error FROM (SELECT source, doc_id % 4 = 0 AS d, coalesce(text, '') = '' OR contains(text, '|') AS f FROM documents) GROUP BY source""")
def conversion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return C.conversion_status(table(spark, sf_dir, "documents"), ["source"], F.col("doc_id") % 4 == 0, (text == "") | text.contains("|"))


@query("""SELECT doc_id, quality, length(text) AS n FROM documents JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels WHERE toxic = 0 GROUP BY doc_id) USING (doc_id)""")
def wanted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts that a manifest names."""
    manifest = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", "quality")
    found = C.wanted_texts(manifest, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return found.select("doc_id", "quality", F.length("text").cast("long").alias("n"))


@query(r"""WITH w AS (SELECT DISTINCT p_brand || ' ' || p_size AS name FROM part), l AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_size ELSE lower(p_brand) || '-' || p_size END AS name, 'd' || p_size AS dir FROM part WHERE p_size % 5 <> 0),
e AS (SELECT name, min(dir) AS v FROM l GROUP BY name), s AS (SELECT regexp_replace(lower(name), '[^\w]', '_', 'g') AS k, min(dir) AS v FROM l GROUP BY 1)
SELECT w.name, coalesce(e.v, s.v) AS dir, CASE WHEN e.v IS NOT NULL THEN 'name' WHEN s.v IS NOT NULL THEN 'slug' END AS how FROM w LEFT JOIN e ON e.name = w.name LEFT JOIN s ON s.k = regexp_replace(lower(w.name), '[^\w]', '_', 'g')""")
def slug_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against folders that are written as they are or as slugs."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    wanted = part.select(F.concat("p_brand", F.lit(" "), size).alias("name")).distinct()
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" "), size)).otherwise(F.concat(F.lower("p_brand"), F.lit("-"), size))
    listed = part.where("p_size % 5 <> 0").select(name.alias("name"), F.concat(F.lit("d"), size).alias("dir"))
    return C.by_name_or_slug(wanted, listed, "name", "dir")


@query("""WITH m AS (SELECT 'model ' || s_suppkey AS model, CASE s_suppkey % 3 WHEN 0 THEN 'en,de' WHEN 1 THEN '*' ELSE 'fr' END AS languages, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'early' END AS eras, (s_suppkey % 31) / 100.0::DOUBLE AS cer FROM supplier),
w AS (SELECT doc_id AS job_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'early' ELSE 'late' END AS era, CASE WHEN doc_id % 10 = 0 THEN 'model ' || (doc_id % 30) END AS want FROM documents WHERE lang IS NOT NULL),
j AS (SELECT job_id, model, cer, coalesce(want = model, false) AS own, list_contains(string_split(languages, ','), lang) AS nl, list_contains(string_split(eras, ','), era) AS ne FROM w JOIN m ON want = model OR ((languages = '' OR list_contains(string_split(languages, ','), '*') OR list_contains(string_split(languages, ','), lang)) AND (eras = '' OR list_contains(string_split(eras, ','), '*') OR list_contains(string_split(eras, ','), era)))),
b AS (SELECT job_id, arg_min({'m': model, 'o': own}, (-own::INT, -nl::INT, -ne::INT, cer, model)) AS k FROM j GROUP BY job_id) SELECT job_id, k.m AS model, CASE WHEN k.o THEN 'name' ELSE 'criteria' END AS how FROM b""")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of a registry by name, else by language and era."""
    k = F.col("s_suppkey")
    registry = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("model "), k.cast("string")).alias("name"), F.when(k % 3 == 0, "en,de").when(k % 3 == 1, "*").otherwise("fr").alias("languages"), F.when(k % 4 == 0, "").otherwise("early").alias("eras"), ((k % 31) / 100).alias("cer")
    )
    d = F.col("doc_id")
    wanted = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(d.alias("job_id"), "lang", F.when(d % 2 == 0, "early").otherwise("late").alias("era"), F.when(d % 10 == 0, F.concat(F.lit("model "), (d % 30).cast("string"))).alias("want"))
    return C.registry_lookup(wanted, registry)
