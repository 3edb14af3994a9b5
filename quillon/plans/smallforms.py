"""Small parsers and projections over the given tables: paths, names, years, labels, polygons, YAML, reports, whole evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import forms, protocol, text
from quillon.operators import evaluate as E
from quillon.operators import protocols as P
from quillon.operators import records as R
from quillon.operators.stylometry import let
from quillon.plans.registry import query, table
from quillon.sources import catalogues, files, layout, sinks


def _pick(key: Column, *values: str) -> Column:
    """One of some values by the remainder of a key."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _sql_pick(key: str, *values: str) -> str:
    return "(CASE " + key + f" % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


# Paths and names ---------------------------------------------------------------------------------------------------

#: Every web page as a file: a folder by its number, a name by its address, an ending.
_FILES = f"""f AS (SELECT page_id, '/data/' || {_sql_pick('page_id', 'in', 'Backup_1', 'train', 'old')} || '/' || (page_id % 7) AS folder, 'P' || (page_id // 3) AS stem, {_sql_pick('page_id', 'xml', 'PNG', 'txt')} AS e FROM pages),
g AS (SELECT page_id, folder || '/' || stem || '.' || e AS path, stem || '.' || e AS name, stem, lower(e) AS ext FROM f)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    stem, ending = F.concat(F.lit("P"), F.floor(k / 3).cast("string")), _pick(k, "xml", "PNG", "txt")
    name = F.concat(stem, F.lit("."), ending)
    folder = F.concat(F.lit("/data/"), _pick(k, "in", "Backup_1", "train", "old"), F.lit("/"), (k % 7).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(folder, F.lit("/"), name).alias("path"), name.alias("name"), stem.alias("stem"), F.lower(ending).alias("ext"))


@query(f"WITH {_FILES} SELECT x.stem, x.path, i.path AS other FROM g x JOIN g i ON i.stem = x.stem AND i.ext = 'png' WHERE x.ext = 'xml'")
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their images by stem."""
    found = _files(spark, sf_dir)
    return files.pair_by_stem(found.where("ext = 'xml'"), found.where("ext = 'png'"))[0]


@query(f"WITH {_FILES} SELECT x.stem FROM g x WHERE x.ext = 'xml' AND x.stem NOT IN (SELECT stem FROM g WHERE ext = 'txt' AND page_id % 2 = 0)")
def unpaired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a text of their stem, where every second text is there."""
    found = _files(spark, sf_dir)
    return files.pair_by_stem(found.where("ext = 'xml'"), found.where("ext = 'txt' AND page_id % 2 = 0"))[1]


@query(f"WITH {_FILES} SELECT stem, arg_min(path, (CASE ext WHEN 'png' THEN 1 ELSE 2 END, path)) AS path FROM g WHERE ext IN ('png', 'xml') GROUP BY stem")
def preferred_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.preferred(_files(spark, sf_dir), ["png", "xml"])


@query(f"WITH {_FILES} SELECT stem, arg_max(path, (page_id % 50, path)) AS path FROM g WHERE NOT regexp_matches(lower(path), '/(backup|bak|old)[^/]*/') GROUP BY stem")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest file of each stem outside of backups."""
    return files.latest(_files(spark, sf_dir).withColumn("modified", F.col("page_id") % 50))


@query(f"WITH {_FILES} SELECT lower(name) AS name, min(path) AS path FROM g GROUP BY 1")
def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.name_index(_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT page_id, contains(path, '/train/') OR contains(lower(path), 'backup') OR contains(lower(path), 'p1') AS skipped FROM g")
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with a skipped folder or token."""
    return _files(spark, sf_dir).select("page_id", files.excluded(F.col("path"), ["train"], ["backup", "p1"]).alias("skipped"))


@query(f"WITH {_FILES} SELECT sha256(path) AS digest, name FROM g")
def checksum_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a checksum file, in text and binary form."""
    lines = _files(spark, sf_dir).select(F.concat(F.sha2("path", 256), F.when(F.col("page_id") % 2 == 0, "  ").otherwise(" *"), "name").alias("line"))
    return files.checksum_names(lines, "line")


@query(f"WITH {_FILES} SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(path || '?!', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 20), ''), 'job') AS id FROM g")
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("page_id", text.safe_id(F.concat("path", F.lit("?!")), 20).alias("id"))


# Texts -------------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, nfc_normalize(regexp_replace(replace(chr(65279) || ' ' || text, chr(65279), ''), '^\s+|\s+$', '', 'g')) AS text FROM documents")
def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("raw", F.concat(F.lit("﻿ "), "text"))
    return rows.select("doc_id", forms.ocr_text(F.col("raw")).alias("text"))


@query("SELECT doc_id, replace(strip_accents(lower(text)), 'ß', 'ss') AS text FROM documents")
def tagger_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decomposed and case-folded texts without their marks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(forms.tagger_form(F.col("text")), r"\p{M}+", "").alias("text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '[^\x09\x0a\x0d\x20-\x7e\x{00A0}-\x{024F}\x{1E00}-\x{1EFF}]', ' ', 'g'), ' {3,}', '  ', 'g') AS text FROM documents")
def extracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", forms.extract_text(F.col("text")).alias("text"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), n AS (SELECT *, greatest(1, len(w) // 50) AS n FROM w), e AS (SELECT *, len(w) // n AS e FROM n)
SELECT doc_id, list_transform(range(n), lambda i: CAST(CASE WHEN i = n - 1 THEN len(w) - e * (n - 1) ELSE e END AS INTEGER)) AS sizes, list_transform(range(n), lambda i: w[e * i + 1]) AS heads FROM e
""")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of some fifty words: how many words each has, and its first."""
    # bound once, as every chunk would find the words of the text again
    chunks = let(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), lambda w: text.chunk_words(w, 50))
    rows = table(spark, sf_dir, "documents").select("doc_id", chunks.alias("c"))
    return rows.select("doc_id", F.transform("c", F.size).alias("sizes"), F.transform("c", lambda c: F.get(c, 0)).alias("heads"))


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations)
SELECT conv_id, turn, CAST(n AS INTEGER) AS number, regexp_replace(t, '\s+$', '') AS text FROM l
""")
def numbered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as numbered lines with a comment, read back."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 3, "0"), F.lit(": "), F.regexp_replace(x, r"\s+$", "")))
    content = F.concat(F.lit("# comment\n12: no number\n"), F.array_join(lines, "\r\n"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", content.alias("content"))
    return layout.numbered_lines(rows, ["conv_id", "turn"], "content")


@query(r"""
WITH o AS (SELECT o_orderkey, 'c. ' || year(o_orderdate) || CASE WHEN o_orderkey % 3 = 0 THEN '-17uu' WHEN o_orderkey % 3 = 1 THEN ' or ' || (year(o_orderdate) - 300) ELSE '?' END AS t, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1700 WHEN 1 THEN y - 300 ELSE y END AS INTEGER) AS first, CAST(CASE WHEN o_orderkey % 3 = 0 THEN greatest(y, 1799) ELSE y END AS INTEGER) AS last, CAST(y AS INTEGER) AS year FROM o
""")
def messy_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last year of a messy date, and its first number."""
    y, k = F.year("o_orderdate"), F.col("o_orderkey")
    more = F.when(k % 3 == 0, "-17uu").when(k % 3 == 1, F.concat(F.lit(" or "), (y - 300).cast("string"))).otherwise("?")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c. "), y.cast("string"), more).alias("t"))
    return rows.select("o_orderkey", text.parse_years(F.col("t")).alias("y"), forms.parse_year(F.col("t")).alias("year")).select("o_orderkey", "y.first", "y.last", "year")


# Answers and records -----------------------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END END AS label FROM events
""")
def closed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of fenced JSON answers, of plain ones, of sentences that hold a known one, and of answers without any."""
    k, kind = F.col("event_id"), F.col("event_type")
    known = ["view", "click", "purchase"]
    fenced = F.concat(F.lit('```json\n{"label": "'), kind, F.lit('"}\n```'))
    bare = F.concat(F.lit('{"label": "'), kind, F.lit('"}'))
    said = F.concat(F.lit("It is surely a "), F.upper(kind), F.lit("."))
    answer = F.when(k % 4 == 0, fenced).when(k % 4 == 1, bare).when(k % 4 == 2, said).otherwise("no idea")
    rows = table(spark, sf_dir, "events").select("event_id", answer.alias("a"), (k % 4 == 2).alias("open"))
    every = [r["event_type"] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").limit(50).collect()]  # kinds of events
    return rows.select("event_id", F.when(F.col("open"), protocol.closed_label(F.col("a"), known)).otherwise(protocol.closed_label(F.col("a"), every)).alias("label"))


@query("SELECT event_id, CASE WHEN value >= 90 THEN 'high' WHEN value >= 70 THEN 'medium' ELSE 'low' END AS tier, round(CASE event_id % 3 WHEN 0 THEN least(value, 50.0) / 100 WHEN 1 THEN (value + 10) / 200 ELSE 0.0 END, 6) AS confidence FROM events")
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of values, and a line's confidence from its characters, from its cuts, or from neither."""
    v, k = F.col("value"), F.col("event_id")
    none = F.array().cast("array<double>")
    chars = F.when(k % 3 == 0, F.array(v / 100, F.lit(0.5))).otherwise(none)
    cuts = F.when(k % 3 == 1, F.array(v / 100, F.lit(0.1))).otherwise(none)
    return table(spark, sf_dir, "events").select("event_id", protocol.confidence_tier(v / 100).alias("tier"), F.round(forms.line_confidence(chars, cuts), 6).alias("confidence"))


@query(f"""
WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'fast' WHEN 1 THEN 'OpenRouter/' || p_brand WHEN 2 THEN ' gemini-' || p_size WHEN 3 THEN 'gpt-' || p_size ELSE p_brand END AS r, p_brand, p_size FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'own' WHEN 1 THEN 'openrouter' WHEN 2 THEN 'gemini' WHEN 3 THEN 'openai' ELSE 'anthropic' END AS provider,
  CASE p_partkey % 5 WHEN 0 THEN 'small' WHEN 1 THEN p_brand ELSE trim(r) END AS model, CASE {_sql_pick('p_partkey', 'Latin', 'deu ', 'xx')} WHEN 'Latin' THEN 'LA' WHEN 'deu ' THEN 'DE' ELSE 'XX' END AS code FROM r
""")
def model_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers and models of references, and a translator's language codes."""
    k, brand, size = F.col("p_partkey"), F.col("p_brand"), F.col("p_size").cast("string")
    ref = F.when(k % 5 == 0, "fast").when(k % 5 == 1, F.concat(F.lit("OpenRouter/"), brand)).when(k % 5 == 2, F.concat(F.lit(" gemini-"), size)).when(k % 5 == 3, F.concat(F.lit("gpt-"), size)).otherwise(brand)
    code = forms.translation_code(_pick(k, "Latin", "deu ", "xx"), {"latin": "LA", "deu": "DE"})
    rows = table(spark, sf_dir, "part").select(k, forms.split_model(ref, {"fast": ("own", "small")}).alias("m"), code.alias("code"))
    return rows.select("p_partkey", "m.provider", "m.model", "code")


@query("SELECT doc_id, list_sort(list_distinct(list_filter([lower(coalesce(lang, '')), 'la', CASE WHEN doc_id % 2 = 0 THEN 'fr' ELSE lower(coalesce(lang, '')) END], lambda x: x <> ''))) AS languages, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN lang END), ''), source) AS named FROM documents")
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of several columns together, and the first field that says something."""
    k, lang = F.col("doc_id"), F.col("lang")
    languages = R.language_union(F.array_compact(F.array(F.concat(F.lit(" "), F.upper(lang)))), F.array(F.lit("la"), F.lit("")), F.when(k % 2 == 0, F.array(F.lit("FR"))))
    named = R.first_text(F.when(k % 3 == 0, " ").when(k % 3 == 1, lang), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", languages.alias("languages"), named.alias("named"))


@query("SELECT l_orderkey, l_linenumber, [l_quantity, -1.5::DOUBLE] AS xs, [round(l_discount * 100, 0), l_linenumber::DOUBLE] AS ys FROM lineitem")
def flat_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as pairs and as a flat list."""
    numbers = [F.col("l_quantity").cast("string"), F.round(F.col("l_discount") * 100, 0).cast("string"), F.lit("-1.5"), F.col("l_linenumber").cast("string")]
    pairs = F.concat(numbers[0], F.lit(","), numbers[1], F.lit(" "), numbers[2], F.lit(","), numbers[3])
    written = F.when(F.col("l_linenumber") % 2 == 0, pairs).otherwise(F.concat_ws(" ", *numbers))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", forms.flat_polygon(written).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))


@query(r"""
SELECT item_id, CASE WHEN item_id % 4 <> 3 THEN 'item ' || item_id END AS name, CASE WHEN item_id % 4 <> 3 THEN 'one [uncertain: a / b] ' || item_id END AS note, CASE WHEN item_id % 4 <> 3 THEN item_id % 4 = 0 END AS wrapped FROM benchmark
""")
def yaml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML documents with uncertain readings, with and without their wrapper, in a fence, and broken ones."""
    k = F.col("item_id").cast("string")
    body = lambda pad: F.concat(F.lit(f"{pad}metadata:\n{pad}  name: item "), k, F.lit(f"\n{pad}segments:\n{pad}  - text: one [uncertain: a / b] "), k, F.lit("\n"))
    at = F.col("item_id") % 4
    raw = F.when(at == 0, F.concat(F.lit("transcriptionOutput:\n"), body("  "))).when(at == 1, body("")).when(at == 2, F.concat(F.lit("```yaml\n"), body(""), F.lit("```"))).otherwise(": : :\n-")
    rows = table(spark, sf_dir, "benchmark").select("item_id", (at == 0).alias("w"), P.yaml_to_json(protocol.strip_fence(raw)).alias("j"))
    rows = rows.select("item_id", "w", P.root(F.col("j")).alias("r"))
    field = lambda path: F.get_json_object("r", path)
    return rows.select("item_id", field("$.metadata.name").alias("name"), field("$.segments[0].text").alias("note"), F.when(F.col("r").isNotNull(), F.col("w")).alias("wrapped"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def last_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value that a log holds for a user and kind."""
    log = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), "value")
    return sinks.latest_decisions(log, ["user_id", "event_type"], "at").select("user_id", "event_type", "value")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price, CASE WHEN o_orderstatus = 'O' THEN 'open' END AS error FROM orders")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of a batch: filled, open, and skipped ones."""
    rows = table(spark, sf_dir, "orders")
    side = lambda s, *more: rows.where(F.col("o_orderstatus") == s).select("o_orderkey", *more)
    rest = rows.where(~F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")
    found = sinks.batch_rows(side("F", F.col("o_totalprice").alias("price")), side("O", F.lit("open").alias("error")), rest, "o_orderkey")
    return found.select("o_orderkey", "status", "price", "error")


@query("SELECT p_partkey, p_size AS n_baselines, (SELECT greatest(1, max(p_size)) FROM part WHERE p_partkey % 3 <> 0 AND p_size >= 10) AS max_lines FROM part WHERE p_partkey % 3 <> 0 AND p_size >= 10")
def pages_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with baselines and an image, and the most lines of one."""
    part = table(spark, sf_dir, "part")
    pages = part.select("p_partkey", F.when(F.col("p_size") >= 10, F.col("p_size")).otherwise(0).alias("n_baselines"))
    rows, most = R.usable_pairs(pages, "p_partkey", "n_baselines", part.where("p_partkey % 3 <> 0").select("p_partkey"))
    return rows.select("p_partkey", "n_baselines", F.lit(most.first()["max_lines"]).alias("max_lines"))


@query("SELECT page_id, octet_length(encode(html)) AS n_bytes, CAST(len(string_split(url, '/')) AS BIGINT) AS n_lines FROM pages WHERE html <> ''")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as images with lines in one of two columns."""
    parts = F.split("url", "/")
    rows = table(spark, sf_dir, "pages").select("page_id", F.struct(F.encode("html", "UTF-8").alias("bytes")).alias("image"), F.when(F.col("page_id") % 2 == 0, parts).alias("a"), parts.alias("b"))
    return catalogues.image_lines(rows, ["page_id"], "image", "a", "b").select("page_id", "n_bytes", "n_lines")


@query(r"""
WITH p AS (SELECT conv_id, turn, replace(strip_accents(lower(text)), 'ß', 'ss') AS t FROM conversations), q AS (SELECT *, replace(t, 'en', 'n') AS g FROM p),
w AS (SELECT *, len(string_split(t, ' ')) AS n, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(g, '\s+'), lambda x: x <> '') AS b FROM q),
e AS (SELECT *, len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS d FROM w)
SELECT count(*) AS n_lines, round(sum(levenshtein(t, g)) / greatest(sum(length(t)), 1), 6) AS cer, round(sum(CASE WHEN len(a) > 0 THEN round(100 * d / len(a), 4) ELSE 0 END * n / 100) / greatest(sum(n), 1), 6) AS wer FROM e
""")
def whole_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character and word errors over all turns, a letter left out of some of their words."""
    truth = text.ascii_edit_form(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select(truth.alias("truth")).withColumn("guess", F.replace("truth", F.lit("en"), F.lit("n")))
    return E.evaluation(rows, None, "page").select("n_lines", "cer", "wer")
