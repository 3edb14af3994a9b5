"""Records of corpora: labels from names, alternatives among columns, manifests, queues, splits, model records, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.forms import parse_year, title_form
from quillon.functions.text import fold, safe_id
from quillon.operators.classify import title_label
from quillon.operators.curate import hash_order, split_rows
from quillon.operators.records import first_text

def label_from_name(name: Column, labels: list[str]) -> Column:
    """The longest label that a file name starts with, or null."""
    out = F.lit(None).cast("string")
    for label in sorted(labels, key=lambda x: (len(x), x)):
        out = F.when(name.startswith(label), label).otherwise(out)
    return out


def remap(label: Column, mapping: dict[str, str]) -> Column:
    """A label's coarser one; labels outside the mapping become null."""
    out = F.lit(None).cast("string")
    for old, new in mapping.items():
        out = F.when(label == old, new).otherwise(out)
    return out


def first_int(*columns: Column) -> Column:
    """The first column that is a whole number, else 0."""
    return F.coalesce(*[c.try_cast("int") for c in columns], F.lit(0))


def speaks(code: str, *columns: Column) -> Column:
    """Whether one of several language columns contains a code, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(code.lower())), F.lit(False))
    return hit


def manifest_rows(rows: DataFrame, *, script: str | None = None, corpora: list[str] | None = None, excluded: list[str] | None = None, val_corpora: list[str] | None = None) -> DataFrame:
    """Rows (``corpus, script, xml, split``) of a manifest with ``part``: val for validation corpora and val rows, train for train
    rows (also those without a split); rows of other splits or without a document are left out."""
    keep = F.coalesce(F.col("xml"), F.lit("")) != ""
    if script is not None:
        keep = keep & (F.col("script") == script)
    if corpora is not None:
        keep = keep & F.col("corpus").isin(corpora)
    if excluded:
        keep = keep & ~F.coalesce(F.col("corpus").isin(excluded), F.lit(False))
    split = F.coalesce("split", F.lit("train"))
    val = F.coalesce(F.col("corpus").isin(val_corpora or []), F.lit(False)) | (split == "val")
    return rows.where(keep).withColumn("part", F.when(val, "val").when(split == "train", "train")).where("part IS NOT NULL")


def manifest_stats(rows: DataFrame, corpus: str, part: str) -> DataFrame:
    """Rows of each corpus in each part."""
    return rows.groupBy(corpus).pivot(part, ["train", "val"]).count().na.fill(0, ["train", "val"])


def first_existing(rows: DataFrame, keys: list[str], candidates: str, listing: DataFrame, path: str) -> DataFrame:
    """``keys, path``: of an array of candidate paths the first that is listed; rows without one are left out."""
    tried = rows.select(*keys, F.posexplode(candidates).alias("place", path)).where(F.col(path).isNotNull())
    found = tried.join(listing.select(path).distinct(), path)
    return found.groupBy(*keys).agg(F.min(F.struct("place", path))[path].alias(path))


def rewritten(raw: Column, folder: Column, prefixes: list[tuple[str, str]]) -> Column:
    """Candidates for a path in a document: as written, beside the document, with each prefix rewritten."""
    beside = F.when(~raw.startswith("/"), F.concat(folder, F.lit("/"), raw))
    moved = [F.when(raw.contains(old), F.replace(raw, F.lit(old), F.lit(new))) for old, new in prefixes]
    return F.array(raw, beside, *moved)


def layer_text(segment: Column, layer: str = "diplomatic") -> Column:
    """Text of a segment (JSON): of the normalised layer the first of its names, a string or an object with a text, where asked
    for; else the text as transcribed."""
    plain = F.coalesce(first_text(F.get_json_object(segment, "$.text"), F.get_json_object(segment, "$.transcription")), F.lit(""))
    if layer != "normalized":
        return plain
    names = ("normalizedLayer", "normalized", "normalized_text", "expanded")
    each = []
    for name in names:
        value = F.get_json_object(segment, f"$.{name}")
        inner = first_text(F.get_json_object(segment, f"$.{name}.text"), F.get_json_object(segment, f"$.{name}.transcription"))
        each.append(F.when(value.startswith("{"), inner).otherwise(first_text(value)))
    return F.coalesce(*each, plain)


def review_order(rows: DataFrame, order: str, *, cer: str | None = None, confidence: str | None = None) -> DataFrame:
    """``place`` in a review queue: by error rate (none and 0 count as 1), or by falling confidence; stable.

    The queue is a report; a caller that wants its head takes it with ``orderBy`` and ``limit``.
    """
    key = F.coalesce(F.nullif(F.col(cer), F.lit(0.0)), F.lit(1.0)) if cer else -F.coalesce(F.col(confidence), F.lit(0.0))
    return rows.withColumn("queue_key", key).orderBy("queue_key", order)


def filter_stats(rows: DataFrame, tier: str, promoted: str) -> DataFrame:
    """Rows in all, of each tier, and of those that a rare character promoted."""
    n = lambda name: F.count_if(F.col(tier) == name).alias(name)
    return rows.agg(F.count("*").alias("total"), n("confident"), n("review"), n("low"), F.count_if(promoted).alias("rare_promoted"))


def first_lines(rows: DataFrame, key: list[str], text: str, order: str, least_chars: int) -> DataFrame:
    """The first row (by ``order``) of every key whose text is long enough."""
    kept = rows.where(F.length(F.trim(text)) >= least_chars)
    rest = [c for c in rows.columns if c not in key]
    return kept.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*")


def global_split(rows: DataFrame, key: str, share: float = 0.95, seed: str = "split") -> DataFrame:
    """``key, split``: the whole part of n * share rows for training, in a hash order of the table."""
    one = rows.select(F.lit("all").alias("all"), key, hash_order(seed, F.col(key)).alias("h")).withColumn("bin", F.left("h", F.lit(3)))
    sizes = one.groupBy("bin").count()
    w = Window.orderBy("bin")  # 4096 rows at most
    bins = sizes.select("bin", F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy("h", key))
    ranked = one.withColumn("place", place).join(F.broadcast(bins), "bin")
    return ranked.select(key, F.when(F.col("before") + F.col("place") <= F.floor(F.col("n") * share), "train").otherwise("val").alias("split"))


def pair_split(rows: DataFrame, group: str, key: str, share: float, seed: str = "pairs") -> DataFrame:
    """``group, key, split``: the whole part of n * share (one at least) for validation; groups of one are training rows."""
    drawn = split_rows(rows, group, key, share, seed=seed, singletons="val")
    alone = rows.groupBy(group).count().where("count = 1").select(F.col(group).alias("_g"))
    met = drawn.join(alone, drawn[group].eqNullSafe(alone["_g"]), "left")
    return met.select(group, key, F.when(F.col("_g").isNotNull(), "train").otherwise(F.col("split")).alias("split"))


def best_cer(val_cer: Column, per_corpus: Column) -> Column:
    """Smallest known error rate of a model: its own and those of corpora; null without any."""
    return F.array_min(F.filter(F.concat(F.array(val_cer), F.coalesce(F.map_values(per_corpus), F.array().cast("array<double>"))), lambda v: v.isNotNull()))


def batch_groups(rows: DataFrame, suggested: str, path: str, examples: int = 3) -> DataFrame:
    """Files of a batch by suggested type, those without one together: how many, and the first few names."""
    names = F.min(path).alias("first")
    return rows.groupBy(suggested).agg(F.count("*").alias("n_files"), names)


def timing_report(rows: DataFrame, run: str, stage: str, seconds: str, began: str, ended: str, serial: str) -> DataFrame:
    """Per run the wall time, the sum of one stage, and how many times the wall time that stage took alone."""
    wall = F.max(ended) - F.min(began)
    sums = rows.groupBy(run).agg(wall.alias("wall"), F.sum(F.when(F.col(stage) == serial, F.col(seconds)).otherwise(0.0)).alias("serial"), F.count("*").alias("n"))
    return sums.select(run, F.col("n").alias("n_rows"), F.round("wall", 3).alias("wall"), F.round("serial", 3).alias("serial"), F.when(F.col("wall") > 0, F.round(F.col("serial") / F.col("wall"), 3)).alias("efficiency"))


def token_usage(usage: Column, names: dict[str, list[str]]) -> list[Column]:
    """Input, output and total of a provider's usage map; of several names for one of them the values are added."""
    part = {k: sum((F.coalesce(F.element_at(usage, n), F.lit(0)) for n in v), F.lit(0)).cast("long") for k, v in names.items()}
    return [*(c.alias(k) for k, c in part.items()), sum(part.values(), F.lit(0)).cast("long").alias("total_tokens")]


def title_genre(title: Column, rules: list[tuple[str, list[str]]], *, author: Column | None = None, authors: list[tuple[list[str], str]] = (), year: Column | None = None, years: tuple[int, int] | None = None) -> Column:
    """Label of the first title rule that holds, else of the first author rule (over author and title), else null; with ``years``
    null for works outside the period or without a year."""
    out = F.lit(None).cast("string")
    whole = F.lower(F.concat_ws(" ", F.coalesce(author, F.lit("")) if author is not None else F.lit(""), F.coalesce(title, F.lit(""))))
    for names, genre in reversed(list(authors)):
        hit = F.lit(False)
        for name in names:
            hit = hit | whole.contains(name)
        out = F.when(hit, genre).otherwise(out)
    out = F.coalesce(title_label(title_form(F.coalesce(title, F.lit(""))), rules), out)
    if years is not None:
        y = parse_year(year)
        out = F.when((y >= years[0]) & (y <= years[1]), out)
    return out


def tag_records(rows: DataFrame, rules: list[tuple[str, list[str]]], *, genre: str = "genre", title: str = "title", fallbacks: tuple[str, ...] = (), overwrite: bool = False, **more) -> DataFrame:
    """Rows with ``genre`` filled from the title, or from the first other column that is not blank; a genre that is there stays
    unless overwritten, and one that is not found changes nothing."""
    named = first_text(F.col(title), *[F.col(c).cast("string") for c in fallbacks if c in rows.columns])
    found = title_genre(named, rules, **more)
    own = F.nullif(F.col(genre), F.lit(""))
    return rows.withColumn(genre, F.coalesce(found, own) if overwrite else F.coalesce(own, found))


def model_choices(budget: DataFrame, premium: DataFrame, provider: str, model: str, free_only: bool = False) -> DataFrame:
    """Distinct ``provider, model`` of both lists, or of the budget list alone, in order."""
    both = budget.select(provider, model) if free_only else budget.select(provider, model).unionByName(premium.select(provider, model))
    return both.distinct().orderBy(provider, model)


def presets(rows: DataFrame, key: str, priority: str, order: str) -> DataFrame:
    """Per key the row of the largest priority, of equal ones the last in order; rows without a preset are left out."""
    kept = rows.where(F.col("preset").isNotNull())
    best = F.max_by(F.struct("name", "preset"), F.struct(F.coalesce(priority, F.lit(0)), F.col(order)))
    return kept.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def overlay(explicit: Column, *layers: Column) -> Column:
    """Settings (maps of strings): explicit ones win, then each layer fills in what is not set; blank values are not set."""
    none = F.from_json(F.lit("{}"), "map<string,string>")
    out = F.map_filter(F.coalesce(explicit, none), lambda k, v: v.isNotNull() & (v != ""))

    def below(top: Column, layer: Column) -> Column:
        return F.map_concat(top, F.map_filter(F.coalesce(layer, none), lambda k, v: v.isNotNull() & ~F.map_contains_key(top, k)))

    for layer in layers:
        out = below(out, layer)
    return out


def run_accuracy(answers: DataFrame, keys: list[str], raw: str, truth: str) -> DataFrame:
    """``keys, accuracy, error``: share of the truth's words that a run's answer has, in percent; failed answers keep their error."""
    failed = F.col(raw).startswith("ERROR:")
    words = lambda c: F.array_distinct(F.filter(F.split(fold(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != ""))
    rows = answers.select(*keys, F.when(failed, F.left(raw, F.lit(120))).alias("error"), words(raw).alias("a"), words(truth).alias("t"))
    share = F.when(F.size("t") > 0, F.round(100 * F.size(F.array_intersect("a", "t")) / F.size("t"), 4)).otherwise(F.lit(100.0))
    return rows.select(*keys, F.when(F.col("error").isNull(), share).alias("accuracy"), "error")


def chosen_corpora(registry: DataFrame, name: str, *, profile: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Registry rows in the order of ``names``, else of a profile, else by name; unknown names are left out."""
    wanted = names or profile
    if wanted is None:
        return registry.withColumn("place", F.lit(0)).orderBy(name)
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col(name))
    return registry.withColumn("place", place.cast("int")).where(F.col("place") > 0).orderBy("place")


def line_pairs(pairs: DataFrame, corpus: str, path: str, text: str, image: str, order: str, most: int | None = None) -> DataFrame:
    """Manifest rows of OCR line pairs: ``id, corpus, image_src, png, txt, text``; ``most`` is the feature of a capped run and takes the
    first in order."""
    stem = F.regexp_replace(F.replace(F.col(path), F.lit("/"), F.lit("_")), r"\.[^.]*$", "")
    uid = safe_id(F.concat(F.col(corpus), F.lit("__"), stem), 220)
    rows = pairs.select(order, uid.alias("id"), corpus, F.col(image).alias("image_src"), F.concat(uid, F.lit(".png")).alias("png"), F.concat(uid, F.lit(".gt.txt")).alias("txt"), F.concat(text, F.lit("\n")).alias("text"))
    return rows.orderBy(order).limit(most) if most is not None else rows


def samples(listed: DataFrame, images: DataFrame, registry: DataFrame, skipped: list[str]) -> DataFrame:
    """Samples of corpora: documents (``corpus, path, stem``) outside skipped folders that have an image of their stem, with the
    registry's languages, era, script, source and split; rows of human ground truth are marked."""
    kept = listed.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skipped)))) if skipped else listed
    im = images.groupBy("corpus", "stem").agg(F.min("path").alias("image"))
    parts = F.split(F.lower("path"), "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    upstream = F.when(has("test", "val"), "val").when(has("train"), "train")
    mode = F.col("split_mode")
    split = F.when(mode == "train", "train").when(mode == "val_only", "val").when((mode == "upstream") & upstream.isNotNull(), upstream).otherwise("holdout_pending")
    rows = kept.join(im, ["corpus", "stem"]).join(registry, "corpus")
    return rows.select("corpus", F.col("path").alias("xml"), "image", split.alias("split"), "languages", "era", "script", "source", (F.col("source") == "gt-mss").alias("human_gt"))


def segmentation_pairs(folders: DataFrame, sidecars: DataFrame, images: DataFrame, ignored: list[str]) -> DataFrame:
    """``folder, xml, image, problem``: every folder's first document with the image its checksum file names (whatever the case);
    images that are no manuscripts are left out, missing sidecars and images are told."""
    first = folders.groupBy("folder").agg(F.min("xml").alias("xml"))
    im = images.groupBy(F.lower("name").alias("key")).agg(F.min("path").alias("image"))
    rows = first.join(sidecars.select("folder", "name"), "folder", "left").withColumn("key", F.lower("name")).join(im, "key", "left")
    stem = F.regexp_replace("key", r"\.[^.]*$", "")
    problem = F.when(F.col("name").isNull(), "no sidecar").when(F.col("image").isNull(), "image not found")
    return rows.where(~F.coalesce(stem.isin(ignored), F.lit(False))).select("folder", "xml", "image", problem.alias("problem"))


def conversion_status(rows: DataFrame, by: list[str], done: Column, failed: Column) -> DataFrame:
    """How many conversions went well, were skipped because their result is there, and failed."""
    return rows.groupBy(*by).agg(F.count_if(~done & ~failed).alias("ok"), F.count_if(done).alias("skipped"), F.count_if(~done & failed).alias("error"))


def wanted_texts(manifest: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Texts that a manifest names, with the manifest's columns."""
    return texts.join(manifest.dropDuplicates([key]), key)


def by_name_or_slug(wanted: DataFrame, listed: DataFrame, name: str, value: str) -> DataFrame:
    """``name, value, how``: of the same name, else of the same slug (lower case, other than word characters as underscores)."""
    slug = lambda c: F.regexp_replace(F.lower(c), r"[^\w]", "_")
    exact = listed.groupBy(F.col(name).alias("_n")).agg(F.min(value).alias("_v"))
    loose = listed.groupBy(slug(F.col(name)).alias("_s")).agg(F.min(value).alias("_w"))
    rows = wanted.join(exact, F.col(name) == F.col("_n"), "left").join(loose, slug(F.col(name)) == F.col("_s"), "left")
    how = F.when(F.col("_v").isNotNull(), "name").when(F.col("_w").isNotNull(), "slug")
    return rows.select(name, F.coalesce("_v", "_w").alias(value), how.alias("how"))


def registry_lookup(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """``job_id, model, how``: the model of the wanted name, else the best that covers language and era (a named language
    first, then a named era, then the smaller error rate, then the name).

    A registry may be of any size: of each pair of a named language (or any) and a named era (or any) only the best model is kept, and
    every language and era that is asked for meets the four pairs that cover it.
    """
    models = registry.select(F.col("name").alias("model"), "languages", "eras", F.coalesce("cer", F.lit(1e9)).alias("c"))

    def kinds(values: str, named: str, kind: str) -> Column:
        """A row for every value of a comma list (named 1), and one (named 0) if it covers all."""
        parts = F.split(values, ",")
        every = (F.col(values) == "") | F.array_contains(parts, "*")
        said = F.transform(F.array_distinct(parts), lambda v: F.struct(F.lit(1).alias(named), v.alias(kind)))
        return F.when(every, F.concat(said, F.array(F.struct(F.lit(0).alias(named), F.lit("").alias(kind))))).otherwise(said)

    held = models.select("model", "c", "eras", F.explode(kinds("languages", "nl", "lk")).alias("l")).select("model", "c", "l", F.explode(kinds("eras", "ne", "ek")).alias("e"))
    best = held.groupBy("l.nl", "l.lk", "e.ne", "e.ek").agg(F.min(F.struct("c", "model")).alias("m"))
    either = lambda c, named, kind: F.array_compact(F.array(F.when(F.col(c).isNotNull(), F.struct(F.lit(1).alias(named), F.col(c).alias(kind))), F.struct(F.lit(0).alias(named), F.lit("").alias(kind))))
    asked = wanted.select("lang", "era").distinct()
    asked = asked.select("*", F.explode(either("lang", "nl", "lk")).alias("l")).select("lang", "era", "l", F.explode(either("era", "ne", "ek")).alias("e")).select("lang", "era", "l.*", "e.*")
    key = lambda own: F.struct(F.lit(-own).alias("o"), (-F.col("nl")).alias("l"), (-F.col("ne")).alias("e"), F.col("m.c").alias("c"), F.col("m.model").alias("model"))
    chosen = asked.join(best, ["nl", "lk", "ne", "ek"]).groupBy("lang", "era").agg(F.min(key(0)).alias("k"))
    chosen = chosen.select(F.col("lang").alias("_lang"), F.col("era").alias("_era"), "k")
    covered = wanted.join(chosen, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("era").eqNullSafe(F.col("_era"))).select("job_id", "k")
    own = F.struct(F.lit(-1).alias("o"), F.lit(0).alias("l"), F.lit(0).alias("e"), F.lit(0.0).alias("c"), F.col("model"))
    named = wanted.where(F.col("want").isNotNull()).join(models.select("model").distinct(), F.col("want") == F.col("model")).select("job_id", own.alias("k"))
    found = covered.unionByName(named).groupBy("job_id").agg(F.min("k").alias("k"))
    return found.select("job_id", F.col("k.model").alias("model"), F.when(F.col("k.o") == -1, "name").otherwise("criteria").alias("how"))
