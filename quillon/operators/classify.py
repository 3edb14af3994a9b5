"""Lexicon and structural evidence, softmax over labels, boundaries, keyword and title tagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import fold, tokens
from quillon.operators.stylometry import let, occurrences

PRIOR = 0.05


def lexicon_scores(words: Column, lexicon: dict[str, dict[str, float]]) -> Column:
    """Array of ``label, score`` for an array column of words: sum of w * (1 + ln count) over the label's terms, over
    sqrt(n / 80). The lexicon is fixed and small, so it is part of the expression and nothing is joined."""
    return let(words, lambda w: let(term_places(w, lexicon), lambda hits: _scored(w, hits, lexicon)))


def term_places(words: Column, lexicon: dict[str, dict[str, float]]) -> Column:
    """Of every word that is a term its place among all terms in letter order, found in one pass over the words."""
    listed = F.array(*map(F.lit, sorted({t for terms in lexicon.values() for t in terms}))).cast("array<string>")
    return F.filter(F.transform(words, lambda w: F.array_position(listed, w)), lambda p: p > 0)


def _scored(words: Column, hits: Column, lexicon: dict[str, dict[str, float]]) -> Column:
    n = F.sqrt(F.greatest(F.size(words), F.lit(1)) / F.lit(80.0))
    place = {t: i for i, t in enumerate(sorted({t for terms in lexicon.values() for t in terms}), 1)}

    def term(word: str, weight: float) -> Column:
        return let(
            F.size(F.filter(hits, lambda p: p == place[word])),
            lambda n: F.when(n > 0, weight * (1 + F.log(n.cast("double")))).otherwise(F.lit(0.0)),
        )

    out = []
    for label, terms in sorted(lexicon.items()):
        parts = [term(w, x) for w, x in sorted(terms.items())]
        out.append(F.struct(F.lit(label).alias("label"), (sum(parts[1:], parts[0]) / n).alias("score")))
    return F.array(*out)


def lexicon_evidence(docs: DataFrame, keys: list[str], text_col: str, lexicon: dict) -> DataFrame:
    scores = let(tokens(F.col(text_col)), lambda w: lexicon_scores(w, lexicon))
    rows = docs.select(*keys, F.explode_outer(scores).alias("s"))
    return rows.select(*keys, "s.label", F.round("s.score", 6).alias("score"))


def softmax(scores: Column) -> Column:
    """``label, score`` array to ``label, prob`` array, shifted by the maximum, with a light prior on every label."""
    top = F.array_max(F.transform(scores, lambda s: s["score"]))

    def spread(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0.0), lambda t, p: t + p["e"])
        return F.transform(parts, lambda p: F.struct(p["label"].alias("label"), (p["e"] / total).alias("prob")))

    raised = F.transform(scores, lambda s: F.struct(s["label"].alias("label"), F.exp(s["score"] - top).alias("e")))
    return let(raised, spread)


def label_probs(docs: DataFrame, keys: list[str], text_col: str, lexicon: dict) -> DataFrame:
    """``keys, probs``: array of label and probability in label order."""
    scores = let(tokens(F.col(text_col)), lambda w: lexicon_scores(w, lexicon))
    return docs.select(*keys, let(scores, softmax).alias("probs"))


def structural_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Line and digit densities of a text, clipped to 0-1 with their weights where the rule clips."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0
    )
    clip = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    sizes = F.transform(lines, lambda x: F.size(F.split(x, r"\s+")))
    row = docs.select(
        id_col,
        F.greatest(F.size(lines), F.lit(1)).alias("n"),
        F.size(F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 3)).alias("pipes"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[0-9]+")).alias("digits"),
        F.greatest(F.size(tokens(F.col(text_col))), F.lit(1)).alias("words"),
        F.aggregate(sizes, F.lit(0), lambda a, b: a + b).alias("all"),
        F.size(F.filter(sizes, lambda s: (s >= 3) & (s <= 9))).alias("short"),
    )
    n = F.col("n")
    return row.select(
        id_col,
        F.round(clip(F.col("pipes") / n * 2.0), 6).alias("table_density"),
        F.round(clip(F.col("digits") / F.col("words") * 18.0), 6).alias("digit_density"),
        F.round(F.when(n >= 6, F.col("short") / n).otherwise(F.lit(0.0)), 6).alias("short_lines"),
        F.round(clip((10 - F.col("all") / n) / 8), 6).alias("low_line_length"),
    )


def _majority(values: Column) -> Column:
    """Most frequent element; on ties the one seen first."""
    count = lambda v: F.size(F.filter(values, lambda x: x == v))
    ranked = F.transform(values, lambda v, i: F.struct((-count(v)).alias("c"), i.alias("i"), v.alias("v")))
    return F.array_min(ranked)["v"]


def boundaries(segments: DataFrame, doc_col: str, order_col: str, window: int, delta: float) -> DataFrame:
    """Segments (``doc, order, probs``) at which the label changes: against the segment before with both sure
    enough, or between the majorities of the ``window`` segments before and from here on by ``delta`` in mean probability.
    """
    best = F.array_min(F.transform("probs", lambda p: F.struct((-p["prob"]).alias("n"), p["label"].alias("label"))))
    rows = segments.select(doc_col, order_col, "probs", best["label"].alias("best"), (-best["n"]).alias("sure"))
    w = Window.partitionBy(doc_col).orderBy(order_col)
    frames = [("prev", w.rowsBetween(-window, -1)), ("cur", w.rowsBetween(0, window - 1))]
    rows = rows.withColumns({k: F.collect_list(F.struct("best", "probs")).over(f) for k, f in frames})
    rows = rows.withColumns({"last_best": F.lag("best").over(w), "last_sure": F.lag("sure").over(w)})

    def mean_of(side: str, label: Column) -> Column:
        prob = lambda s: F.aggregate(s["probs"], F.lit(0.0), lambda a, p: a + F.when(p["label"] == label, p["prob"]).otherwise(0.0))
        return F.aggregate(side, F.lit(0.0), lambda a, s: a + prob(s)) / F.size(side)

    tops = {f"{k}_top": _majority(F.transform(k, lambda s: s["best"])) for k in ("prev", "cur")}
    rows = rows.where(F.size("prev") > 0).withColumns(tops)
    gap = F.abs(mean_of("cur", F.col("cur_top")) - mean_of("prev", F.col("prev_top")))
    adjacent = (F.col("last_best") != F.col("best")) & (F.least("last_sure", "sure") >= max(0.01, delta))
    return rows.where(adjacent | ((F.col("prev_top") != F.col("cur_top")) & (gap >= delta))).select(doc_col, order_col)


def keyword_tags(docs: DataFrame, id_col: str, text_col: str, categories: dict[str, dict[str, float]]) -> DataFrame:
    """Weighted keyword counts per category (single words as words, several as phrases), the dominant category (the
    first of the largest; null without hits) and the density per 1000 words."""
    text = F.coalesce(fold(F.col(text_col)), F.lit(""))
    row = docs.select(id_col, text.alias("t"), tokens(F.col(text_col)).alias("w"))

    def count(key: str) -> Column:
        if " " in key:
            return ((F.length("t") - F.length(F.replace("t", F.lit(key), F.lit("")))) / len(key)).cast("int")
        return occurrences("w", key)

    scores = {}
    for name, keys in categories.items():
        parts = [count(k) * v for k, v in keys.items()]
        scores[name] = sum(parts[1:], parts[0])
    row = row.select(id_col, F.size("w").alias("n"), *[v.cast("double").alias(k) for k, v in scores.items()])
    names = list(categories)
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    dominant = F.lit(None).cast("string")
    for name in reversed(names):
        dominant = F.when(F.col(name) == top, name).otherwise(dominant)
    total = sum((F.col(x) for x in names[1:]), F.col(names[0]))
    return row.select(
        id_col,
        *[F.round(x, 4).alias(f"score_{x}") for x in names],
        F.when(top > 0, dominant).alias("dominant"),
        F.round(total / F.greatest("n", F.lit(1)) * 1000, 4).alias("density"),
    )


def keyword_hits(docs: DataFrame, id_col: str, text_col: str, categories: dict[str, dict[str, float]], most: int = 20) -> DataFrame:
    """``id, place, keyword, category, weight, n``: the hits of a text, heaviest keywords first, then the most telling, then by name."""
    text = F.coalesce(fold(F.col(text_col)), F.lit(""))
    row = docs.select(id_col, text.alias("t"), tokens(F.col(text_col)).alias("w"))
    hits = []
    for category, keys in categories.items():
        for key, weight in keys.items():
            n = ((F.length("t") - F.length(F.replace("t", F.lit(key), F.lit("")))) / len(key)).cast("int") if " " in key else occurrences("w", key)
            hits.append(F.struct(F.lit(-float(weight)).alias("h"), (n * -float(weight)).alias("x"), F.lit(key).alias("keyword"), F.lit(category).alias("category"), n.cast("long").alias("n")))
    found = F.slice(F.array_sort(F.filter(F.array(*hits), lambda h: h["n"] > 0)), 1, most)
    rows = row.select(id_col, F.posexplode(found).alias("place", "h"))
    return rows.select(id_col, F.col("place").cast("long").alias("place"), "h.keyword", "h.category", (-F.col("h.h")).alias("weight"), "h.n")


def title_label(title: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Label of the first rule of which a key is contained in the folded title, else null."""
    folded, out = fold(title), F.lit(None).cast("string")
    for label, keys in reversed(rules):
        hit = F.lit(False)
        for key in keys:
            hit = hit | folded.contains(key)
        out = F.when(hit, label).otherwise(out)
    return out
