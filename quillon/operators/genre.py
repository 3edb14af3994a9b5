"""Genre of a document: lexicon, structural and Delta evidence, their combination, segments and the whole signal.

Every text is measured where it is read; lexicons, vocabularies and reference frequencies are of fixed size and become
constants of the expressions, so nothing is joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.forms import delta_tokens, genre_form
from quillon.functions.text import tokens
from quillon.operators.classify import lexicon_scores, term_places
from quillon.operators.stylometry import feature_shares, let

PRIOR, DELTA_WEIGHT = 0.05, 2.0
MOST_MATCHES, MOST_EVIDENCE, SEGMENT_EVIDENCE, SEGMENT_PROBS = 18, 40, 5, 5

#: Label, feature, measure, factor and weight of the nine structural features (fixed values).
STRUCTURE = [
    ("computus_calendar", "table_pipe_density", "pipes", 2.0, 4.0),
    ("computus_calendar", "calendar_month_density", "months", 80.0, 3.2),
    ("computus_calendar", "numeric_table_density", "digits", 18.0, 2.8),
    ("astronomical_technical", "numeric_table_density", "digits", 12.0, 1.8),
    ("astronomical_technical", "diagram_or_table_layout", "pipes", 1.4, 1.3),
    ("legal_charter", "charter_formula_starters", "starters", 1 / 3, 3.8),
    ("theological_scholastic", "scholastic_question_markers", "questions", 1 / 4, 3.5),
    ("verse_poetry", "short_regular_lines", "short", 1.0, 2.4),
    ("verse_poetry", "low_average_line_length", "brevity", 1.0, 1.2),
]


@dataclass(frozen=True)
class Vocabulary:
    """What the structural measures look for: month prefixes of three letters, words that open charters, words of questions."""

    months: list[str] = field(default_factory=list)
    starters: list[str] = field(default_factory=list)
    questions: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Model:
    """A lexicon (label to weighted words), the structural rules and vocabulary, and a function from words to an array of
    ``label, distance``, or none."""

    lexicon: dict[str, dict[str, float]]
    structure: list[tuple[str, str, str, float, float]]
    vocabulary: Vocabulary
    deltas: Callable[[Column], Column] | None = None

    @property
    def labels(self) -> list[str]:
        return sorted({*self.lexicon, *(r[0] for r in self.structure)})


def delta_constants(references: DataFrame, features: list[str]) -> Callable[[Column], Column]:
    """Burrows' Delta to labelled references (``label, feature, freq``: labels x features rows, which become constants)."""
    freq = {(r["label"], r["feature"]): r["freq"] for r in references.collect()}
    labels = sorted({x for x, _ in freq})
    mean = {f: sum(freq[x, f] for x in labels) / len(labels) for f in features} if labels else {}
    std = {f: (sum((freq[x, f] - mean[f]) ** 2 for x in labels) / len(labels)) ** 0.5 or 1e-6 for f in mean}

    def distances(words: Column) -> Column:
        shares = feature_shares(words, features)

        def one(s: Column, label: str) -> Column:
            gaps = [F.abs((s[i] - mean[f]) / std[f] - (freq[label, f] - mean[f]) / std[f]) for i, f in enumerate(features)]
            return F.struct(F.lit(label).alias("label"), (sum(gaps[1:], gaps[0]) / len(features)).alias("distance"))

        return let(shares, lambda s: F.array(*[one(s, x) for x in labels]))

    return distances


def _clip(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def measures(docs: DataFrame, keys: list[str], text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """``keys, words`` and the seven structural measures of a text; null and empty texts measure 0 (brevity 1.25)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    row = docs.select(
        *keys,
        tokens(text).alias("words"),
        delta_tokens(text).alias("plain"),
        F.split(genre_form(text), r"[^\p{L}\p{N}_]+").alias("marked"),
        F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda x: x.rlike(r"^\p{Nd}+$")).alias("numbers"),
        lines.alias("lines"),
        F.transform(lines, lambda x: F.size(F.split(x, r"\s+"))).alias("sizes"),
    )
    n, size = F.greatest(F.size("lines"), F.lit(1)), F.greatest(F.size("plain"), F.lit(1))
    among = lambda words: lambda x: x.isin(words) if words else F.lit(False)
    piped = F.filter("lines", lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 3)
    total = F.aggregate("sizes", F.lit(0), lambda a, b: a + b)
    short = F.size(F.filter("sizes", lambda s: (s >= 3) & (s <= 9))) / n
    return row.select(
        *keys,
        "words",
        (F.size(piped) / n).alias("pipes"),
        (F.size(F.filter("plain", lambda x: among(vocabulary.months)(F.left(x, F.lit(3))))) / size).alias("months"),
        (F.size("numbers") / size).alias("digits"),
        F.size(F.filter("marked", among(vocabulary.starters))).cast("double").alias("starters"),
        F.size(F.filter("marked", among(vocabulary.questions))).cast("double").alias("questions"),
        F.when(n >= 6, short).otherwise(F.lit(0.0)).alias("short"),
        ((10 - total / n) / 8).alias("brevity"),
    )


def _evidence(label: str, feature: str, value: Column, weight: Column, contribution: Column, matches: Column) -> Column:
    return F.struct(
        F.lit(label).alias("label"), F.lit(feature).alias("feature"), value.alias("value"), weight.alias("weight"), contribution.alias("contribution"), matches.alias("matches")
    )


def structural_evidence(rules: list[tuple[str, str, str, float, float]]) -> Column:
    """Evidence of the rules over the columns of :func:`measures`; features without a value are left out."""
    none = F.array().cast("array<string>")
    found = []
    for label, feature, measure, factor, weight in rules:
        value = _clip(F.col(measure) * factor)
        found.append(_evidence(label, feature, value, F.lit(weight), value * weight, none))
    return F.filter(F.array(*found), lambda e: e["value"] > 0)


def lexicon_evidence(lexicon: dict[str, dict[str, float]]) -> Column:
    """One row of evidence a label over the column ``words``: the lexicon's score and the terms that stand in the text."""
    named = sorted({t for terms in lexicon.values() for t in terms})

    def found(s: Column) -> Column:
        rows = []
        for i, (label, terms) in enumerate(sorted(lexicon.items())):
            there = F.filter(F.array(*map(F.lit, sorted(terms))), lambda t: F.array_contains(s["terms"], t))
            score = s["scores"][i]["score"]
            rows.append(_evidence(label, "lexicon", score, F.lit(1.0), score, F.slice(there, 1, MOST_MATCHES)))
        return F.array(*rows)

    # scores and terms are bound: each label's evidence names them several times
    terms = F.transform(F.array_distinct(term_places(F.col("words"), lexicon)), lambda p: F.get(F.array(*map(F.lit, named)).cast("array<string>"), (p - 1).cast("int")))
    held = F.struct(lexicon_scores(F.col("words"), lexicon).alias("scores"), terms.alias("terms"))
    return F.filter(let(held, found), lambda e: e["value"] > 0)


def softmax(scores: Column) -> Column:
    """``label, score`` to ``label, prob``, shifted by the maximum."""

    def spread(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0.0), lambda t, p: t + p["e"])
        return F.transform(parts, lambda p: F.struct(p["label"].alias("label"), (p["e"] / total).alias("prob")))

    def raised(held: Column, top: Column) -> Column:
        return F.transform(held, lambda s: F.struct(s["label"].alias("label"), F.exp(s["score"] - top).alias("e")))

    # scores and their maximum are bound, or each label would compute all scores again
    return let(scores, lambda held: let(F.array_max(F.transform(held, lambda s: s["score"])), lambda top: let(raised(held, top), spread)))


def score(docs: DataFrame, keys: list[str], text_col: str, model: Model) -> DataFrame:
    """``keys, scores, probs, evidence``: per label the lexicon's and the structure's evidence, twice the softmax of the
    negative Delta, and a light prior; evidence is not sorted, and has of Delta the nearest label only."""
    rows = measures(docs, keys, text_col, model.vocabulary)
    evidence = F.concat(lexicon_evidence(model.lexicon), structural_evidence(model.structure))
    near = F.array().cast("array<struct<label:string,prob:double>>")
    if model.deltas is not None:
        closeness = F.transform(model.deltas(F.col("words")), lambda d: F.struct(d["label"].alias("label"), (-d["distance"]).alias("score")))
        near = F.when(F.size("words") > 0, softmax(closeness)).otherwise(near)
    rows = rows.select(*keys, evidence.alias("own"), near.alias("near"))
    nearest = F.array_min(F.transform("near", lambda d: F.struct((-d["prob"]).alias("n"), d["label"].alias("label"))))
    share = -nearest["n"]
    delta = F.struct(
        nearest["label"].alias("label"), F.lit("delta_nearest").alias("feature"), share.alias("value"), F.lit(DELTA_WEIGHT).alias("weight"),
        (share * DELTA_WEIGHT).alias("contribution"), F.array().cast("array<string>").alias("matches"),
    )
    rows = rows.select(*keys, "own", "near", F.when(F.size("near") > 0, F.concat("own", F.array(delta))).otherwise(F.col("own")).alias("evidence"))

    def total(label: str) -> Column:
        own, near = F.filter("own", lambda e: e["label"] == label), F.filter("near", lambda d: d["label"] == label)
        summed = F.aggregate(own, F.lit(0.0), lambda a, e: a + e["contribution"]) + F.coalesce(F.get(near, 0)["prob"], F.lit(0.0)) * DELTA_WEIGHT
        return F.struct(F.lit(label).alias("label"), (summed + PRIOR).alias("score"))

    rows = rows.select(*keys, F.array(*[total(x) for x in model.labels]).alias("scores"), "evidence")
    return rows.select(*keys, "scores", softmax(F.col("scores")).alias("probs"), "evidence")


def _best(probs: Column | str, most: int) -> Column:
    """The ``most`` largest probabilities (rounded), then label order."""
    keyed = F.transform(probs, lambda p: F.struct((-F.round(p["prob"], 6)).alias("n"), p["label"].alias("label")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda p: F.struct(p["label"].alias("label"), (-p["n"]).alias("prob")))


def _strongest(evidence: Column | str, most: int) -> Column:
    keyed = F.transform(evidence, lambda e: F.struct((-F.round(e["contribution"], 4)).alias("n"), e["label"].alias("l"), e["feature"].alias("f"), e.alias("e")))
    plain = F.array_sort(F.transform(keyed, lambda k: F.struct(k["n"], k["l"], k["f"], k["e"])))
    return F.transform(F.slice(plain, 1, most), lambda k: k["e"])


def segment_scores(segments: DataFrame, keys: list[str], text_col: str, model: Model) -> DataFrame:
    """Per segment the best label and probability, the five largest probabilities and the five strongest pieces of evidence."""
    rows = score(segments, keys, text_col, model)
    rows = rows.select(*keys, _best("probs", SEGMENT_PROBS).alias("probs"), _strongest("evidence", SEGMENT_EVIDENCE).alias("evidence"))
    return rows.select(*keys, F.col("probs")[0]["label"].alias("best"), F.col("probs")[0]["prob"].alias("prob"), "probs", "evidence")


def genre_signal(docs: DataFrame, keys: list[str], text_col: str, model: Model) -> DataFrame:
    """Per document the top label and probability, all probabilities, surprisals (largest score less each), the strongest
    evidence, and a confidence from the lead of the first label and the amount of evidence."""
    rows = score(docs, keys, text_col, model)
    top = F.array_max(F.transform("scores", lambda s: s["score"]))
    surprisal = F.transform("scores", lambda s: F.struct(s["label"].alias("label"), F.round(top - s["score"], 6).alias("surprisal")))
    rows = rows.select(
        *keys, _best("probs", len(model.labels)).alias("ranked"), surprisal.alias("surprisal"), _strongest("evidence", MOST_EVIDENCE).alias("evidence")
    )
    lead = F.col("ranked")[0]["prob"] - F.coalesce(F.get("ranked", 1)["prob"], F.lit(0.0))
    confidence = _clip(lead * 1.8 + F.least(F.size("evidence"), F.lit(12)) / 30)
    return rows.select(
        *keys, F.col("ranked")[0]["label"].alias("top_label"), F.col("ranked")[0]["prob"].alias("top_prob"), "ranked", "surprisal", "evidence", F.round(confidence, 6).alias("confidence")
    )
