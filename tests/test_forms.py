import unicodedata

import pytest
from pyspark.sql import functions as F

from quillon.functions import forms
from quillon.operators import corpora, evaluate, pages, protocols


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_forms_of_nulls_and_signs(spark):
    rows = [(None,), ("",), ("Iñigo'S  [exp:VERÆ] q3 & ⁊ <x> œuvre…",)]
    t = F.col("t")
    got = {k: values(spark, f(t), rows, "t string") for k, f in {"scoring": forms.scoring_form, "genre": forms.genre_form, "stylo": forms.stylo_form, "title": forms.title_form, "quality": forms.quality_form}.items()}
    assert all(v[0] is None and v[1] == "" for v in got.values())
    assert got["scoring"][2] == "inigo s exp uerӕ q3 & ⁊ <x> œuure".replace("ӕ", "æ")
    assert got["genre"][2] == "inigo's [exp:ueræ] que et et x œuure…"
    assert got["stylo"][2] == "inigo s exp uere que et et x euure"
    assert got["quality"][2] == "inigo s que et et x uure"
    assert "exp:vere" in got["title"][2] and "euvre" in got["title"][2]
    assert values(spark, forms.fingerprint_tokens(t), rows, "t string")[:2] == [[], []]


def test_marks(spark):
    rows = [("a [uncertain: ut / vt] b [gap 3] [exp:X] [other]",), (None,)]
    assert values(spark, forms.strip_tokens(F.col("t")), rows, "t string") == ["a ut b   [other]", None]
    assert values(spark, forms.strip_marks(F.col("t")), rows, "t string") == ["a b X", None]
    assert values(spark, forms.strip_marks(F.col("t"), False), rows, "t string") == ["a b", None]


def test_unicode_forms_are_exact(spark):
    text = "é é ﬁ ß Å ﻿x"
    rows = [(text,), (None,)]
    assert values(spark, forms.unicode_form(F.col("t"), "NFKC"), rows, "t string") == [unicodedata.normalize("NFKC", text), None]
    assert values(spark, forms.tagger_form(F.col("t")), rows, "t string")[0] == unicodedata.normalize("NFKD", text).casefold()
    assert values(spark, forms.ocr_text(F.col("t")), [(" ﻿é ",)], "t string") == ["é"]
    assert values(spark, forms.extract_text(F.col("t")), [("ãb    c中",)], "t string") == ["ab  c "]


def test_segments(spark):
    rows = [("one two three four. five six\f\fanother page of words; and more of it",), (None,), ("\n".join(map(str, range(30))),)]
    assert values(spark, forms.segments(F.col("t"), "page"), rows[:2], "t string") == [["one two three four. five six", "another page of words; and more of it"], []]
    assert values(spark, forms.segments(F.col("t"), "sentence"), rows[:1], "t string")[0][0] == "one two three four."
    assert [len(x.split("\n")) for x in values(spark, forms.segments(F.col("t")), rows[2:], "t string")[0]] == [12, 12, 6]


def test_small_parsers(spark):
    assert values(spark, forms.source_key(F.col("t")), [("JUST1-633m5",), ("kb27.349",), ("phillipps_10",), ("99x",)], "t string") == ["JUST1", "kb27", "phillipps", "99x"]
    assert values(spark, forms.parse_year(F.col("t")), [("c. 1230",), ("-450 BC",), ("12",), (None,)], "t string") == [1230, -450, None, None]
    refs = [("fast",), ("OpenAI/x/y",), ("gemini-2",), ("gpt-9",), ("other",)]
    got = values(spark, forms.split_model(F.col("t"), {"fast": ("a", "b")}), refs, "t string")
    assert [tuple(x) for x in got] == [("a", "b"), ("openai", "x/y"), ("gemini", "gemini-2"), ("openai", "gpt-9"), ("anthropic", "other")]
    assert values(spark, forms.translation_code(F.col("t"), {"eng": "EN"}), [(" ENG",), ("xx",)], "t string") == ["EN", "XX"]
    conf = [([0.9, 0.5], [0.1]), (None, [0.2, 0.4]), (None, None)]
    assert values(spark, F.round(forms.line_confidence(F.col("a"), F.col("b")), 6), conf, "a array<double>, b array<double>") == [0.5, 0.3, 0.0]
    assert values(spark, forms.flat_polygon(F.col("t")), [("1,2 3,4",), ("1 2 3",), ("",)], "t string") == [[(1.0, 2.0), (3.0, 4.0)], [(1.0, 2.0)], []]


def test_correct_gate_needs_both_rates(spark):
    rows = [("a", True, 0.1, None), ("b", True, 0.1, 0.2), ("c", False, 0.1, 0.2), ("d", True, 0.1, 0.6)]
    df = spark.createDataFrame(rows, "name string, held_out_ready boolean, held_out_cer double, held_out_wer double")
    df = df.selectExpr("*", "CAST(NULL AS double) AS val_accuracy", "CAST(NULL AS double) AS val_word_accuracy", "CAST(NULL AS map<string,double>) AS per_corpus")
    got = {r["name"]: (r["allowed"], r["recommended"]) for r in evaluate.correct_gate(df).collect()}
    assert got == {"a": (False, True), "b": (True, True), "c": (False, True), "d": (False, False)}


def test_inject_and_rescale(spark):
    page = '<Page><TextRegion><TextLine id="a"><Coords points="0,0 10,x"/><TextEquiv><Unicode>old</Unicode></TextEquiv></TextLine><TextLine id="b"></TextLine></TextRegion></Page>'
    df = spark.createDataFrame([(page, {1: "a<b", 2: " "})], "c string, m map<int,string>")
    out = df.select(pages.inject_lines(F.col("c"), F.col("m"))).first()[0]
    assert "<Unicode>a&lt;b</Unicode>" in out and "old" not in out and out.count("TextEquiv>") == 2
    assert 'points="0,0 10,x"' in df.select(pages.rescale_points(F.col("c"), F.lit(2.0), F.lit(3.0))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("transcriptionOutput:\n  segments: []\n", True), ("a: [uncertain: x / y]", False), (": : :\n-", None)])
def test_yaml_documents(spark, raw, want):
    doc = spark.createDataFrame([(raw,)], "t string").select(protocols.yaml_to_json(F.col("t")).alias("j")).select("j", protocols.root(F.col("j")).alias("r")).first()
    if want is None:
        assert doc["j"] is None
    else:
        assert (doc["r"] is not None) == want
        assert want or "[uncertain: x / y]" in doc["j"]


def test_title_rules_without_a_year(spark):
    df = spark.createDataFrame([("Liber Saecularis", "c. 1230"), ("Liber Saecularis", None), (None, "1230")], "t string, y string")
    rules = [("law", ["liber seculari"])]
    assert [r[0] for r in df.select(corpora.title_genre(F.col("t"), rules)).collect()] == ["law", "law", None]
    assert [r[0] for r in df.select(corpora.title_genre(F.col("t"), rules, year=F.col("y"), years=(1000, 1300))).collect()] == ["law", None, None]
