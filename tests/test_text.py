import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import protocol as P
from quillon.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def bare(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.category(c).startswith("M"))


def test_fold_is_decomposition_without_marks(spark):
    letters = "".join(chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha() and chr(c) != "İ")
    assert one(spark, letters, T.fold) == bare(letters.lower())
    assert one(spark, unicodedata.normalize("NFD", "éàüñ"), T.fold) == "eaun"
    assert one(spark, "ß æ ⁊", T.fold) == "ß æ ⁊"


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x17F), max_size=40))
def test_fold_property(spark, s):
    if "İ" not in s:
        assert one(spark, s, T.fold) == bare(s.lower())


def test_tokens(spark):
    assert one(spark, "Étion d'où 3 ab c", T.tokens) == ["etion", "ou", "ab"]
    assert one(spark, None, T.tokens) == []
    assert one(spark, "", T.tokens) == []


def test_canonical_and_markup(spark):
    assert one(spark, "Vinum  JESV, (et)", T.canonical) == "uinum iesu et"
    assert one(spark, "a [uncertain: x/y] [exp:dominus] [gap 3] <b>z</b>", T.strip_markup).split() == ["a", "x", "dominus", "z"]


def test_chunks(spark):
    words = spark.createDataFrame([([str(i) for i in range(4500)],)], "w array<string>")
    parts = words.select(T.chunk_words(F.col("w"), 2000)).first()[0]
    assert [len(p) for p in parts] == [2250, 2250] and sum(parts, []) == [str(i) for i in range(4500)]


def test_rolling_window(spark):
    rows = spark.createDataFrame([(n,) for n in (19, 79, 80, 119, 120, 500, 1500)], "n int")
    got = [tuple(r[0]) for r in rows.select(T.rolling_window(F.col("n"))).collect()]
    assert got == [(None, None)] * 4 + [(80, 40), (250, 150), (400, 250)]


def test_years(spark):
    year = lambda s: tuple(one(spark, s, T.parse_years))
    assert year("17uu") == (1700, 1799)
    assert year("1650/9999") == (1650, 1650)
    assert year("") == (None, None)
    assert year("c. 1450-1475") == (1450, 1475)


def test_safe_id(spark):
    assert one(spark, "..a b/c-", T.safe_id) == "a_b_c"
    assert one(spark, "---", T.safe_id) == "job"


def test_protocol(spark):
    assert one(spark, "Main  Body", P.position) == "body"
    assert one(spark, "Headers", P.position) == "header"
    assert one(spark, "right-margin note", P.position) == "margin_right"
    assert one(spark, "odd place", P.position) == "odd place"  # what is unknown stays as it was
    for raw in ("top_left_margins", "upper left margins", "lower-right corners"):
        assert one(spark, raw, P.position) == ("margin_right" if "right" in raw else "margin_left")
    assert one(spark, "corners", P.position) == "corners" and one(spark, "glosses", P.position) == "glosses"
    assert tuple(one(spark, "5-11", P.line_range)) == (5, 11)
    assert tuple(one(spark, "7", P.line_range)) == (7, 7)
    assert tuple(one(spark, "[3, 4]", P.line_range)) == (3, 4)
    label = lambda s: one(spark, s, lambda c: P.closed_label(c, ["charter", "royal charter", "letter"]))
    assert label('```json\n{"label": "letter"}\n```') == "letter"
    assert label("It is a Royal Charter.") == "royal charter"
    assert label("no idea") is None
