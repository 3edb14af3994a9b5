import pytest

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
PASSAGE = "Every evening the harbour lights were lit one after another until the whole bay seemed to float upon a slow and golden breath of sea. "


@pytest.fixture(scope="session")
def messy(spark):
    """Rows with nulls, empty and very long texts, repeats, and columns whose names operators use inside."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en"),
        (2, "The quick brown fox jumps over the lazy dog again and again", "en"),
        (2, "The quick brown fox jumps over the lazy dog again and again", "en"),
        (3, "", "en"),
        (4, None, None),
        (5, "one", "de"),
        (6, " \n\t ", "fr"),
        (7, LONG, "en"),
        (8, PASSAGE * 3 + "ends here", "en"),
        (9, "Prefix " + PASSAGE * 2, "en"),
        (None, "no id but some words in it, a few more than the others have", "en"),
        (-10, "éàü ß 漢字 \U0001f600 <|endoftext|> x", None),
    ]
    return spark.createDataFrame(
        [(*r, "s", i, 0.5, "k") for i, r in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, score double, removed string",
    )


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
