import pytest

ODD_TEXTS = [
    None, "", " ", "\n\n", "word", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen",
    "ünï cödé ✓ 漢字 　 x y", "tab\tsep\x0bvt\x0cff\rcr", "x" * 5000, "  lead and trail  ", "\x00nul \x7f",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 997}" for i in range(30000))
    rows = [(i, t, "en", i) for i, t in enumerate(ODD_TEXTS)] + [(100, long, None, 1), (100, long, None, 1), (None, "no id here at all", "fr", None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, TEXT2 int").withColumnRenamed("TEXT2", "n_words")
