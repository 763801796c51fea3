import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, sig string, _fx_h1 bigint, batch struct<key:string,`a b`:int>"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, repeats, clashing extra columns."""
    long = "wordy " * 60_000 + "end " + "x" * 300_000
    prose = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank"
    near = prose.replace("seven", "eight")
    rows = [
        (1, prose, "en", "s1"), (2, prose, "en", "s2"), (3, near, "en", "s1"), (4, "", "en", "s1"), (5, "", None, None), (6, None, "en", "s1"), (7, None, None, None),
        (8, long, "en", "s1"), (9, long, "de", "s1"), (None, prose, "en", "s1"), (None, "nobody knows this one", None, "s1"), (10, "repeat me twice please thank you", "en", "s2"),
        (10, "repeat me twice please thank you", "en", "s2"), (11, "...\n\n!!!", "fr", "s2"), (12, "Licensed under the MIT License.\nGrüße aus Köln", "de", "s2"), (13, "one", "en", "s2"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 7, None, 5, ("k", 1)) for r in rows], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
