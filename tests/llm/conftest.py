"""Small documents that hold every awkward case, shared by the operator tests."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (0, "The cat sat on the mat. It was warm there all day long. Nobody came to see it at all.", "en", "src1", 1),
    (1, "THE CAT sat on the mat. It was warm there all day long. Nobody came to see it at all.", "en", "src1", 1),
    (1, "THE CAT sat on the mat. It was warm there all day long. Nobody came to see it at all.", "en", "src1", 1),  # repeated row
    (2, None, None, None, None),
    (3, "", "en", "src2", 0),
    (4, " \t\n ", "en", None, 3),
    (None, "a row without an identifier", None, "src1", 5),
    (None, None, "de", "src1", 5),
    (5, "été déjà ÉTÉ Straße ñandú", "fr", "src3", 5),
    (6, "été déjà été Straße ñandú", "fr", "src3", 5),  # differs beyond A-Z
    (7, "word " * 30_000, "en", "src1", 5),
    (8, "x" * 200_000, "en", "src1", 5),
    (9, "12 34 !! ??", "en", "src1", 5),
    (10, "<|endoftext|> token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\" 😀 end", "en", "src1", 5),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls, empty and very long texts, ties, repeats and extra columns named like internals."""
    df = spark.createDataFrame(AWKWARD, DOCS)
    return df.selectExpr("*", "1 as uid", "'x' as word", "2 as n", "'h' as fp", "3 as node", "false as kept", "4 as length",
                         "5 as rank", "'z' as domain", "true as held_out", "6 as h0", "7 as start", "8 as n_tokens")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
