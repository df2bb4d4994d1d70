import pytest

LONG = "the of and " * 20000

#: Nulls, empty and long texts, repeated rows, white space and symbols only, broken ids.
ROWS = [
    (1, "The thing of the hendan is there and the one is hendre.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "   \n\t ", "fr", "b"),
    (5, "12345 $$$ !!!", "de", "b"),
    (6, LONG, "en", "a"),
    (7, "L'été où l'élève était là, ça va être très bien pour le français.", "fr", "a"),
    (7, "L'été où l'élève était là, ça va être très bien pour le français.", "fr", "a"),
    (8, "Der schöne Übermut für die Mädchen und das Haus ist nicht größer.", "de", "b"),
    (None, "a row without an id", "en", "a"),
    (None, "a row without an id", "en", None),
    (9, "The thing of the hendan is there and the one is hendre.", None, "a"),
    (10, "漢字とかな 😀 \x1c \x85 x", "ja", "a"),
    (11, "word", "en", ""),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns with the names that operators use for themselves."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("x").alias(n) for n in working_names()])


def working_names():
    """Every lower-case name in quotes in the source of the operators, and some that other stores
    use, but the columns that are read."""
    import pathlib
    import re

    source = pathlib.Path(__file__).parents[2]
    found = {"_id", "_seen", "_key", "_hash", "_out", "_t", "_lang_pred", "_lang_score", "_langid", "_first"}
    for path in [*(source / "piiframe/llm").glob("*.py"), source / "corpus_pipeline.py"]:
        found |= {n for n in re.findall(r"[\"']([a-z_][a-z0-9_]{0,20})[\"']", path.read_text())}
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars"})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
