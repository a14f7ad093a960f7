import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("key", "hash", "line", "words", "bucket", "seed", "site", "spans", "fp", "anchor", "n", "score", "label", "quality",
            "item_id", "word", "id", "pos", "found", "base", "digest", "root", "component_id", "held_out", "text_hash", "d", "h", "w")


def messy_rows():
    """Null ids and texts, empty and very long texts, repeated rows and ids, ties."""
    long = " ".join(f"word{i % 977} and {i}" for i in range(60_000))
    rows = [(None, "a text without an id. It has words enough for every shingle.", "en", "s1"),
            (None, None, None, None), (1, None, "en", "s1"), (2, "", "en", None), (3, " \n\t ", "en", "s2"),
            (4, long, "en", "s3"), (5, "9" * 6_000, "en", "s3"), (6, "x" * 5_000, "en", "s4"), (7, "1.2" * 5_000 + " +1" * 3_000, "en", "s4"),
            (8, "tie one two three four", "en", "s5"), (8, "tie one two three four", "en", "s5"), (9, "tie one two three four", "en", "s6"),
            (8, "the same id with another text\nof two lines", "en", "s5"), (10, "İıſK é́ \U0001F44D𝟙 ß.ẞ <|endoftext|>", None, "s7"),
            (11, "\x00\x01 a\x7fb", "en", "s8"), (12, "\n" * 3_000, "en", "s9")]
    return [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]


@pytest.fixture(scope="session")
def messy(spark):
    df = spark.createDataFrame(messy_rows(), COLUMNS).repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df.cache()


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], COLUMNS)
