import random

import pytest
from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        *(T.StructField(c, T.StringType()) for c in ("is_kept", "group_id", "key", "node", "t", "tag", "tokens", "shard", "label", "id", "predicted", "__twice", "__place", "row", "place", "other", "a.b", "__words")),
    ]
)
WORDS = ["river", "stone", "valley", "the", "of", "and", "rain", "über", "été", "flow", "slope", "basin", "ash", "burn", "ridge", "gully", "crest", "silt", "x1", "42"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) + rng.choice(["", "s", "ing", str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = sentence(rng, 60_000)
    base = [(1, "A plain text about a river and its stones.", "en", "a.example.org", 10), (2, None, "en", "a.example.org", None), (3, "", None, None, 0), (4, "   ", "fr", "", 3), (5, "###", None, "b", 3), (6, long, "en", "b", 9), (7, long, "en", None, 9)]
    base += [(1, "A plain text about a river and its stones.", "en", "a.example.org", 10), (None, "A plain text about a river and its stones.", "en", "c", 1), (None, None, None, None, None), (8, "tie", "de", "d", 3), (9, "tie", "de", "d", 3), (10, "日本語のテキスト 🙂🙂", "ja", "e", 9)]
    return [r + ("x",) * 18 for r in base]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def very_long(spark):
    """A text longer than any block that kernels work on, beside short ones."""
    rng = random.Random(9)
    text = sentence(rng, 500_000)
    assert len(text.encode()) > 3 << 20
    rows = [(1, text), (2, text + " end"), (3, "short text"), (4, "word" * 900_000), (5, text[:-200_000])]
    return spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string").repartition(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
