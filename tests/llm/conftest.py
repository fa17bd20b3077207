import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(12_000))
BASE = "the quick brown fox jumps over a lazy dog and then it runs home to eat some bread with cheese while rain falls on old roofs"
#: doc_id, text, lang, source: nulls in every column, empty and very long texts, ties and repeated rows
ODD = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, None, "en", "a"), (4, "", None, "b"), (5, " \t\n\r\x0b\x0c ", "de", None),
    (6, LONG, "en", "b"), (7, LONG + " tail", "en", "b"), (8, "é ü <b> | # 12 km", None, None), (None, BASE, "en", "a"), (None, None, None, None),
    (9, "one", "en", "a"), (10, "ONE", "en", "a"), (-3, "a\xa0b c d", "fr", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns that are called like the operators' own."""
    from pyspark.sql import functions as F

    names = ["fp", "size", "rid", "row", "copies", "k", "p", "tid", "ranges", "key", "hash", "n", "q_kept", "q_row", "q_w", "held_out", "chunk", "target", "start"]
    return odd.withColumns({c: F.lit(f"own {c}") for c in names})


@pytest.fixture(scope="session")
def documents(spark):
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("tables are not here")
    return spark.read.parquet(str(path))
