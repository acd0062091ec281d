import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows and clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(None, None, None, 1, "a"), (1, None, "en", 2, "b"), (2, "", None, 3, "c"), (3, " \n\t ", "en", 4, "d"), (4, long, "en", 5, "e"), (5, "one two", "en", 6, "f"), (5, "one two", "en", 6, "f"), (6, "one two", "en", 6, "f"), (None, "one two", "en", 7, "g")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, _t string")
