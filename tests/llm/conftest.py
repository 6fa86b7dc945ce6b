import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from brute import ODD_TEXTS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, repeated rows, and columns whose names clash with those of the operators."""
    data = [(i, t, None, None, "x", 0.5, False) for i, t in enumerate(ODD_TEXTS)]
    data += [data[4], data[5], (100, ODD_TEXTS[9], "en", "s", "y", None, None)]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, digest string, score double, kept boolean"
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
