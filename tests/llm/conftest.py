import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from messy_rows import MESSY  # noqa: E402


@pytest.fixture(scope="session")
def messy(spark):
    """``MESSY`` with extra columns whose names clash with results and internals."""
    rows = [(i, t, "a", 1.0, 2, "b", "c", 3, "d") for i, t in MESSY]
    schema = (
        "doc_id long, text string, lang string, score double, n_words long, host string, kept string, row long, key string"
    )
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(messy):
    return messy.where("false")
