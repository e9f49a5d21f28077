import datetime as dt

import pytest
from pyspark.sql import Row

TEXT = "doc_id bigint, text string"
#: Columns that the operators do not know, with names that they use inside.
CLASHING = "doc_id bigint, text string, n_chars bigint, score double, ids string, digest string, piece string, sequence_id string, token string, range string"


@pytest.fixture(scope="session")
def docs(spark):
    def make(*rows, start=1):
        """Documents from texts, or from (doc_id, text)."""
        pairs = [r if isinstance(r, tuple) else (start + k, r) for k, r in enumerate(rows)]
        return spark.createDataFrame(pairs, TEXT)

    return make


@pytest.fixture(scope="session")
def clashing(spark):
    def make(*texts):
        return spark.createDataFrame([(k + 1, t, 1, 0.5, "x", "x", "x", "x", "x", "x") for k, t in enumerate(texts)], CLASHING)

    return make
