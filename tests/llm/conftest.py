import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from kpiforge.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"

#: Null and empty texts, ties, repeated rows, null ids, and columns whose names operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, c long, h long, n long, k long, component string, host string, i string"


@pytest.fixture(scope="session")
def spark():
    yield get_session("local[4]", shuffle_partitions=4, app_name="kpiforge-llm-tests")


@pytest.fixture(scope="session")
def sf():
    """Folder of the smallest given tables."""
    return SF


@pytest.fixture
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 1, 2, 3, 4, "x", "y", "z") for d, t in rows], DOCS)
    return make
