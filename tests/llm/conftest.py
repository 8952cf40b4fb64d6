import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of some texts, with ids from 0; extra columns clash with names the operators use."""

    def make(texts, ids=None, lang="en", source="s"):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, lang, source, len(t) if t is not None else None) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make
