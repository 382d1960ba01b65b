"""Puts the plain versions in reach, and makes small tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, h string, _file string, units int"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text), with columns whose names operators might use themselves."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", None if i % 3 == 0 else "web", 7, "x", "y", i) for i, (d, t) in enumerate(rows)], SCHEMA)

    return make
