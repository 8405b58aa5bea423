from __future__ import annotations

import pytest
from pyspark import cloudpickle

import sprintloom

cloudpickle.register_pickle_by_value(sprintloom)

# Columns of ``documents`` and some whose names the operators use inside.
COLUMNS = ("doc_id long, text string, lang string, source string, kept boolean, name string, fp long, _key string, "
           "_row string, id long, `word n` string")


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text[, lang[, source]]) as a table with further columns of clashing names."""

    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2:], False, "n", 1, "k", "r", 5, "w") for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


LONG = "lorem ipsum dolor " * 20_000
