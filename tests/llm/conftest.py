import importlib.util
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture
def rows_of(spark):
    """A table of documents from (doc_id, text) or fuller tuples, with columns whose names clash with results."""

    def make(rows, schema="doc_id bigint, text string", **extra):
        df = spark.createDataFrame(rows, schema)
        for name, value in extra.items():
            df = df.withColumn(name, value)
        return df

    return make


def pytest_ignore_collect(collection_path, config):
    return importlib.util.find_spec("corrob.llm") is None or None
