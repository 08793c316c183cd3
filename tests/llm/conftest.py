"""Fixtures of the training-data operators; the Spark session comes from tests/conftest.py."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a user's own columns of these names must pass or be ignored.
CLASHING = ["band", "key", "component", "class_id", "row", "n", "digest", "score", "copy", "held_out", "toxic", "set", "c0", "_n", "_key", "_who", "p", "words", "_pii", "who", "own0", "done"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """DataFrame of documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, clashing=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashing:
            for c in CLASHING:
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make

