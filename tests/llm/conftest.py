import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

ODD = (None, "", " \t\n", "word", "Two words", "x" * 5000, "ñandú é 中文 ß İ", "12 34", "a b c d e f " * 400)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a long word, repeats, other scripts; null ids and repeated rows; clashing names."""
    rows = [(i, t, "en", None, 1) for i, t in enumerate(ODD)] + [(None, "no id", None, "s", None), (3, "word", "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS score", "2 AS node", "3 AS row", "4 AS item_id", "5 AS place", "6 AS _c")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
