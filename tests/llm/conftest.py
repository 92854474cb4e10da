from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    """The smallest tables: name to DataFrame."""
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet").cache() for t in ("documents", "pages", "benchmark", "labels")}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, fp long, rank long, text_crc32 string"
EDGE_TEXTS = [
    None, "", " \n\t ", "x", "Same text in three rows, with more than enough words to be of use to any of the operators here, is it not so, yes.",
    "Same text in three rows, with more than enough words to be of use to any of the operators here, is it not so, yes.",
    "é́ 👍🏽 中文   \x00 \x1c end", "mail a@b.co or +1 (523) 555-1055, 4111 1111 1111 1111, 10.0.0.1.", "\n".join(["line of text here"] * 30), "a b c d e f g h " * 4000,
]


@pytest.fixture(scope="session")
def edge_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns named as operators name theirs."""
    rows = [(i, t, "en", "s", len(t or ""), "r", "s", 1, 2, "c") for i, t in enumerate(EDGE_TEXTS)]
    rows += [(3, "x", None, None, None, None, None, None, None, None)] * 2
    rows += [(None, "Same text in three rows, with more than enough words to be of use to any of the operators here, is it not so, yes.", None, None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
