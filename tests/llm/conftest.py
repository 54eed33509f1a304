import re
import zlib

import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long, run long, key string, keep string"


@pytest.fixture
def table(spark):
    """Documents of (doc_id, text), with extra columns whose names clash with those that operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "x") for i, t in rows], NAMES)

    return make


#: Nulls, empty and white texts, ties, repeated rows, one very long text and one row with a null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "the cat " * 20), (5, "the cat " * 20), (5, "the cat " * 20), (6, "Ünïcödé 漢字 é\U0001f600 x"), (7, "word " * 30000), (None, "alone here"), (8, "x")]


@pytest.fixture
def odd():
    return list(ODD)


def crc(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")
