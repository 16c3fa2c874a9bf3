import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE), str(HERE.parents[1])]

FOLDER = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept int, rep string, digest int, block int, n_lines int, row int, total int"
)


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents table."""
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def corpus_rows(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, clashing column names."""

    def make(rows):
        extra = (1, "x", 2, 3, 4, 5, 6)
        full = [
            (d, t, "en", s, None if t is None else len(t), *extra)
            for d, t, s in [(*r, "src") if len(r) == 2 else r for r in rows]
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make
