import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

NASTY = [
    None, "", " ", "   ", "\n\n\n x", "a  b   c    d", "tab\tand\r\nlines \n  end  ", "x" * 5000, "ab " * 4000,
    "don't we'll I'M 12345 3.14  nbsp em", "naïve ÜBER straße ñandú 中文 \U0001f600\U0001f680",
    "<|endoftext|> in <|endoftext|><|endoftext|>text", "é ́ \x1c\x1d\x85", "\u0000 nul \x7f", "aaaaaaa aaaa aaa",
    "!!!???...### $$$ %%%", "mixed​zero‍width", "  lead and trail  ",
]


@pytest.fixture(scope="session")
def nasty():
    return NASTY


@pytest.fixture(scope="session")
def sample():
    """All texts of the smallest driver table."""
    import pyarrow.parquet as pq
    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as documents, with one more column whose name clashes with the operators' own."""
    def make(texts, ids=None, **columns):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, columns.get("lang", ["en"] * len(texts))[n], columns.get("source", ["s"] * len(texts))[n], 7, "x")
                for n, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(
            rows, "doc_id bigint, text string, lang string, source string, n_tokens int, kept string")
    return make
