import base64

import numpy as np
import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
CODE = "def f(x):\n    for i in range(10):\n        y[i] = x * 2 + self.value\n    return None\n"


def planted(size):
    rng = np.random.default_rng(size)
    return [base64.b64encode(rng.bytes(size)).decode(),
            " ".join(base64.b64encode(rng.bytes(45)).decode() for _ in range(size // 60 + 1)),
            " ".join(map(str, rng.integers(0, 10**6, size // 6))) + " x", rng.bytes(size).hex(), CODE * (size // len(CODE) + 1)]


@pytest.mark.parametrize("size", [200, 5000])
def test_texts_of_no_language_go_and_all_documents_stay(spark, documents, sample, size):
    texts = [r["text"] for r in sample] + planted(size)
    langs = [r["lang"] for r in sample] + [None] * (len(texts) - len(sample))
    kept = corpus_pipeline.language_id(spark, documents(texts, lang=langs), FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(sample)))


@pytest.mark.parametrize("labelled", [None, 1])
def test_nothing_learned_keeps_everything(spark, documents, sample, rows, labelled):
    """No label at all, or only on a held-out document."""
    texts = [r["text"] for r in sample[:20]] + [None, "12 34"]
    docs = documents(texts, [None] * len(texts), lang=["en" if labelled and i < labelled else None for i in range(len(texts))])
    assert rows(corpus_pipeline.language_id(spark, docs, FOLDER)) == rows(docs)
