import zlib

import numpy as np
import pytest
import pyarrow.parquet as pq

from tripweave.llm import language

FOLDER = "/root/testdata/sf0.01"


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def machines(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return language.fit(language.learning_part(docs))


def plain_margins(text, machines):
    """Margins of one text, n-gram by n-gram."""
    letters = bytearray(b" ")
    for b in (text or "").lower().encode():
        b = b if b >= 128 or 97 <= b <= 122 else 32
        if b != 32 or letters[-1] != 32:
            letters.append(b)
    if letters[-1] != 32:
        letters.append(32)
    sums = machines.biases * len(letters)
    for n in range(language.GRAM):
        for i in range(len(letters) - n):
            code = letters[i] + 1
            for b in letters[i + 1:i + n + 1]:
                code = (code * 257 + b) % 2**32
            mixed = ((code ^ code >> 15) * 0x9E3779B1 + n) % 2**32 * 0x85EBCA6B % 2**32
            sums = sums + machines.weights[:, mixed >> 32 - language.BITS]
    return sums / len(letters)


def test_margins_equal_plain_counting(machines, nasty):
    texts = nasty + ["Über den Wolken", "the THE the", "ñandú"]
    codes, counts = language.gram_codes(texts)
    got = language.margins(codes, counts, machines)
    for row, text in zip(got, texts):
        if text is None or len(text) < 3000:
            assert np.allclose(row, plain_margins(text, machines), atol=1e-4), text


def test_held_out_accuracy(machines):
    rows = [r for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist() if held_out(r["doc_id"])]
    named, score = language.predict([r["text"] for r in rows], machines)
    assert np.mean([a == r["lang"] for a, r in zip(named, rows)]) > 0.97
    assert ((score >= 0) & (score <= 1)).all()
    assert [machines.languages, machines.families] == [["de", "en", "es", "fr"], ["germanic", "romance"]]
    assert sorted(step for step, _, _ in machines.pairs) == [0, 1, 1]


def test_same_data_gives_the_same_machines(spark, machines):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(7)
    again = language.fit(language.learning_part(docs))
    assert (again.weights == machines.weights).all() and (again.biases == machines.biases).all()


def test_three_languages_of_a_family_and_unknown_ones():
    texts = {"en": "the and of that with ", "de": "der und von dass mit ", "nl": "het een van dat met ", "xx": "zuq qaz wuq quz "}
    rows = [(word * k, lang) for lang, word in texts.items() for k in range(1, 12)]
    machines = language.train([(lang, *(part.tobytes() for part in language.shares_of(t))) for t, lang in rows])
    assert machines.families == ["germanic", "xx"] and len(machines.pairs) == 1 + 3
    assert language.predict([t for t, _ in rows], machines)[0] == [lang for _, lang in rows]


def test_query_over_odd_rows(spark, documents, nasty):
    texts = nasty + ["the house and the garden of that man"] * 2
    docs = documents(texts, [*range(len(texts) - 1), None], lang=["en" if i % 2 else None for i in range(len(texts))])
    got = language.predict_documents(docs, language.fit(language.learning_part(docs))).collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"]
    for row, text in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), texts):
        assert row.held_out == held_out(row.doc_id)
        has_letter = any(c.isalpha() for c in text or "")
        assert row.lang_pred == ("en" if has_letter else "und") and 0 <= row.score <= 1
    kept = language.keep_known(docs, language.fit(language.learning_part(docs)))
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for t in texts)


def test_nothing_to_learn_from(documents):
    docs = documents(["a b", "c"], lang=[None, None])
    machines = language.fit(language.learning_part(docs))
    assert [(r.lang_pred, r.score) for r in language.predict_documents(docs, machines).collect()] == [("und", 0.0)] * 2
    assert language.predict_documents(docs.limit(0), machines).collect() == []


def test_held_out_texts_change_nothing(spark, documents, sample):
    texts = [r["text"] for r in sample[:60]]
    langs = [r["lang"] for r in sample[:60]]
    changed = ["zzz" if held_out(i) else t for i, t in enumerate(texts)]
    one, two = (language.fit(language.learning_part(documents(t, lang=langs))) for t in (texts, changed))
    assert (one.weights == two.weights).all()
