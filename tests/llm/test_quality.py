import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tripweave.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
JUNK = " ".join(f"{w}%%% $$${w}" for w in "alpha beta gamma delta epsilon zeta".split() * 5)


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)


def plain_grams(text):
    words = [w.encode() for w in WORD.findall(text or "")]
    mask, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15
    one = [(zlib.crc32(w) + 1) * golden & mask for w in words]
    out = [h >> 48 for h in one]
    for a, b in zip(one, one[1:]):
        h = ((a ^ a >> 31) * 0xBF58476D1CE4E5B9 + b) & mask
        out.append(((h ^ h >> 30) * 0x94D049BB133111EB & mask) >> 48)
    return out


def plain_verdicts(texts, trusted):
    """Ratio and verdict of every text by counting in dictionaries."""
    raw, good = Counter(), Counter()
    for text, ok in zip(texts, trusted):
        raw.update(plain_grams(text))
        good.update(plain_grams(text) if ok else [])
    n_raw, n_good, k = sum(raw.values()), sum(good.values()), quality.SMOOTHING
    weight = {g: math.log((good[g] + k) / (n_good * raw[g] / n_raw + k)) for g in raw}
    mean = sum(good[g] * weight[g] for g in raw) / n_good
    var = sum(good[g] * (weight[g] - mean) ** 2 for g in raw) / n_good
    out = []
    for text in texts:
        grams = plain_grams(text)
        score = sum(weight[g] for g in grams) / max(1, len(grams))
        line = mean - quality.LINE_SLACK - quality.LINE_SIGMAS * math.sqrt(var) / math.sqrt(max(1, len(grams)))
        out.append((score, not plain_base(text)[-1] and score >= line))
    return out


def odd_texts(nasty):
    return nasty + ["a b c d e f g h i " * 3, "a b c d e f g h x a b c d e f g h y", "l\nl\n\n \nl\nm", "w " * 30,
                    "a\xa0b\x1cc\x0bd", "same line here\n" * 9, "#*$%&|<> x"]


def test_base_counts_equal_plain_counting(nasty, sample):
    texts = odd_texts(nasty) + [r["text"] for r in sample]
    words = quality.split_words(texts)
    base = quality.base_counts(texts, words)
    got = list(zip(*[np.asarray(c).tolist() for c in base], quality.base_failed(words.lengths, base[-1]).tolist()))
    assert got == [plain_base(t) for t in texts]


@pytest.fixture(scope="module")
def corpus(sample):
    texts = [r["text"] for r in sample[:80]] + [JUNK + f" {i}" for i in range(15)] + [None, ""]
    return texts, [i % 2 == 0 and i < 80 for i in range(len(texts))]


def test_query_equals_brute_force(spark, documents, corpus):
    texts, trusted = corpus
    docs = documents(texts)
    labels = spark.createDataFrame([(i, int(ok), 0) for i, ok in enumerate(trusted) if i % 3] +
                                   [(i, 1, 0) for i, ok in enumerate(trusted) if ok] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    want = plain_verdicts(texts, trusted)
    got = sorted(quality.judge_documents(docs, quality.fit(docs, labels)).collect(), key=lambda r: r.doc_id)
    assert [r.kept for r in got] == [kept for _, kept in want]
    assert np.allclose([r.score for r in got], [score for score, _ in want], atol=1e-9)
    assert all(r.kept or r.base_failed for r in got[:80]) and not any(r.kept for r in got[80:])
    kept = quality.keep_documents(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r in got if r.kept]


def test_without_trusted_documents_the_base_rules_decide(spark, documents, corpus):
    docs = documents(corpus[0], [None] * len(corpus[0]))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.judge_documents(docs, quality.fit(docs, labels)).collect()
    assert all(r.kept != r.base_failed for r in got) and len(got) == len(corpus[0])
    empty = docs.limit(0)
    assert quality.judge_documents(empty, quality.fit(empty, labels)).collect() == []
    assert quality.keep_documents(empty, quality.fit(empty, labels)).collect() == []
