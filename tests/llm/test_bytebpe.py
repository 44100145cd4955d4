import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tripweave.llm.bytebpe import ByteBpe, encode_documents, read_ranks, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(read_ranks(PATH), public_tokenizers.PATTERN)


def ids(encoded):
    return [np.frombuffer(x, "<u4").tolist() for x in encoded]


def test_ids_equal_the_library(bpe, library, nasty, sample):
    texts = nasty + [row["text"] for row in sample]
    assert ids(bpe.encode(texts)) == [library.encode_ordinary(text or "") for text in texts]


def test_ids_equal_the_library_on_random_texts(bpe, library):
    random.seed(7)
    alphabets = ["ab", "aehint r", "the and ing  \n\t.'s", "é中aß1 \x1c", "0123456789 ", "́\U0001f600x!?"]
    texts = ["".join(random.choices(random.choice(alphabets), k=random.randint(0, 80))) for _ in range(6000)]
    assert ids(bpe.encode(texts)) == [library.encode_ordinary(text) for text in texts]


def test_a_small_vocabulary_with_overlapping_merges():
    ranks = {bytes([b]): b for b in range(256)}
    for token in (b"aa", b"ab", b"aab", b"ba", b"bab", b"aaaa", b"abba", b"bb"):
        ranks[token] = len(ranks)
    own, library = ByteBpe(ranks, r".+"), tiktoken.Encoding(
        "t", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    for _ in range(5000):
        text = "".join(random.choices("ab", k=random.randint(1, 30)))
        assert own.encode_bytes(text) == library.encode_ordinary(text), text


def test_decoding_gives_the_text_back(bpe, nasty):
    assert [bpe.decode(x) for x in bpe.encode(nasty)] == [(text or "").encode() for text in nasty]


def test_query_over_odd_rows(documents, nasty, library):
    docs = documents(nasty + nasty[:2], [*range(len(nasty)), None, 1])
    want = []
    for text in nasty + nasty[:2]:
        tokens = library.encode_ordinary(text or "")
        want.append((len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    got = round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert sum(r.doc_id is None for r in got) == 1
    assert round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    assert encode_documents(docs, PATH, public_tokenizers.PATTERN).columns == ["doc_id", "ids"]
