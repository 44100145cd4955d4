import random

import public_tokenizers
from tokenizers import Tokenizer

from tripweave.llm.tokencount import TokenCounter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts):
    library = Tokenizer.from_file(PATH)
    return [len(library.encode(text or "", add_special_tokens=False).ids) for text in texts]


def test_counts_equal_the_library_on_odd_and_real_texts(nasty, sample):
    texts = nasty + [row["text"] for row in sample]
    assert TokenCounter(PATH).of_texts(texts) == expected(texts)


def test_counts_equal_the_library_on_random_texts():
    random.seed(5)
    alphabet = "aab the\n  \t.'sé中1<|endoftext|>̀\x1c"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(3000)]
    assert TokenCounter(PATH).of_texts(texts) == expected(texts)


def test_query_over_odd_rows(documents, nasty):
    docs = documents(nasty + nasty[:3], [*range(len(nasty)), None, 1, 1])
    got = count_tokens(docs, PATH, limit=100).collect()
    assert got[0].__fields__ == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = expected(nasty + nasty[:3])
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (len((t or "").encode()), n, n > 100) for t, n in zip(nasty + nasty[:3], want))
    assert count_tokens(docs.limit(0), PATH).collect() == []
