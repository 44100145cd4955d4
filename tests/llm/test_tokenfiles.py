import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tripweave.llm.common import shared_path
from tripweave.llm.tokenfiles import ChunkEncoder, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    library = Tokenizer.from_file(PATH)
    return [library.encode(text or "", add_special_tokens=False).ids for text in texts]


def test_chunks_give_the_ids_of_whole_texts(nasty, sample):
    random.seed(3)
    alphabet = "aab the\n  \t.'sÉ中1̀\x1cΣ’<|>"
    texts = nasty + [row["text"] for row in sample[:60]] + [
        "".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(PATH).encode(texts)]
    assert got == library_ids(texts)


def round_trip(docs):
    path = shared_path(docs, "tokens")
    write_tokens(docs, path, lambda: ChunkEncoder(PATH).encode)
    return sorted(tuple(r) for r in read_tokens(docs.sparkSession, path).collect())


def test_files_hold_all_documents_in_order(documents, sample, nasty):
    texts = [row["text"] for row in sample] + nasty
    ids = list(range(len(texts)))
    random.seed(2)
    random.shuffle(ids)
    want, start = [], 0
    for key, tokens in sorted(zip(ids, library_ids(texts))):
        data = np.array(tokens + [1], "<u4").tobytes()
        want.append((key, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert round_trip(documents(texts, ids)) == want


def test_empty_table_and_null_or_repeated_ids(documents):
    assert round_trip(documents(["a"]).limit(0)) == []
    docs = documents(["a b", None, "a b", "c"], [None, 4, 4, 4])
    path = shared_path(docs, "tokens")
    write_tokens(docs, path, lambda: ChunkEncoder(PATH).encode)
    got = sorted(read_tokens(docs.sparkSession, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 4, 4, 4]
    assert sorted(r.n_tokens for r in got) == [1, 2, 3, 3] and got[0].start == 0 and got[0].n_tokens == 3


def test_a_word_has_one_entry_whatever_stands_beside_it():
    encoder = ChunkEncoder(PATH)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    texts = [" ".join(w + mark for w in words) for mark in ("", ".", ",", "?!", "'s", "7")] + [" ".join(words).upper()]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == library_ids(texts)
    assert len(encoder.words) == len(words) + 5


def test_endings_digits_and_latin_letters_part_as_in_the_library():
    random.seed(8)
    texts = ["".join(random.choices("aabcstmdrevl'''  \n\t.!0129ßÀÖØÞÿéÈ\x00\x7f\x0b\xa0×", k=random.randint(0, 40))) for _ in range(4000)]
    encoder = ChunkEncoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == library_ids(texts)
    assert encoder.encode([]) == [] and encoder.encode([None, ""]) == [b"", b""]
