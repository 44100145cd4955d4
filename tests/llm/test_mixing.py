import random
import re

import duckdb
import pytest

from tripweave.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(words):
    """Targets by taking the excess off full sources and dealing it out again and again."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = float(sum(words.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * words[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * words[s]
            left -= target[s]
        open_ -= full
    return target


def corpus(documents, count=900, seed=1):
    random.seed(seed)
    sources = random.choices(["a", "b", "c", "d", "É", None, "tiny"], [60, 20, 10, 5, 3, 2, 0.3], k=count)
    texts = [" ".join("w" * random.randint(1, 9) for _ in range(int(random.lognormvariate(3, 1)))) for _ in range(count)]
    texts[::50] = [None if i % 2 else " \n\x0b" for i in range(len(texts[::50]))]
    return documents(texts, source=sources), texts, sources


def test_targets_are_met_and_no_document_is_taken_too_often(documents):
    docs, texts, sources = corpus(documents)
    size = [len(WORD.findall(t or "")) for t in texts]
    words = {}
    for s, n in zip(sources, size):
        words[s] = words.get(s, 0) + n
    target = plain_targets(words)
    got = {r.doc_id: r for r in mixing.mix_counts(docs).collect()}
    taken = dict.fromkeys(words, 0)
    for i, s in enumerate(sources):
        r = got[i]
        assert (r.size, r.source_size) == (size[i], words[s]) and r.target == pytest.approx(target[s])
        assert r.taken == r.size * r.copies <= 3 * r.size
        taken[s] += r.taken
    for s in words:
        assert abs(taken[s] - target[s]) <= max([n for n, o in zip(size, sources) if o == s]) / 2 + 1e-6
    assert len(got) == len(texts)


def test_same_rows_in_any_order_give_the_same_mix(documents, rows):
    docs, _, _ = corpus(documents, 300, 2)
    assert rows(mixing.mix_counts(docs)) == rows(mixing.mix_counts(docs.repartition(5).orderBy("n_tokens", "text")))


def test_inclusion_follows_the_odds(documents):
    """Over many seeds a document is drawn about as often as its expected copies say."""
    docs, texts, sources = corpus(documents, 120, 3)
    runs = 6
    drawn = {}
    for seed in range(runs):
        for r in mixing.mix_counts(docs, seed=str(seed)).collect():
            drawn[r.doc_id] = drawn.get(r.doc_id, 0) + r.copies
    a = [i for i, s in enumerate(sources) if s == "a" and len(WORD.findall(texts[i] or "")) > 0]
    long_ones = [i for i in a if len(WORD.findall(texts[i])) > 30]
    short_ones = [i for i in a if len(WORD.findall(texts[i])) < 10]
    mean = lambda ids: sum(drawn[i] for i in ids) / len(ids) / runs
    assert mean(long_ones) > mean(short_ones) > 0


def test_bins_do_not_change_the_mix(documents, rows, monkeypatch):
    docs, _, _ = corpus(documents, 400, 4)
    fine = rows(mixing.mix_counts(docs))
    monkeypatch.setattr(mixing, "BINS", 3)
    assert rows(mixing.mix_counts(docs)) == fine


def test_sql_twin_agrees_on_odd_sources(documents):
    docs, _, _ = corpus(documents, 500, 5)
    con = duckdb.connect()
    con.register("frame", docs.toPandas()[["doc_id", "text", "source"]])
    con.execute("CREATE TABLE documents AS SELECT * FROM frame")
    result = con.execute(mixing.SQL)
    names = [c[0] for c in result.description]
    key = lambda r: r[names.index("doc_id")]
    want = sorted(result.fetchall(), key=key)
    got = sorted((tuple(r) for r in mixing.mix_counts(docs).select(*names).collect()), key=key)
    at = names.index("target")
    assert [r[:at] + r[at + 1:] for r in got] == [r[:at] + r[at + 1:] for r in want]
    assert [r[at] for r in got] == pytest.approx([r[at] for r in want])


def test_mixed_documents_are_whole_rows(documents, rows):
    docs, _, _ = corpus(documents, 300, 6)
    copies = {r.doc_id: r.copies for r in mixing.mix_counts(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert rows(mixed) == sorted((tuple(r) for r in docs.collect() for _ in range(copies[r.doc_id])), key=repr)


def test_empty_and_wordless_tables(documents):
    assert mixing.mix_counts(documents(["a"]).limit(0)).collect() == []
    assert mixing.mix_documents(documents(["a"]).limit(0)).collect() == []
    got = mixing.mix_counts(documents([None, "", None], [1, None, 1])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3


def test_a_source_of_repeated_rows_meets_its_target(documents, rows):
    """400 equal rows are a large part of one source; the cut goes through them."""
    texts = ["w " * 50] * 400 + [" ".join(["x"] * (5 + i % 40)) for i in range(300)] + ["y " * 30] * 200
    sources = ["a"] * 400 + ["a"] * 100 + ["b"] * 200 + ["c"] * 200
    ids = [7] * 400 + list(range(1000, 1300)) + [None] * 200
    docs = documents(texts, ids, source=sources).repartition(5)
    found = mixing.mix_counts(docs).collect()
    assert len(found) == 900
    for source in "abc":
        size = [len(t.split()) for t, s in zip(texts, sources) if s == source]
        mine = [r for r in found if r.source_size == sum(size)]
        assert len(mine) == len(size)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(size) / 2 + 1e-6
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in found)
    con = duckdb.connect()
    con.register("frame", docs.toPandas()[["doc_id", "text", "source"]].astype({"doc_id": "Int64"}))
    con.execute("CREATE TABLE documents AS SELECT * FROM frame")
    result = con.execute(mixing.SQL)
    names = [c[0] for c in result.description]
    place = [names.index(n) for n in ("doc_id", "size", "taken")]
    want = sorted((tuple(r[i] for i in place) for r in result.fetchall()), key=repr)
    assert sorted(((r.doc_id, r.size, r.taken) for r in found), key=repr) == want
