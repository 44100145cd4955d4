import random
import re
from collections import Counter

import numpy as np
import pytest

from tripweave.llm import collocations


def plain(docs, least, most_words, most_rows, covered=100):
    """Rows of brute force: every phrase counted, every cut tried."""
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\\n\\x0b\\x0c\\r]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, most_words + 1):
                for at in range(len(words) - size + 1):
                    counts[lang, tuple(words[at:at + size])] += 1
    found = {key: a for key, a in counts.items() if a >= least}
    out = {}
    for (lang, words), a in found.items():
        if len(words) < 2:
            continue
        if any(l2 == lang and len(w2) > len(words) and 100 * b >= covered * a
               and any(w2[i:i + len(words)] == words for i in range(len(w2))) for (l2, w2), b in found.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    rows = []
    for lang, each in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(each)[:most_rows], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(rows, key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "c", "New", "york", "city", "é", "x\u00a0y", "z"]
    out = []
    for _ in range(n):
        made = []
        for _ in range(rng.randint(0, 30)):
            made.append(rng.choice(words + ["new york city", "a b a b a"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]))
        out.append(("".join(made), rng.choice(["en", "en", "de", None])))
    return out + [(None, "en"), ("", None), ("a " * 300, "fr"), ("!!!", "en")]


@pytest.mark.parametrize("chunk,small", [(1 << 21, True), (50, True), (50, False)])
def test_rows_are_those_of_brute_force(spark, documents, rows, monkeypatch, chunk, small):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(collocations, "TEXT_BYTES", 100)
    monkeypatch.setattr(collocations, "HELD_WORDS", 2 * chunk)
    if not small:
        monkeypatch.setattr(collocations, "is_small", lambda rows, most=0: False)
    data = texts(chunk, 150)
    docs = documents([t for t, _ in data], lang=[l for _, l in data]).repartition(3)
    found = collocations.collocations(docs, least=5, most_words=5, most_rows=40)
    assert rows(found) == plain(data, 5, 5, 40)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_no_rows_and_nothing_frequent(documents, rows):
    assert rows(collocations.collocations(documents(["a b c"]))) == []
    assert rows(collocations.collocations(documents(["a"]).limit(0))) == []


def test_covered_phrases_go_at_any_share(spark, rows):
    phrases = spark.createDataFrame(
        [("en", "a b", 2, 10), ("en", "a b c", 3, 8), ("de", "a b", 2, 10), ("en", "b c", 2, 16)], "lang string, phrase string, size int, a bigint")
    kept = collocations.uncovered(phrases, covered=80)
    assert rows(kept.select("lang", "phrase")) == [("de", "a b"), ("en", "a b c"), ("en", "b c")]


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(3)
    for _ in range(5):
        a = rng.randint(100, 10**12)
        l, r, n = a + rng.randint(0, 10**13), a + rng.randint(0, 10**13), 10**15 + rng.randint(0, 10**14)
        phrases = spark.createDataFrame([("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)], "lang string, phrase string, size int, a bigint")
        totals = spark.createDataFrame([("en", n)], "lang string, n bigint")
        assert collocations.scored(totals, phrases).first().score == 1000 * a * n // (l * r)


def test_merge_join_stays_inside_pieces():
    place, left, right = collocations.joined(np.array([0, 1, 3, 4, 5]), np.array([7, 8, 9, 7, 8]))
    assert list(zip(place, left, right)) == [(0, 7, 8), (3, 9, 7), (4, 7, 8)]


def test_pairs_are_shuffled_in_a_row_per_task_and_bucket(spark):
    rng = np.random.default_rng(3)
    chunks = [(c, *(x.tolist() for x in (rng.permutation(4000) // 50 + (1 << 40), rng.permutation(4000), rng.integers(1, 9, 4000)))) for c in range(6)]
    relation = spark.createDataFrame(chunks, "chunk bigint, left array<bigint>, right array<bigint>, counts array<bigint>").coalesce(2)
    want = Counter()
    for _, left, right, counts in chunks:
        for a, b, n in zip(left, right, counts):
            want[a, b] += n
    shared = spark.sparkContext.broadcast(collocations.heavy_slots(relation, ["left", "right"], 8, 16))
    assert collocations.packed_pairs(relation, 16, 64, shared).count() <= 2 * 64
    frequent = collocations._grouped(relation, ["left", "right"], 8, 16, 24000)[1].collect()
    assert {(r.left, r.right): r.a for r in frequent} == {k: n for k, n in want.items() if n >= 8} and len(frequent) > 64
    assert len({r.id for r in frequent}) == len(frequent)


def test_slots_are_summed_by_few_tasks_before_the_shuffle(spark, monkeypatch):
    n = spark.sparkContext.defaultParallelism
    chunks = [(c, [c], [c + 1], [5]) for c in range(6 * n)]
    relation = spark.createDataFrame(chunks, "chunk bigint, left array<bigint>, right array<bigint>, counts array<bigint>").repartition(6 * n)
    sums = collocations.slot_sums(relation, ["left", "right"], 8, 16)
    assert 1 <= sums.count() <= n  # one page of slots
    monkeypatch.setattr(collocations, "TASK_WORDS", 1)
    assert collocations.slot_sums(relation, ["left", "right"], 8, 16, n_words=3 * n).count() > n
    assert collocations.heavy_slots(relation, ["left", "right"], 5, 16, n_words=3 * n).any()


def test_heavy_slots_come_by_one_job_whatever_the_partitions(spark):
    """Partitions fetched one after the other took most of the time where there are many of them."""
    relation = spark.createDataFrame([(c, [c], [c + 1], [5]) for c in range(8)],
                                     "chunk bigint, left array<bigint>, right array<bigint>, counts array<bigint>")
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    last_job = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        first = last_job()
        heavy = collocations.heavy_slots(relation, ["left", "right"], 5, 18)
        assert int(np.unpackbits(heavy).sum()) == 8
        assert last_job() - first < 10
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_a_task_holds_one_chunk_at_a_time(documents, monkeypatch):
    """Parquet wrote a hundred chunks before it looked at their size, and a reader took all of a row group: gigabytes where splits are large."""
    import pyarrow.parquet as pq
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 50)
    monkeypatch.setattr(collocations, "HELD_WORDS", 100)
    stored = []
    write = collocations.written
    monkeypatch.setattr(collocations, "written", lambda rows, kind, *held: stored.append((kind, write(rows, kind, *held))) or stored[-1][1])
    collocations.frequent_phrases(documents(["a b c a b c d " * 40] * 12).coalesce(1), least=5, most_words=3)
    kinds = {"words": 0, "phrases": 0}
    for kind, table in stored:
        if kind in kinds:
            for file in table.inputFiles():
                meta = pq.ParquetFile(file.removeprefix("file://")).metadata
                assert all(meta.row_group(i).num_rows <= 1 for i in range(meta.num_row_groups))
                kinds[kind] += meta.num_row_groups
    assert min(kinds.values()) > 10


def test_many_frequent_phrases_go_back_without_lists_in_memory(documents, monkeypatch):
    """The places of 128 chunks and more were collected as objects before, some 40 MB each."""
    docs = documents(["a b c a b c d " * 40] * 12)
    relation = collocations.occurrences(docs)
    rows, frequent = collocations._grouped(relation, ["lang", "word"], 5, 16, 3360)
    monkeypatch.setattr(collocations, "is_small", lambda rows, most=0: False)
    made = collocations.longer(relation, rows, frequent, ["lang", "word"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    assert sum(sum(r.counts) for r in made.collect()) == 12 * (7 * 40 - 1)
