"""Stored postings against the search that reads all texts."""

import random

import pytest

from tripweave.operators import covers, postings, textsearch
from test_textsearch import QUERY_TEXTS, WORDS

ACTIVITIES = "activity_id long, name string, category string, indoor boolean, description string"
DOCUMENTS = "activity_id long, document_text string, embedding array<float>"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    activities = spark.createDataFrame(
        [(i, f"Tour {i % 7}", "food" if i % 5 else "Castle", True, "d") for i in range(60) if i != 9], ACTIVITIES)
    queries = spark.createDataFrame([*enumerate(QUERY_TEXTS), (90, " "), (91, "FOOD"), (92, "our 3")], "query_id long, q string")
    return activities, [(i, text or None, [1.0] if i % 2 else None) for i, text in enumerate(texts)], queries


def found(frame):
    return sorted((r.query_id, r.rank, r.activity_id, r.name, r.embedded, r.relevance) for r in frame.collect())


@pytest.mark.parametrize("stemmed", [True, False])
def test_an_index_in_generations_gives_the_rows_of_the_plain_search(spark, tables, tmp_path, stemmed):
    activities, rows, queries = tables
    path = str(tmp_path / "index")
    old = [(i, "old castle castles river" if i % 4 == 0 else text, None if i % 4 == 0 else vector) for i, text, vector in rows]
    assert postings.add_documents(spark.createDataFrame(old[:50], DOCUMENTS), path, stemmed=stemmed) == 1
    assert postings.add_documents(spark.createDataFrame([r for r in rows if r[0] % 4 == 0 or r[0] >= 50], DOCUMENTS), path, stemmed=stemmed) == 2
    want = found(textsearch.keyword_search(activities, spark.createDataFrame(rows, DOCUMENTS), queries, stemmed=stemmed))
    assert want and found(postings.search(spark, path, activities, queries, stemmed=stemmed)) == want
    if not stemmed:
        return
    gone = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "activity_id long")
    postings.remove_documents(gone, path)
    left = [row for row in rows if row[0] % 3]
    want = found(textsearch.keyword_search(activities, spark.createDataFrame(left, DOCUMENTS), queries))
    assert found(postings.search(spark, path, activities, queries)) == want
    postings.compact(spark, path, str(tmp_path / "new"))
    assert found(postings.search(spark, str(tmp_path / "new"), activities, queries)) == want
    before, after = (spark.read.parquet(f"{p}/postings").count() for p in (path, str(tmp_path / "new")))
    assert after < before


def test_a_search_lists_the_buckets_of_its_terms_only(spark, tables, tmp_path):
    _, rows, _ = tables
    path = str(tmp_path / "index")
    postings.add_documents(spark.createDataFrame(rows, DOCUMENTS), path)
    terms = spark.createDataFrame([("castl",), ("river",)], "term string")
    part = postings.term_postings(spark, path, terms, few=True)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan and "PushedFilters: [In(term, [castl,river])]" in plan
    assert "document_text" not in plan
    assert {r.term for r in part.collect()} == {"castl", "river"}
    few, many = (postings.term_postings(spark, path, terms, few).collect() for few in (True, False))
    assert sorted((r.doc_id, r.term, r.places) for r in few) == sorted((r.doc_id, r.term, r.places) for r in many)


def test_an_index_is_shuffled_once_and_packed(spark, tables, tmp_path, monkeypatch):
    """A row per word and document was stored and shuffled three times before."""
    _, rows, _ = tables
    documents = spark.createDataFrame(rows, DOCUMENTS).coalesce(2)
    settled = []
    monkeypatch.setattr(postings, "settle", lambda frame: settled.append(frame) or frame.checkpoint())
    made = postings._postings(documents, "activity_id", "document_text", True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan and not settled
    found = {(r.term, r.doc_id): r.places for r in made.collect()}
    plain = postings._postings(documents, "activity_id", "document_text", False).collect()
    assert len({(r.term, r.doc_id) for r in plain}) == len(plain) >= len(found)
    assert all(places == sorted(set(places)) for places in found.values())
    assert sorted((i, p) for (_, i), places in found.items() for p in places) == sorted((r.doc_id, p) for r in plain for p in r.places)


def test_postings_survive_packing():
    import numpy as np
    terms, documents = "a\nñ\n中文", np.array([5, 1 << 40, -3, 7], np.int64)
    data = postings._squeezed(terms, np.array([2, 1, 1]), documents, np.array([1, 3, 1, 2]), np.array([9, 0, 4, 8, 2, 70000, 70001], np.int32))
    words, parts = postings._unsqueezed(data)
    assert words == ["a", "ñ", "中文"] and [p.tolist() for p in parts] == [[2, 1, 1], documents.tolist(), [1, 3, 1, 2], [9, 0, 4, 8, 2, 70000, 70001]]


def test_only_the_best_rows_of_a_query_leave_a_task(spark, monkeypatch):
    """Each Arrow batch kept its own best rows before, nearly all of them where a batch holds few documents."""
    monkeypatch.setattr(covers, "WAITING_ROWS", 40)
    n = 300
    rows = [(i, q, f"n{i % 50:02d}" if q == 1 else None, 0, 0, 0, 1, 1, pos, False, True, True)
            for i in range(n) for q in (1, 2) for pos in range(1 + (i * q) % 4)]
    rows += [(i, None, f"n{i % 50:02d}", 0, 0, 0, 0, 0, 99, False, False, False) for i in range(n)]
    rows.sort(key=lambda r: r[0])
    hits = spark.createDataFrame(rows, "doc long, query long, name string, grp int, item int, off int, words int, needed int, pos int, minus boolean, simple boolean, ranked boolean").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        got = covers.score_hits(hits, "doc", "query", True, {}, 6, set()).collect()
        every = covers.score_hits(hits, "doc", "query", True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(every) == 2 * n and len(got) == 12
    for q in (1, 2):
        best = sorted(((-round(r.relevance, 6), r.name, r.doc) for r in every if r.query == q))[:6]
        assert sorted((-round(r.relevance, 6), r.name, r.doc) for r in got if r.query == q) == best


def test_relevances_that_round_alike_are_told_apart_by_name():
    import numpy as np
    order, unsure = covers._rounded(np.array([0.1 / 1000, 0.1 / 1001, 0.1 / 64, 0.1]))
    assert order[0] == order[1] and unsure.tolist() == [False, False, True, False]
