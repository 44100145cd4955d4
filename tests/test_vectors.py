"""Embedding properties and cosine search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripweave.operators import vectors

DOCS = "doc_id long, place string, embedding array<float>"
QUERIES = "query_id long, place string, k int, embedding array<float>"


def brute(docs, queries, k):
    found = []
    for q, place, _, qv in queries:
        scored = []
        for d, where, dv in docs:
            if where == place and dv is not None and np.any(dv):
                a, b = np.float32(dv).astype(float), np.float32(qv).astype(float)
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), d))
        found += [(q, i, d) for i, (_, d) in enumerate(sorted(scored)[:k(q)], 1)]
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    vec = lambda: [float(x) for x in rng.normal(size=16)]
    docs = [(i, "hot" if i % 3 else "Cold", vec()) for i in range(400)]
    docs += [(400 + i, "hot", docs[1][2]) for i in range(30)]     # equal vectors: the id decides
    docs += [(500, "hot", None), (501, "hot", [0.0] * 16), (502, "cold", vec())]
    queries = [(q, "hot" if q % 2 else "Cold", q - 1, docs[q][2] if q == 1 else vec()) for q in range(14)]
    return docs, queries


@pytest.mark.parametrize("broadcast", [True, False])
def test_exact_search_is_brute_force(spark, rows, sample, monkeypatch, broadcast):
    monkeypatch.setattr(vectors, "is_small", lambda *_: broadcast)
    docs, queries = sample
    d, q = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(queries, QUERIES)
    got = vectors.cosine_top_k(d, q, ["place"])
    assert rows(got, "query_id", "rank", "doc_id") == brute(docs, queries, lambda _: 5)
    limited = vectors.cosine_top_k(d, q, ["place"], limit="k")
    assert rows(limited, "query_id", "rank", "doc_id") == brute(docs, queries, lambda n: max(1, min(10, n - 1)))


def test_query_blocks_are_cut(spark, rows, sample, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    docs, queries = sample
    got = vectors.cosine_top_k(spark.createDataFrame(docs, DOCS), spark.createDataFrame(queries, QUERIES), ["place"])
    assert rows(got, "query_id", "rank", "doc_id") == brute(docs, queries, lambda _: 5)


def test_semantic_search_respects_letter_case_and_rounds(spark, rows):
    documents = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0])],
                                      "activity_id long, embedding array<float>")
    activities = spark.createDataFrame(
        [(1, "Lisbon", "a", "c", True, "d"), (2, "Lisbon", "b", "c", False, "d"), (3, "lisbon", "x", "c", True, "d")],
        "activity_id long, destination_name string, name string, category string, indoor boolean, description string")
    queries = spark.createDataFrame([(7, "Lisbon", [2.0, 0.0])], "query_id long, destination_name string, embedding array<float>")
    assert rows(vectors.semantic_search(documents, activities, queries), "rank", "name", "similarity") == [
        (1, "a", 1.0), (2, "b", 0.7071)]


def test_approximate_search(spark, rows, sample, tmp_path):
    docs, queries = sample
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(queries, QUERIES)
    exact = vectors.cosine_top_k(d, q, ["place"])
    middle = vectors.train_cells(d, "doc_id", "embedding", cells=8)
    assert middle.shape == (8, 16)
    vectors.write_by_cell(d, str(tmp_path / "cells"), "embedding", middle)
    celled = spark.read.parquet(str(tmp_path / "cells"))
    assert celled.count() == 2 * sum(row[2] is not None for row in docs)
    assert rows(vectors.approximate_top_k(celled, q, ["place"], middle, 8)) == rows(exact)
    probes = vectors.tuned_probes(d, q, ["place"], middle, "doc_id")
    near = vectors.approximate_top_k(celled, q, ["place"], middle, probes)
    total = vectors.recall(exact, near).agg(F.sum("found"), F.sum("expected")).first()
    assert 0.9 <= total[0] / total[1] <= 1
    read = {r.query_id: (r.rows_read, r.rows_all) for r in vectors.rows_read(celled, q, ["place"], middle, probes).collect()}
    assert len(read) == len(queries) and all(0 < a <= b for a, b in read.values())


def test_cells_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    got = vectors.train_cells(spark.createDataFrame(data, "id long, v array<double>"), "id", "v", cells=5, rounds=3)
    unit = [np.array(v) / np.linalg.norm(v) for _, v in data]
    middle = [np.round(u, 6) for u in unit[:5]]
    for _ in range(3):
        own = [int(np.argmax([round(float(u @ m), 9) for m in middle])) for u in unit]
        for cell in range(5):
            members = [u for u, o in zip(unit, own) if o == cell]
            if members:
                mean = np.mean(members, axis=0)
                middle[cell] = np.round(mean / np.linalg.norm(mean), 6)
    np.testing.assert_allclose(got, middle, atol=1e-6)
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert vectors.train_cells(empty, "id", "v").size == 0


def test_only_probed_cells_are_listed(spark, tmp_path, sample):
    docs, queries = sample
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(queries[:1], QUERIES)
    middle = vectors.train_cells(d, "doc_id", "embedding", cells=8)
    vectors.write_by_cell(d, str(tmp_path / "cells"), "embedding", middle)
    part = vectors.read_cells(spark.read.parquet(str(tmp_path / "cells")), vectors.probed(q, middle, 2))
    assert "PartitionFilters: [cell#" in part._jdf.queryExecution().executedPlan().toString()
    assert {r.cell for r in part.select("cell").distinct().collect()} == {
        r.cell for r in vectors.probed(q, middle, 2).collect()}


def test_hashed_embedding(spark):
    frame = spark.createDataFrame(
        [(1, "The castle and the river"), (2, "castle RIVER"), (3, "the of"), (4, ""), (5, None),
         (6, "word " * 30000 + "last")], "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in vectors.embed(frame, "text", ["id"]).collect()}
    assert all(len(v) == 384 for v in got.values())
    np.testing.assert_allclose([np.linalg.norm(got[i]) for i in (1, 2, 3, 4, 5, 6)], [1, 1, 0, 0, 0, 1], atol=1e-6)
    np.testing.assert_array_equal(got[1], got[2])
    assert np.count_nonzero(got[6]) == 2      # the last word of a long text counts


def test_model_function(spark):
    frame = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    got = vectors.embed(frame, "text", ["id"], encode=lambda texts: np.array([[len(t), 0.0] for t in texts]), dim=2)
    assert {r["id"]: list(r["embedding"]) for r in got.collect()} == {1: [1.0, 0.0], 2: [1.0, 0.0]}
    wrong = vectors.embed(frame, "text", ["id"], encode=lambda texts: np.zeros((len(texts), 3)), dim=2)
    with pytest.raises(Exception, match="vectors need 2 dimensions"):
        wrong.collect()


def test_texts_and_queries_are_worked_on_in_bounded_parts(spark):
    seen = spark.sparkContext.accumulator(0)

    def encode(texts):
        seen.add(len(texts) > vectors.EMBED_ROWS)
        return np.eye(384)[[int(t) % 384 for t in texts]]

    rows = spark.range(5000).selectExpr("id", "cast(id as string) AS text", "1 AS k").coalesce(1)
    made = vectors.embed(rows, "text", ["id", "k"], encode=encode)
    asked = made.filter("id < 300").withColumnRenamed("id", "query_id")
    got = vectors.cosine_top_k(made, asked, ["k"], doc_id="id").collect()
    want = {(q, r + 1, q % 384 + 384 * r, 1.0) for q in range(300) for r in range(5)}
    assert {tuple(r) for r in got} == want and seen.value == 0
