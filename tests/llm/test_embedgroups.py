import numpy as np
import pytest

from tripweave.llm import hnsw
from tripweave.llm.embedgroups import near_vectors


def unit(rows):
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def clustered(count, dims, seed, noise=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(count // 5 + 1, dims))
    return unit(centres[rng.integers(0, len(centres), count)] + noise * rng.normal(size=(count, dims)))


@pytest.mark.parametrize("count", [1, 2, 5, 63, 64, 65, 700, 3000])
def test_search_finds_nearest_vectors(count):
    vectors = clustered(count, 16, count, 0.3)
    graph = hnsw.Graph.from_bytes(hnsw.build(vectors).to_bytes())
    ids, sims = hnsw.search(graph, vectors, 48)
    k = min(10, count)
    true = np.argsort(-(vectors @ vectors.T), axis=1)[:, :k]
    assert np.mean([len(set(a[:k]) & set(b)) / k for a, b in zip(ids, true)]) > 0.97
    assert (ids[:, 0] == np.arange(count)).mean() > 0.99


def test_groups_larger_than_the_beam_are_found_whole():
    rng = np.random.default_rng(3)
    tight = unit(np.ones((900, 16)) + 0.01 * rng.normal(size=(900, 16)))
    vectors = np.concatenate([tight, clustered(1500, 16, 4, 0.5)])
    near, recall = hnsw.near_matrix(hnsw.build(vectors), None, 0.98)
    truth = vectors @ vectors.T >= 0.98
    assert recall >= hnsw.AUDIT_RECALL and not (near & ~truth).any()
    assert (near & truth).sum() / truth.sum() > 0.999


def test_two_graphs_find_each_other(monkeypatch):
    vectors = clustered(3000, 16, 9, 0.02)
    one, two = hnsw.build(vectors[:1400]), hnsw.build(vectors[1400:])
    truth = vectors[:1400] @ vectors[1400:].T >= 0.98
    near, recall = hnsw.near_matrix(one, two, 0.98)
    assert recall >= hnsw.AUDIT_RECALL and not (near & ~truth).any() and (near & truth).sum() / truth.sum() > 0.99
    monkeypatch.setattr(hnsw, "_fill_links", lambda *a: None)  # a search that finds nothing fails every audit
    assert (hnsw.near_matrix(one, two, 0.98)[0] == truth).all()


def brute_force(rows, least=0.98):
    able = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in able:
        for j in able:
            a, b = rows[i], rows[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    links[i].add(j)
    component = list(range(len(rows)))
    for start in range(len(rows)):
        stack, seen = [start], {start}
        while stack:
            for n in links[stack.pop()] - seen:
                seen.add(n)
                stack.append(n)
        ids = [rows[i][0] for i in seen if rows[i][0] is not None]
        component[start] = min(ids) if ids else None
    return sorted(((r[0], len(links[i]), component[i], r[0] == component[i]) for i, r in enumerate(rows)), key=repr)


def frame(spark, data):
    return spark.createDataFrame([(*row, 1, "x") for row in data],
                                 "vec_id bigint, embedding array<float>, label int, n_links int, kept string")


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_query_equals_brute_force(spark, rows, shard_rows):
    vectors = clustered(160, 8, 7, 0.05).astype(np.float32).tolist()
    data = [(i, v, i % 2) for i, v in enumerate(vectors)]
    data += [(1000 + i, vectors[0], 0) for i in range(30)]  # a group of copies
    data += [(2000, None, 0), (2001, [0.0] * 8, 0), (2002, [float("nan")] * 8, 0), (2003, [1.0, None] * 4, 0),
             (2004, vectors[0], None), (2005, [], 0), (2006, vectors[0][:4], 0), (2007, [2 * x for x in vectors[2]], 0),
             (2008, [float("inf")] * 8, 0), (None, vectors[0], 0), (5, vectors[5], 1), (2009, [1e-30] * 8, 1), (2010, [1e30] * 8, 1)]
    got = rows(near_vectors(frame(spark, data), shard_rows=shard_rows))
    assert got == brute_force(data)


def test_empty_table(spark):
    assert near_vectors(frame(spark, [(1, [1.0], 1)]).limit(0)).collect() == []


def test_shards_of_thousands_of_vectors_are_searched_by_their_graphs(spark, rows, monkeypatch):
    """Two labels of several thousand vectors, tight groups and rare pairs, over several shards: recall of links
    against all pairs, and no pair of vectors is compared in full but those audited."""
    rng = np.random.default_rng(11)
    sparse = unit(rng.normal(size=(3500, 24)))
    pairs = unit(sparse[:40] + 0.01 * rng.normal(size=(40, 24)))
    dense = clustered(3000, 24, 12, 0.02)
    data = [(i, v, 0) for i, v in enumerate(np.concatenate([sparse, pairs]).astype(np.float32).tolist())]
    data += [(10_000 + i, v, 1) for i, v in enumerate(dense.astype(np.float32).tolist())]
    got = {r[0]: r for r in rows(near_vectors(frame(spark, data), shard_rows=1500))}
    found = wanted = 0
    for label in (0, 1):
        ids = np.array([r[0] for r in data if r[2] == label])
        vectors = unit(np.array([r[1] for r in data if r[2] == label], np.float64))
        links = (vectors @ vectors.T >= 0.98).sum(1) - 1
        mine = np.array([got[i][1] for i in ids])
        assert (mine <= links).all()
        found, wanted = found + mine.sum(), wanted + links.sum()
        if label == 0:
            assert mine.sum() >= 0.9 * links.sum() >= 60
    assert found >= 0.99 * wanted


def test_the_graph_is_searched_for_the_smallest_labels_too(monkeypatch):
    searched = []
    real = hnsw._fill_links
    monkeypatch.setattr(hnsw, "_fill_links", lambda *a: (searched.append(len(a[1])), real(*a)))
    for count in (1, 2, 40, 300):
        vectors = clustered(count, 8, count, 0.05)
        near, recall = hnsw.near_matrix(hnsw.build(vectors), None, 0.98)
        assert (near == (vectors @ vectors.T >= 0.98)).all() and recall >= hnsw.AUDIT_RECALL
    assert set(searched) == {1, 2, 40, 300}
