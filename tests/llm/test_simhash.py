import random

import numpy as np
import xxhash

from tripweave.llm import simhash
from tripweave.llm.components import connected_components


def plain_print(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(prints, budget):
    """Lowest key reachable of each key, all pairs tried."""
    keys = list(prints)
    label = {k: k for k in keys}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprints_of_odd_and_real_texts(spark, documents, nasty, sample):
    texts = nasty + [r["text"] for r in sample] + ["a b c " * 400, "one", "one two", "A\x0bB\x1cC d e"]
    got = {r.doc_id: r.fp for r in simhash.fingerprints(documents(texts)).collect()}
    assert [got[i] & (2**64 - 1) for i in range(len(texts))] == [plain_print(t) for t in texts]


def near_values(count, seed):
    random.seed(seed)
    values = [random.getrandbits(64) for _ in range(count // 4)]
    while len(values) < count:
        value = random.choice(values)
        for bit in random.sample(range(64), random.randint(1, 4)):
            value ^= 1 << bit
        values.append(value)
    return sorted(set(values))


def test_trie_pairs_are_all_pairs_within_the_budget(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    values = np.array(near_values(300, 1) + near_values(80, 2), np.uint64)
    values = np.unique(values)
    starts, ends = np.array([0, 100]), np.array([100, len(values)])
    for budget in (0, 1, 2, 3):
        got = [(int(a), int(b)) for x in simhash.trie_pairs(values, starts, ends, budget) for a, b in zip(*x)]
        want = [(i, j) for s, e in zip(starts, ends) for i in range(s, e) for j in range(i + 1, e)
                if int(values[i] ^ values[j]).bit_count() <= budget]
        assert sorted((min(p), max(p)) for p in got) == want and len(set(got)) == len(got)


def test_links_join_the_same_groups_as_all_pairs(spark):
    values = near_values(900, 3)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for bucket_rows in (20_000, 60):  # the second deals most buckets a second time
        members = connected_components(simhash.near_links(frame, 2, bucket_rows), "a", "b").collect()
        label = {r.node: r.component for r in members}
        want = plain_groups(dict(zip(signed, values)), 2)
        assert {v: label.get(v, v) for v in signed} == {
            k: min(x for x in signed if want[x] == want[k]) for k in signed}


def test_components_of_chains_stars_and_loops(spark, rows):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5), (301, 300), (300, 301)]
    got = rows(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b"))
    assert got == sorted([(i, 0) for i in range(61)] + [(i, 100) for i in range(100, 160)] + [(300, 300), (301, 300)], key=repr)
    assert rows(connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b")) == []


def copies(sample):
    texts = [r["text"] for r in sample[:60]]
    near = [t + " tail" for t in texts[:20]] + [t.upper() for t in texts[:5]] + texts[:3] * 4
    return texts + near + [None, "", " \n"]


def test_query_equals_brute_force(documents, sample, rows):
    texts = copies(sample)
    docs = documents(texts, [*range(1000, 1000 + len(texts) - 1), None])
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    groups = plain_groups(prints, 2)
    ids = {i: 1000 + i if i < len(texts) - 1 else None for i in prints}
    want = sorted(((ids[i], f"{prints[i]:016x}", ids[groups[i]]) for i in prints), key=repr)
    assert rows(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_one_row_of_each_group_stays(documents, sample, rows):
    texts = copies(sample) + [sample[61]["text"]] * 3 + [sample[62]["text"]] * 2
    ids = [*range(len(texts) - 5), 900, 900, 900, None, None]
    docs = documents(texts, ids)
    groups = plain_groups({i: plain_print(t) for i, t in enumerate(texts)}, 2)
    got = rows(simhash.keep_one_of_each(docs))
    assert [r[:2] for r in got] == sorted(((ids[i], texts[i]) for i in sorted(set(groups.values()))), key=repr)
    assert simhash.keep_one_of_each(docs).columns == docs.columns
    assert simhash.keep_one_of_each(docs.limit(0)).collect() == []


def test_columns_of_any_name_and_type_stay(spark, rows):
    data = [(1, "a b c d", 5, [{"k": 1}]), (2, "a b c d", 6, None), (3, "other words here now", None, [{}]),
            (3, "other words here now", None, [{}])]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, _key int, _row array<map<string,int>>")
    kept = simhash.keep_one_of_each(docs.withColumnRenamed("_row", "row").withColumn("key", docs["_key"]).withColumn("doc", docs["_key"]))
    assert sorted((r.doc_id, r._key, r.key, r.doc) for r in kept.collect()) == [(1, 5, 5, 5), (3, None, None, None)]
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == [1, 3]
