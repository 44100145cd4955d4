import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tripweave.llm import contextmix as cm
from tripweave.llm.queries import QUERIES


def plain_tokens(text):
    return (text or "").encode().lower().split() + [b""]


def plain_base(data):
    """doc_id, held_out, n_tokens, n_known, train_tokens and base score, counted word by word."""
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in data]
    counts = Counter(w for (_, text), out in zip(data, held) if not out for w in plain_tokens(text))
    total = sum(counts.values())
    under = total + 0.5 * (len(counts) + 1)
    return [(i, out, len(plain_tokens(t)), sum(w in counts for w in plain_tokens(t)), total,
             sum(math.log10((counts[w] + 0.5) / under) for w in plain_tokens(t))) for (i, t), out in zip(data, held)]


def slow_score(text, model, table):
    """The log10 probability, decision by decision, with plain numbers."""
    data = cm.PAD + cm.text_bytes(text)
    hashes = cm.contexts(np.frombuffer(data, np.uint8))
    weights, seen = model.weights.astype(float).copy(), np.full(cm.GATES, cm.ADAPT_PRIOR)
    total, body = 0.0, range(len(cm.PAD), len(data))
    block = max(cm.BLOCK, -(-len(body) // cm.BLOCKS))
    for start in range(0, len(body), block):
        steps = []
        for at in body[start:start + block]:
            symbol = data[at]
            for k in range(model.code.length[symbol]):
                place, turn = (int(x[symbol * model.code.longest + k]) for x in (model.code.place, model.code.turn))
                mark = ((place + 1) * int(cm.MIX) % 2**64) >> 32
                slots = [(int(h[at]) + mark) % 2**32 >> 32 - width for h, width in zip(hashes, cm.widths(model.bits))]
                inputs = [int(table[c][slot]) / cm.STEP for c, slot in enumerate(slots)]
                gate = sum((x != 0) << c for c, x in enumerate(inputs))
                mixed = sum(weights[c, gate] * x for c, x in enumerate(inputs))
                likely = 1 / (1 + math.exp(-max(-20, min(20, mixed))))
                place_odds = round((max(-cm.REACH, min(cm.REACH, mixed)) + cm.REACH) * (cm.BUCKETS - 1) / (2 * cm.REACH))
                one = (likely + model.refined[place * cm.BUCKETS + place_odds]) / 2
                total += math.log10(one if turn else 1 - one)
                if (at - len(cm.PAD)) % cm.TEACH == 0:
                    steps.append((gate, inputs, turn, likely))
        change = np.zeros_like(weights)
        for gate, inputs, turn, likely in steps:
            seen[gate] += likely * (1 - likely) * sum(x * x for x in inputs)
            change[:, gate] += (turn - likely) * np.array(inputs)
        weights += change / seen
    return total


TEXTS = ["the cat sat on the mat. " * 20, "A cat and a dog, a Dog and a CAT.\n" * 9, "naïve straße \U0001f600 " * 12, "x", "", None,
         "\x00\x00 nul", "a\x85b  c\tdé"]


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(1)
    words = ["the", "cat", "dog", "sat", "straße", "on", "mat.", "and", "a"]
    data = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id bigint, text string, n_tokens int, held string").repartition(3)
    return data, docs, cm.fit(docs)


def odds_of(model):
    return [cm.odds(c[:, 0], c[:, 1]) for c in model.counts]


def test_scores_are_those_of_one_decision_after_the_other(learned, monkeypatch):
    monkeypatch.setattr(cm, "BLOCK", 40)
    model, texts = learned[2], TEXTS + [t for _, t in learned[0][:10]]
    table = odds_of(model)
    got = cm.score_texts(texts, model, table)
    assert np.allclose(got, [slow_score(t, model, table) for t in texts], rtol=1e-3)  # odds near the edge of a bucket
    assert np.allclose([cm.score_texts([t], model, table)[0] for t in texts], got, rtol=1e-5)  # company doesn't matter


def test_next_bytes_have_probability_one_together(learned):
    model = learned[2]
    table = odds_of(model)
    # texts that differ in their last byte alone: each byte's share of what the shorter text leaves
    first = "the ca"
    shares = []
    for symbol in range(256):
        data = first.encode() + bytes([symbol])
        code = model.code
        pack = [(0, cm.PAD, data)]
        found = cm.decisions(pack, code, model.bits)
        n = int(code.length[symbol])
        inputs = [t[s][-n:].astype(np.float32) / np.float32(cm.STEP) for t, s in zip(table, found.slots)]
        mixed = cm.Mixer(model.weights, 1).mixed(cm.gates(inputs), inputs)
        one = (cm.likelihood(mixed) + model.refined[cm.bucket_of(found.place[-n:], mixed)]) / 2
        shares.append(np.prod(np.where(found.turn[-n:] == 1, one, 1 - one)))
    assert abs(sum(shares) - 1) < 1e-5


def test_counts_are_those_of_all_learning_documents(learned):
    data, _, model = learned
    want = [np.zeros(counts.shape, np.int64) for counts in model.counts]
    for i, text in data:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            found = cm.decisions([(0, cm.PAD, cm.text_bytes(text))], model.code, model.bits)
            for k, slots in enumerate(found.slots):
                np.add.at(want[k], (slots, found.turn.astype(int)), 1)
    assert all((counts == wanted).all() for counts, wanted in zip(model.counts, want))


def test_code_weights_and_refinement_are_learned_from_all_learning_documents(spark):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choices(["tea", "cup", "milk", "on", "two", str(i)], k=6))) for i in range(6000)]
    model = cm.fit(spark.createDataFrame(data, "doc_id bigint, text string").coalesce(1))
    texts = [t for i, t in data if zlib.crc32(str(i).encode()) % 5 != 1]
    whole = np.bincount(np.frombuffer(b"".join(map(cm.text_bytes, texts)), np.uint8), minlength=256)
    assert (model.code.length == cm.make_code(whole).length).all() and (model.code.place == cm.make_code(whole).place).all()
    mixer, tries = cm.Mixer(np.full((cm.CONTEXTS, cm.GATES), cm.FIRST_WEIGHT), cm.LEARN_PRIOR), np.zeros((2, 256 * cm.BUCKETS))
    cm.learn_weights(texts, model.code, model.bits, [cm.odds_apart(c) for c in model.counts], mixer, tries)
    assert tries[0].sum() == (whole * model.code.length).sum()
    middle = cm.likelihood(np.tile(np.linspace(-cm.REACH, cm.REACH, cm.BUCKETS), 256))
    assert np.allclose(model.refined, (tries[1] + cm.REFINE_PRIOR * middle) / (tries[0] + cm.REFINE_PRIOR), atol=0.02)
    assert np.allclose(model.weights, mixer.weights, atol=0.02)


def test_windows_of_a_long_text_cover_it(monkeypatch, learned):
    model = learned[2]
    whole = cm.score_texts(["the cat sat " * 400], model, odds_of(model))[0]
    monkeypatch.setattr(cm, "PACK_BYTES", 1000)
    parts = [w for w in cm.windows(["the cat sat " * 400])]
    assert b"".join(p[2] for p in parts) == cm.text_bytes("the cat sat " * 400) and len(parts) == 5
    assert abs(cm.score_texts(["the cat sat " * 400], model, odds_of(model))[0] / whole - 1) < 0.2


@pytest.mark.parametrize("chunk", [1 << 21, 300])
def test_base_scores_and_columns(spark, learned, rows, monkeypatch, chunk):
    monkeypatch.setattr(cm, "CHUNK_WORDS", chunk)
    monkeypatch.setattr("tripweave.llm.common.SLICE_BYTES", 400)
    data = learned[0] + [(None, t) for t in TEXTS] + [(7, "twice"), (7, "twice"), (500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in data], "doc_id bigint, text string, c string, base_score int").repartition(3)
    found = cm.score_documents(docs, learned[2])
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = sorted(plain_base(data), key=repr)
    assert [(r[0], *r[1:5]) for r in got] == [w[:5] for w in want] or Counter(r[:5] for r in got) == Counter(w[:5] for w in want)
    assert np.allclose(sorted(r[5] for r in got), sorted(w[5] for w in want))
    assert all(r[6] < 0 for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, "abc"), (None, None)], "doc_id bigint, text string")
    model = cm.fit(docs)
    got = {r.n_tokens: r for r in cm.score_documents(docs, model).collect()}
    assert got[2].train_tokens == 0 and got[2].n_known == 0 and got[2].base_score == 0 and got[2].held_out
    assert abs(got[2].score + 32 * math.log10(2)) < 1e-6  # four bytes of eight even decisions
    assert cm.score_documents(docs.limit(0), model).collect() == []


def test_held_out_texts_are_scored_better_than_by_words_alone(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op13_lm_scores"](spark, folder).collect()
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {w[0]: w for w in plain_base(data)}
    assert len(rows) == len(data)
    for r in rows:
        assert tuple(r[:5]) == want[r.doc_id][:5] and abs(r.base_score - want[r.doc_id][5]) < 1e-6 * abs(r.base_score)
    held = [r for r in rows if r.held_out]
    n_bytes = sum(len((t or "").encode()) for i, t in data if want[i][1])
    bits_per_byte = -sum(r.score for r in held) / math.log10(2) / n_bytes
    assert bits_per_byte < 2.6
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)  # spaces and lines included, from two megabytes


def test_counts_come_by_one_job_whatever_the_partitions(spark):
    """Partitions fetched one after the other took a job each."""
    learning = spark.createDataFrame([(i, "tea and milk") for i in range(20)], "doc_id bigint, text string")
    code = cm.make_code(cm.histogram(learning))
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    last_job = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        first = last_job()
        counts = cm.count_slots(learning, code, cm.LEAST_BITS)
        assert last_job() - first < 10
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    n = sum(int(code.length[b]) for b in cm.text_bytes("tea and milk"))
    assert [int(c.sum()) for c in counts] == [20 * n] * cm.CONTEXTS


def test_equal_bytes_after_equal_contexts_are_counted_at_once(monkeypatch, learned):
    """Every decision was looked up and added by itself before, the costliest part of counting."""
    model, texts = learned[2], ["the cat sat on the mat. " * 300] * 5 + TEXTS
    added, slots = [], [1 << width for width in cm.widths(model.bits)]
    count = cm.np.add.at

    class Add:
        def at(self, total, at, times):
            added.append(len(at))
            count(total, at, times)

        def __getattr__(self, name):
            return getattr(np.add, name)

    class Numpy:
        add = Add()

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(cm, "np", Numpy())
    made = []
    for size in (cm.COUNT_BYTES, 5000):  # in one group and in many
        monkeypatch.setattr(cm, "COUNT_BYTES", size)
        made.append(np.zeros(2 * sum(slots), np.uint32))
        cm.add_counts(texts, model.code, model.bits, made[-1])
        if len(made) == 1:
            assert sum(added) < made[0].sum() / 20
    monkeypatch.undo()
    want = [np.zeros((n, 2), np.uint32) for n in slots]
    found = [cm.decisions([(0, cm.PAD, cm.text_bytes(text))], model.code, model.bits) for text in texts]
    for each in found:
        for into, at in zip(want, each.slots):
            np.add.at(into, (at, each.turn.astype(int)), 1)
    assert all((counts == np.concatenate(want).ravel()).all() for counts in made)


def test_words_are_split_as_by_bytes():
    texts = TEXTS + ["  two  spaces ", "\t\n\x0b\x0c\r", "\x1c\x1f a b ÉX Z", " x"]
    words, sizes = cm.split_words(cm.pa.array(["cut off", *texts])[1:])
    assert sizes.tolist() == [len(plain_tokens(t)) - 1 for t in texts]
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in plain_tokens(t)[:-1]]
    assert cm.split_words(cm.pa.array([], cm.pa.string()))[1].tolist() == []


def test_counts_beyond_16_bits_are_whole(spark, monkeypatch):
    """Both sides of a busy slot stopped at 65,535 before, so its odds were even and it counted as unknown."""
    data = [(i, "ab " * 4000 + "ac " * 1000) for i in range(60)]
    learning = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    code = cm.make_code(cm.histogram(learning))
    counts = cm.count_slots(learning, code, cm.LEAST_BITS)
    found = cm.decisions([(0, cm.PAD, cm.text_bytes(data[0][1]))], code, cm.LEAST_BITS)
    for slots, at in zip(counts, found.slots):
        want = np.zeros(slots.shape, np.int64)
        np.add.at(want, (at, found.turn.astype(int)), 60)
        assert (slots == want).all() and slots.max() > 65535
    apart = [cm.odds_apart(c) for c in counts]
    for slots, own in zip(counts, apart):
        zeros, ones = slots.astype(np.int64).T
        assert (own[::2] == cm.odds(np.maximum(zeros - 1, 0), ones)).all() and (own[1::2] == cm.odds(zeros, np.maximum(ones - 1, 0))).all()
    monkeypatch.setattr(cm, "MOST_HELD", 200_000)  # pages in several goes
    monkeypatch.setattr("tripweave.llm.common.SLICE_BYTES", 20_000)
    assert all((a == b).all() for a, b in zip(counts, cm.count_slots(learning, code, cm.LEAST_BITS)))


def test_all_bytes_before_the_last_block_teach(learned):
    pack = [(0, cm.PAD, cm.text_bytes("the cat sat " * 600)), (1, cm.PAD, cm.text_bytes("a dog"))]
    paths = cm.Paths(pack, learned[2].code)
    teaches = paths.teaching(pack)
    block = max(cm.BLOCK, -(-len(pack[0][2]) // cm.BLOCKS))
    assert teaches.sum() == block * (int(paths.blocks[0]) - 1) and paths.blocks.tolist()[1] == 1
