"""Keyword search against a plain-Python evaluation of the same rules."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plain_stems import stem_word
from tripweave.functions.text import STOP_WORDS, grams, probe_gram
from tripweave.operators import textsearch

WORDS = ["castle", "river", "museum", "tour", "the", "food", "and", "old", "castles", "tours"]


def split(text):
    return re.findall(r"[^\W_]+", text.lower())


def parse(query, stems=str):
    groups = [[]]
    for piece in re.findall(r'-?"[^"]*"?|[^\s"]+', query):
        if piece.lower() == "or":
            groups.append([])
            continue
        words = [(i, w) for i, w in enumerate(split(piece)) if w not in STOP_WORDS]
        if words:
            groups[-1].append((piece.startswith("-"), [(i - words[0][0], stems(w)) for i, w in words]))
    return [g for g in groups if g]


def evaluate(query, text, stems=str):
    """(matches, relevance) by looking at every interval of the text."""
    words, groups = [stems(w) for w in split(text)], parse(query, stems)

    def places(item):
        return [s for s in range(len(words)) if all(
            s + o < len(words) and words[s + o] == w for o, w in item)]

    matched = any(all(bool(places(item)) != minus for minus, item in g) for g in groups)
    covers = set()
    for g in groups:
        plain = [item for minus, item in g if not minus]
        if plain:
            for starts in itertools.product(*[places(item) for item in plain]):
                covers.add((min(starts), max(s + item[-1][0] for s, item in zip(starts, plain))))
    minimal = [c for c in covers if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in covers)]
    ranked = {w for g in groups for minus, item in g if not minus for _, w in item}
    score = sum(0.1 / (1 + sum(words[p] not in ranked for p in range(a, b + 1))) for a, b in minimal)
    return matched, round(score, 6)


QUERY_TEXTS = [
    "castle", "castle river", '"castle river"', "castle or museum", "castle -river", "-castle", "the",
    "the -food", '"castle the river"', '-"castle river" tour', "castle or river food", "castle castle",
    "castle or castle", "Castle-River", "old -castle or food", 'museum"food tour"', "or castle or", "nowhere",
    "-castle or river", '"old old"', "castle or castles", '"castles river"', "castling -towers or touring", "castle river tour", '"river castle" or "castle river"', "CASTLE",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    return made + ["", "x " * 3000 + "castle"]


@pytest.mark.parametrize("few,stemmed", [(True, False), (False, False), (True, True), (False, True)])
def test_match_and_rank(spark, texts, few, stemmed):
    documents = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(QUERY_TEXTS)), "query_id long, q string")
    terms = textsearch.search_terms(queries, stemmed=stemmed)
    if stemmed:
        terms = textsearch.with_forms(terms, documents, "text", few)
    got = {(r["query_id"], r["id"]): (r["matched"], r["relevance"]) for r in textsearch.rank(
        textsearch.word_hits(documents, terms, "id", "text", few), "id").collect()}
    for (q, query), (d, text) in itertools.product(enumerate(QUERY_TEXTS), enumerate(texts)):
        matched, score = evaluate(query, text, stem_word if stemmed else str)
        assert got.get((q, d), (False, 0.0)) == (matched, pytest.approx(score, abs=2e-6)), (query, text)


def test_substrings(spark, rows):
    names = ["River Walk", "walk", "100% fun", "a_b", "Ünder", "ab"]
    terms = ["walk", "ER W", "%", "_", "0%", "k", "", "ü", "a%k", "\\%", "ver\\walk", "zzz"]
    table = spark.createDataFrame(
        [(i, n, None if i else "walkers") for i, n in enumerate(names)], "id long, name string, category string")
    queries = spark.createDataFrame(list(enumerate(terms)), "query_id long, q string")

    def like(term, value):
        out, i = "", 0
        while i < len(term):
            if term[i] == "\\" and i + 1 < len(term):
                out, i = out + re.escape(term[i + 1]), i + 1
            else:
                out += {"%": ".*", "_": "."}.get(term[i], re.escape(term[i]))
            i += 1
        return re.search(out, value, re.I | re.S) is not None

    expected = sorted((q, i) for q, term in enumerate(terms) for i, n in enumerate(names)
                      if like(term, n) or (i == 0 and like(term, "walkers")))
    for few in (True, False):
        assert rows(textsearch.substring_matches(table, queries, "id", ["name", "category"], few)) == expected


def test_every_match_has_the_probe_gram(spark):
    frame = spark.createDataFrame([("River Walk", "er w"), ("abc", "b"), ("x", "%")], "v string, q string")
    for r in frame.select(grams(F.col("v")).alias("g"), probe_gram(F.col("q")).alias("p")).collect():
        assert r["p"] in r["g"]


def test_search_orders_and_cuts(spark, rows):
    activities = spark.createDataFrame(
        [(i, f"Tour {i}" if i < 9 else "Castle", "food" if i == 8 else "x", True, "d") for i in range(10)],
        "activity_id long, name string, category string, indoor boolean, description string")
    documents = spark.createDataFrame(
        [(i, "castle " * (i % 3) + "words", None) for i in range(9)],
        "activity_id long, document_text string, embedding array<float>")
    queries = spark.createDataFrame([(1, " castle "), (2, "  "), (3, "FOOD"), (4, "tour")], "query_id long, q string")
    got = textsearch.keyword_search(activities, documents, queries)
    assert rows(got.filter("query_id = 1"), "rank", "activity_id", "relevance") == [
        (1, 2, 0.2), (2, 5, 0.2), (3, 8, 0.2), (4, 1, 0.1), (5, 4, 0.1), (6, 7, 0.1)]
    assert rows(got.filter("query_id = 3"), "activity_id", "relevance") == [(8, 0.0)]
    plural = spark.createDataFrame([(5, "castles")], "query_id long, q string")
    assert textsearch.keyword_search(activities, documents, plural).count() == 6
    assert textsearch.keyword_search(activities, documents, plural, stemmed=False).count() == 0
    assert rows(got.filter("query_id = 4"), "rank", "activity_id") == [(i + 1, i) for i in range(6)]
    assert got.filter("query_id = 2").count() == 0
