"""Language identification in two steps: the family, then the language inside it.

Both steps vote among linear support vector machines, one for every two classes. Features
are the shares of hashed byte n-grams in a text's letters, so a text's margins are the means
of weights looked up at its positions: prediction runs over the bytes of many texts at once.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tripweave.llm.common import filter_texts, text_columns, written
from tripweave.operators.keyed import is_small, top_per_key

UNKNOWN = "und"
BITS = 13
GRAM = 3
#: Labelled documents of each language that training sees, whole.
SAMPLE_ROWS = 500
#: Labelled documents that training sees in all, and of each language however many languages there are.
TOTAL_ROWS, LEAST_ROWS = 16_000, 20
HASHES = 1 << 30
EPOCHS = 20
REGULAR = 1e-4
#: Added to the share of every n-gram, so that one never seen has a likelihood too.
SMOOTH = 1e-5
#: How far below the least likely labelled documents but a few a text may score, as a part of their score.
LEEWAY = 0.25
LOWEST = 0.005
WIDTH = (1 << BITS) + 1
BATCH = 64

# The families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be", "bs"),
    "uralic": ("fi", "et", "hu"), "baltic": ("lt", "lv"), "celtic": ("ga", "cy", "gd", "br"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"), "indic": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "iranian": ("fa", "ku", "ps", "tg"), "semitic": ("ar", "he", "mt", "am"), "malayic": ("id", "ms"),
}


def family_of(language: str) -> str:
    return next((family for family, members in FAMILIES.items() if language in members), language)


_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def gram_codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (1 to `GRAM` bytes) of lower-cased texts, n in rows, and their numbers.

    Bytes that are no letters count as spaces; runs of spaces are one. Every text is closed by
    a space on both sides.
    """
    column = pc.utf8_lower(pa.array([text or "" for text in texts], pa.string()))
    datas = [b" " + text.encode() + b" " for text in column.to_pylist()]
    lengths = np.fromiter(map(len, datas), np.int64, len(datas))
    raw = _LETTERS[np.frombuffer(b"".join(datas), np.uint8)]
    owner = np.repeat(np.arange(len(datas)), lengths)
    stays = np.append(True, (raw[1:] != 32) | (raw[:-1] != 32) | (owner[1:] != owner[:-1]))
    raw, owner = raw[stays].astype(np.uint32), owner[stays]
    counts = np.bincount(owner, minlength=len(datas))
    codes = np.zeros((GRAM, len(raw)), np.int32)
    code, inside = np.zeros(len(raw), np.uint32), np.ones(len(raw), bool)
    with np.errstate(over="ignore"):
        for n in range(GRAM):
            if n:
                inside[-n:] = False
                inside[:-n] &= owner[n:] == owner[:-n]
                code[:-n] = code[:-n] * np.uint32(257) + raw[n:]
            else:
                code = raw + np.uint32(1)
            mixed = ((code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B)
            codes[n] = np.where(inside, mixed >> np.uint32(32 - BITS), 1 << BITS)  # the last place weighs nothing
    return codes, counts


class Machines(NamedTuple):
    """Languages, their families, and a weight row and bias per pair of families, then of
    languages of one family. A pair is (step, first, second, classes' numbers). `typical` has a
    row per language: how much likelier it makes each n-gram than chance, as a logarithm."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    biases: np.ndarray
    typical: np.ndarray = np.zeros((0, 0), np.float32)


def margins(codes: np.ndarray, counts: np.ndarray, machines: Machines) -> np.ndarray:
    """The margin of every text (row) in every machine (column)."""
    starts = np.cumsum(counts) - counts
    out = np.zeros((len(counts), len(machines.pairs)))
    for m, row in enumerate(machines.weights):
        total = row[codes[0]]
        for n in range(1, GRAM):
            total = total + row[codes[n]]
        out[:, m] = np.add.reduceat(total, starts, dtype=np.float64) / counts + machines.biases[m]
    return out


def _vote(margin: np.ndarray, pairs: list, step: int, classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The class with most wins of each row (ties: the larger sum of margins, then the lower
    number), and how sure its machines are of it, as the least logistic of their margins."""
    wins, sums = np.zeros((len(margin), len(classes))), np.zeros((len(margin), len(classes)))
    place = {c: i for i, c in enumerate(classes)}
    held = [(m, place[a], place[b]) for m, (s, a, b) in enumerate(pairs) if s == step and a in place and b in place]
    for m, a, b in held:
        first = margin[:, m] >= 0
        wins[:, a] += first
        wins[:, b] += ~first
        sums[:, a] += margin[:, m]
        sums[:, b] -= margin[:, m]
    best = np.lexsort((-np.arange(len(classes))[None, :].repeat(len(margin), 0), sums, wins), axis=1)[:, -1]
    sure = np.ones(len(margin))
    for m, a, b in held:
        toward = np.where(best == a, margin[:, m], np.where(best == b, -margin[:, m], np.inf))
        sure = np.minimum(sure, 1 / (1 + np.exp(-np.clip(4 * toward, -60, 60))))
    return np.array(classes)[best], sure


def _named(texts: list, machines: Machines, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language, and its score."""
    margin = margins(codes, counts, machines)
    family, score = _vote(margin, machines.pairs, 0, list(range(len(machines.families))))
    language = np.zeros(len(texts), np.int64)
    for number, name in enumerate(machines.families):
        rows = np.flatnonzero(family == number)
        members = [i for i, code in enumerate(machines.languages) if family_of(code) == name]
        language[rows], inner = _vote(margin[rows], machines.pairs, 1, members)
        score[rows] = np.minimum(score[rows], inner)
    return language, score


def _with_letters(texts: list) -> np.ndarray:
    return pc.match_substring_regex(pa.array([t or "" for t in texts], pa.string()), r"\p{L}").to_numpy(
        zero_copy_only=False)


def predict(texts: list, machines: Machines) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; `und` with score 0 without letters or languages."""
    letters = _with_letters(texts)
    if not machines.languages or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    language, score = _named(texts, machines, *gram_codes(texts))
    named = [machines.languages[i] if has else UNKNOWN for i, has in zip(language, letters)]
    return named, np.where(letters, score, 0.0)


def _letter_shares(texts: list) -> np.ndarray:
    """Letters among the bytes of each text that are no ASCII space; without any, zero."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        out[i] = np.count_nonzero(_LETTERS[raw] != 32) / max(1, np.count_nonzero((raw != 32) & ((raw < 9) | (raw > 13))))
    return out


def likeness(texts: list, machines: Machines) -> np.ndarray:
    """How much each text reads like the language the machines name; -inf without a letter.

    The machines only tell languages apart: digits with one letter score 1. So this is the
    mean over a text's n-grams of how typical they are of that language, times the share of letters.
    Texts of any length are on one scale.
    """
    if not len(texts):
        return np.zeros(0)
    codes, counts = gram_codes(texts)
    language, _ = _named(texts, machines, codes, counts)
    row = np.repeat(language * machines.typical.shape[1], counts)
    flat = machines.typical.ravel()
    total = flat[row + codes[0]]
    for n in range(1, GRAM):
        total = total + flat[row + codes[n]]
    mean = np.add.reduceat(total, np.cumsum(counts) - counts, dtype=np.float64) / counts / GRAM
    return np.where(_with_letters(texts), mean * _letter_shares(texts), -np.inf)


class Shares(NamedTuple):
    """n-gram shares of texts as sparse rows: row i has those from start[i] to start[i + 1]."""

    start: np.ndarray
    place: np.ndarray
    value: np.ndarray

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), WIDTH), np.float32)
        sizes = self.start[rows + 1] - self.start[rows]
        at = np.arange(int(sizes.sum())) + np.repeat(self.start[rows] - (np.cumsum(sizes) - sizes), sizes)
        out[np.repeat(np.arange(len(rows)), sizes), self.place[at]] = self.value[at]
        return out

    def mean(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(WIDTH)
        for part in np.array_split(rows, -(-len(rows) // BATCH)):
            total += self.dense(part).sum(0, dtype=np.float64)
        return total / len(rows)


def _svm(features: Shares, rows: np.ndarray, signs: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """A linear machine by stochastic subgradient steps on the hinge loss, averaged over the
    second half of the steps. Both classes count alike, whatever their numbers of rows."""
    rng = np.random.default_rng(seed)
    w, mean_w, b, mean_b, step, kept = np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, 0, 0
    weight = np.where(signs > 0, len(signs) / (2 * max(1, (signs > 0).sum())), len(signs) / (2 * max(1, (signs < 0).sum())))
    batches = -(-len(signs) // BATCH)
    for epoch in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(signs)), batches):
            step += 1
            rate = 1 / (REGULAR * (step + 1 / REGULAR * 0.02))
            seen = features.dense(rows[some])
            short = signs[some] * (seen @ w.astype(np.float32) + b) < 1
            hurt = some[short]
            pull = (weight[hurt] * signs[hurt]) / len(some)
            w *= 1 - rate * REGULAR
            w += rate * (pull.astype(np.float32) @ seen[short])
            b += 0.1 * pull.sum()
            if 2 * epoch >= EPOCHS:
                mean_w += w
                mean_b += b
                kept += 1
    return mean_w / kept, mean_b / kept


def shares_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text and their counts, divided by its positions."""
    codes, counts = gram_codes([text])
    place, number = np.unique(codes, return_counts=True)
    held = place < 1 << BITS
    return place[held].astype("<u2"), (number[held] / max(1, counts[0])).astype("<f4")


def train(rows: list[tuple[str, bytes, bytes]]) -> Machines:
    """Machines for all pairs of families, and of languages inside a family, from the language and the
    `shares_of` each text."""
    languages = [row[0] for row in rows]
    known = sorted(set(languages))
    families = sorted({family_of(code) for code in known})
    sizes = np.array([len(row[1]) // 2 for row in rows])
    features = Shares(np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(row[1] for row in rows), "<u2"),
                      np.frombuffer(b"".join(row[2] for row in rows), "<f4"))
    of_language = np.array([known.index(code) for code in languages])
    means = np.stack([features.mean(np.flatnonzero(of_language == i)) for i in range(len(known))])
    typical = np.log((means / GRAM + SMOOTH) * (1 << BITS)).astype(np.float32)
    typical[:, -1] = 0
    everywhere = np.bincount(of_language) @ means / len(rows)
    spread = 1 / np.sqrt(everywhere + 1e-5)  # common n-grams must not drown the rest
    squares = np.bincount(features.place, features.value.astype(np.float64) ** 2, WIDTH) @ spread ** 2
    spread *= 1 / np.sqrt(squares / len(rows))
    features = features._replace(value=features.value * spread.astype(np.float32)[features.place])
    of_family = np.array([families.index(family_of(code)) for code in languages])
    pairs = [(0, a, b) for a, b in combinations(range(len(families)), 2)]
    pairs += [(1, a, b) for a, b in combinations(range(len(known)), 2) if family_of(known[a]) == family_of(known[b])]
    weights, biases = np.zeros((len(pairs), WIDTH), np.float32), np.zeros(len(pairs))
    for m, (step, a, b) in enumerate(pairs):
        classes = of_language if step else of_family
        some = np.flatnonzero((classes == a) | (classes == b))
        w, biases[m] = _svm(features, some, np.where(classes[some] == a, 1.0, -1.0), seed=m)
        weights[m] = w * spread
    return Machines(known, families, pairs, weights, biases, typical)


def learning_part(docs: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """Documents that may be learned from: labelled, and not of the held-out fold. A null id
    counts as held out."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder != fold))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, total_rows: int = TOTAL_ROWS) -> Machines:
    """Machines trained on at most `sample_rows` documents of each language, fewer where there are so
    many languages that all would be more than `total_rows` (but `LEAST_ROWS` of each).

    The documents of a language with the lowest hashes of id and text are taken; equal ones are one.
    Hashes are found and cut first, then the texts that have them are read. Tasks
    make the features, so what comes to the driver are sparse rows of bounded number and size. Texts
    without letters teach nothing and are left out; no labels give machines that know nothing.
    """
    hashed = labelled.filter(F.regexp_like("text", F.lit(r"\p{L}"))).select(
        "lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(HASHES)).alias("hash"))
    counts = written(hashed.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(LEAST_ROWS, min(sample_rows, total_rows // max(1, counts.count())))
    # of a large language only about four times as many as are wanted meet in the window
    few = hashed.select("lang", "hash").join(F.broadcast(counts) if is_small(counts) else counts, "lang").filter(
        F.col("hash") * F.col("n").cast("double") < 4.0 * each * HASHES).select("lang", "hash").distinct()
    chosen = top_per_key(few, ["lang"], [F.col("hash")], each).select("lang", "hash")
    part = hashed.join(F.broadcast(chosen) if is_small(chosen) else chosen, ["lang", "hash"]).dropDuplicates(["lang", "hash"])

    def make():
        def work(texts: list) -> list:
            made = [shares_of(text) for text in texts]
            return [[place.tobytes() for place, _ in made], [value.tobytes() for _, value in made]]
        return work

    rows = text_columns(part, make, [T.StructField("place", T.BinaryType()), T.StructField("value", T.BinaryType())],
                        ("lang", "hash")).collect()
    if not rows:
        return Machines([], [], [], np.zeros((0, 0), np.float32), np.zeros(0))
    return train([(row.lang, row.place, row.value) for row in sorted(rows, key=lambda row: (row.lang, row.hash))])


def predict_documents(docs: DataFrame, machines: Machines, fold: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, from its text alone.

    Texts of any length are read whole. Null texts and texts without a letter are `und` with
    score 0, and so is every text if nothing was learned. Null ids count as held out;
    repeated rows stay as they are, an empty table gives no rows, and further columns are
    not read.
    """
    def make():
        def work(texts: list) -> list:
            return list(predict(texts, machines))
        return work

    found = text_columns(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return found.select("doc_id", F.coalesce(remainder == fold, F.lit(True)).alias("held_out"), "lang_pred", "score")


def least_likeness(labelled: DataFrame, machines: Machines) -> float:
    """The line below which a text is of no learned language, from all labelled documents that have
    a letter, of every length: what all but `LOWEST` of a language's documents reach, for the lowest
    language, less `LEEWAY` of it, so that held-out ones a little below stay and a few documents with a
    wrong label don't move it. -inf if there are none."""
    if not machines.languages:
        return -np.inf

    def make():
        return lambda texts: [likeness(texts, machines)]

    like = text_columns(labelled, make, [T.StructField("like", T.DoubleType())], ("lang",)).filter(F.col("like") > -np.inf)
    lowest = like.groupBy("lang").agg(F.percentile_approx("like", LOWEST, 10_000).alias("like")).agg(F.min("like")).first()[0]
    return -np.inf if lowest is None else lowest - LEEWAY * abs(lowest)


def keep_known(docs: DataFrame, machines: Machines, least_score: float = 0.0, least_like: float = -np.inf) -> DataFrame:
    """Documents with a language, scored at least `least_score` and like it by at least
    `least_like`, with all their columns. If nothing was learned, nothing can be told and all stay."""
    if not machines.languages:
        return docs

    def make():
        def work(texts: list) -> list:
            like = likeness(texts, machines) if least_like > -np.inf else None
            if like is not None and least_score <= 0:
                return like >= least_like  # a text without a letter is below any line
            named, score = predict(texts, machines)
            kept = (np.array(named, object) != UNKNOWN) & (score >= least_score)
            return kept if like is None else kept & (like >= least_like)
        return work

    return filter_texts(docs, make)
