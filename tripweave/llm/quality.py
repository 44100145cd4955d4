"""Quality rules: base counts of a text, and how much it reads like trusted text.

The verdict is a log-likelihood ratio between two multinomials over hashed word n-grams, one
counted over all trusted documents, one over the raw corpus, divided by the number of
n-grams. No draw takes part: a document is kept if its ratio is not below a line that the
two multinomials give for its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tripweave.llm.common import bound_batches, filter_texts, slices, text_columns
from tripweave.operators.keyed import is_small

BUCKET_BITS = 16
#: Counts that every bucket has on top of those found, in the corpus's own proportions.
SMOOTHING = 10.0
LINE_SLACK = 0.15
LINE_SIGMAS = 4.0
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
# Characters that part words, and characters counted as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

BASE_FIELDS = [T.StructField(name, T.LongType()) for name in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


class Words(NamedTuple):
    """The words of a slice of texts in one sequence: checksums, hashes, and words per text."""

    checksums: np.ndarray
    hashes: np.ndarray
    lengths: np.ndarray


def split_words(texts: list) -> Words:
    split = [(text or "").encode().split() for text in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = [word for words in split for word in words]
    return Words(np.fromiter(map(zlib.crc32, flat), np.uint32, len(flat)),
                 np.fromiter(map(hash, flat), np.int64, len(flat)), lengths)


def repeated_words(words: Words, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text: words that lie in a window of words found twice or more in that text.

    Windows meet by a 64-bit hash of their words and their text; equal ones are neighbours
    once sorted.
    """
    total, texts = len(words.hashes), len(words.lengths)
    owner = np.repeat(np.arange(texts), words.lengths)
    if total < window:
        return np.zeros(texts, np.int64)
    with np.errstate(over="ignore"):
        hashes, step = words.hashes.view(np.uint64), np.uint64(0x9E3779B97F4A7C15)
        count = total - window + 1
        key = owner[:count].astype(np.uint64)
        for k in range(window):
            key = (key ^ (key >> np.uint64(29))) * step + hashes[k:k + count]
    inside = np.flatnonzero(owner[:count] == owner[window - 1:])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    repeated = np.zeros(total + 1, np.int64)
    hit = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    repeated[hit] += 1
    covered = np.cumsum(repeated)
    covered[window:] -= covered[:-window].copy()
    return np.bincount(owner, covered[:total] > 0, minlength=texts).astype(np.int64)


def base_counts(texts: list, words: Words) -> list:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    word_chars, symbols, dup_lines = [], [], []
    for text in texts:
        text = text or ""
        word_chars.append(len(text) - sum(map(text.count, SPACES)))
        symbols.append(sum(map(text.count, SYMBOLS)))
        lines = [line for line in text.split("\n") if line.strip(SPACES)]
        dup_lines.append(len(lines) - len(set(lines)))
    return [words.lengths, word_chars, symbols, dup_lines, repeated_words(words)]


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def gram_buckets(words: Words, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all single words and word pairs of a slice of texts, and the text of each."""
    owner = np.repeat(np.arange(len(words.lengths)), words.lengths)
    with np.errstate(over="ignore"):
        one = (words.checksums.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (one[:-1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        two = (two ^ (two >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    inside = owner[:-1] == owner[1:]
    shift = np.uint64(64 - bits)
    buckets = np.concatenate([one >> shift, two[inside] >> shift]).astype(np.int64)
    return buckets, np.concatenate([owner, owner[:-1][inside]])


class Ratio(NamedTuple):
    """The log ratio of each bucket, and its mean and spread under the trusted multinomial."""

    weights: np.ndarray
    mean: float
    sigma: float

    def line(self, grams: np.ndarray) -> np.ndarray:
        """The lowest ratio kept at a number of n-grams: what trusted text of that length
        reaches but for chance, and a fixed slack for texts that differ from the average."""
        return self.mean - LINE_SLACK - LINE_SIGMAS * self.sigma / np.sqrt(np.maximum(grams, 1))

    def judge(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ratio per n-gram of each text (0 without words), and whether it is kept."""
        buckets, owner = gram_buckets(words, int(len(self.weights)).bit_length() - 1)
        texts = len(words.lengths)
        grams = np.bincount(owner, minlength=texts)
        score = np.bincount(owner, self.weights[buckets], minlength=texts) / np.maximum(grams, 1)
        return score, score >= self.line(grams)


def ratio_of_counts(raw: np.ndarray, trusted: np.ndarray) -> Ratio:
    """Log of trusted counts over those expected at the corpus's rate, both smoothed, so that a
    bucket seen a few times says little: in a small corpus trusted text would else be told from
    other good text by its rare words. All zero, so that all is kept, where nothing is trusted."""
    if trusted.sum() == 0:
        return Ratio(np.zeros(len(raw)), 0.0, 0.0)
    expected = trusted.sum() * raw / raw.sum()
    weights = np.log((trusted + SMOOTHING) / (expected + SMOOTHING))
    share = trusted / trusted.sum()
    mean = float(share @ weights)
    return Ratio(weights, mean, float(np.sqrt(share @ (weights - mean) ** 2)))


def fit(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS) -> Ratio:
    """Counts n-grams of all documents and of all trusted ones (quality 1 in every label).

    A task adds its texts up and sends one row per bucket; only the 2^bits sums, whatever the
    size of the corpus, come to the driver. Trusted ids are broadcast while they are small,
    else joined by a shuffle.
    """
    bound_batches(docs.sparkSession)
    trusted = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("_q")).filter("_q = 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_trusted"))
    if is_small(trusted):
        trusted = F.broadcast(trusted)
    rows = docs.select(docs["doc_id"].alias("_id"), docs["text"].cast("string").alias("_text")).join(
        trusted, "_id", "left").select("_text", F.coalesce("_trusted", F.lit(False)).alias("_trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for piece in slices(batch, "_text"):
                buckets, owner = gram_buckets(split_words(piece.column(0).to_pylist()), bits)
                chosen = piece.column(1).to_numpy(zero_copy_only=False)[owner].astype(bool)
                counts[0] += np.bincount(buckets, minlength=1 << bits)
                counts[1] += np.bincount(buckets[chosen], minlength=1 << bits)
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[0][used]), pa.array(counts[1][used])],
            names=["bucket", "raw", "trusted"])

    sums = rows.mapInArrow(run, "bucket int, raw bigint, trusted bigint").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    counts = np.zeros((2, 1 << bits))
    counts[0][sums["bucket"]], counts[1][sums["bucket"]] = sums["raw"], sums["trusted"]
    return ratio_of_counts(*counts)


def judge_documents(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every document.

    A null or empty text has no words and fails the base rules. A table without trusted
    documents is judged by the base rules alone. Repeated rows and null ids stay as they are,
    an empty table gives no rows, and further columns are not read.
    """
    def make():
        def work(texts: list) -> list:
            words = split_words(texts)
            base = base_counts(texts, words)
            failed = base_failed(words.lengths, base[-1])
            score, good = ratio.judge(words)
            return [*base, failed, score, good & ~failed]
        return work

    return text_columns(docs, make, BASE_FIELDS + [
        T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("kept", T.BooleanType())])


def keep_documents(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """The documents that `judge_documents` keeps, with all their columns, in one pass."""
    def make():
        def work(texts: list) -> list:
            words = split_words(texts)
            return ratio.judge(words)[1] & ~base_failed(words.lengths, repeated_words(words))
        return work

    return filter_texts(docs, make)
