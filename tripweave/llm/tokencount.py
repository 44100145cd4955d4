"""Token counts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from tripweave.llm.common import once_per_worker, text_columns
from tripweave.llm.pieces import PIECE_LIMIT, Memo, SpacedPieces

TOKEN_LIMIT = 1024
NO_RANK = np.iinfo(np.int32).max
ROUND_SYMBOLS = 4_000_000


class PairRanks:
    """Rank and product of symbol pairs, looked up for whole arrays.

    A table of buckets by a multiplied hash; each bucket has as many layers as the fullest
    one needs, so a lookup is a few array reads.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, product: np.ndarray, bits: int = 18):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.shift = np.uint64(64 - bits)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], bucket[order])
        layer = np.arange(len(order)) - first
        layers = int(layer.max(initial=0)) + 1
        self.keys = np.full((layers, 1 << bits), np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full((layers, 1 << bits), NO_RANK, np.int32)
        self.keys[layer, bucket[order]] = keys[order]
        self.ranks[layer, bucket[order]] = order
        self.product = product

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        bucket = self._bucket(keys)
        found = np.full(len(keys), NO_RANK, np.int32)
        for layer_keys, layer_ranks in zip(self.keys, self.ranks):
            found = np.where(layer_keys[bucket] == keys, layer_ranks[bucket], found)
        return found


def merged_lengths(symbols: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """Symbols that are left of each sequence once no pair has a rank.

    Each round finds the lowest rank of every sequence and merges all pairs of that rank at
    once; where such pairs overlap (a run of one symbol), every other one from the left.
    Finished sequences leave the arrays.
    """
    left_over = lengths.copy()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    while len(symbols) > 1:
        rank = np.where(owner[:-1] == owner[1:], pairs.rank(symbols[:-1], symbols[1:]), NO_RANK)
        rank = np.append(rank, NO_RANK)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        counts = np.diff(np.append(starts, len(owner)))
        lowest_here = np.repeat(lowest, counts)
        hit = np.flatnonzero((rank == lowest_here) & (rank < NO_RANK))
        if not len(hit):
            break
        run_start = np.append(True, np.diff(hit) != 1)
        in_run = np.arange(len(hit)) - np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), 0))
        hit = hit[in_run % 2 == 0]
        symbols[hit] = pairs.product[rank[hit]]
        stays = lowest_here < NO_RANK
        stays[hit + 1] = False
        left_over -= np.bincount(owner[hit], minlength=len(lengths))
        symbols, owner = symbols[stays], owner[stays]
    return left_over


class TokenCounter:
    """Counts the tokens of texts as the byte-level BPE of a tokenizer file gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitting = spec["model"], spec["pre_tokenizer"] or {}
        if (model["type"] != "BPE" or spec["normalizer"] or splitting.get("type") != "ByteLevel"
                or splitting["add_prefix_space"] or not splitting["use_regex"] or model.get("ignore_merges")):
            raise ValueError("token counts need a byte-level BPE without normalizer and prefix space")
        vocabulary = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairRanks(*[np.array([vocabulary[f(m)] for m in merges], np.int32) for f in (
            lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1])])
        self.symbol = np.zeros(1024, np.int32)
        for token, number in vocabulary.items():
            if len(token) == 1:
                self.symbol[ord(token)] = number
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.pieces = SpacedPieces(self.of_pieces)
        self.known = Memo(PIECE_LIMIT)

    def _pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a piece of text, and how many special tokens stand between them."""
        parts = self.special.split(text) if self.special else [text]
        return [word for part in parts if part for word, _ in self.split(part)], len(parts) - 1

    def of_pieces(self, pieces: list[str]) -> list[int]:
        known = self.known.turn()
        cut = [self._pretokens(piece) for piece in pieces]
        new = self.known.absent({word for words, _ in cut for word in words})
        start = 0
        while start < len(new):
            end, held = start, 0
            while end < len(new) and held < ROUND_SYMBOLS:
                held += len(new[end])
                end += 1
            batch = new[start:end]
            codes = np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32)
            lengths = np.fromiter(map(len, batch), np.int64, len(batch))
            known.update(zip(batch, merged_lengths(self.symbol[codes], lengths, self.pairs).tolist()))
            start = end
        return [special + sum(map(known.__getitem__, words)) for words, special in cut]

    def of_texts(self, texts: list) -> list[int]:
        return [sum(values) for values in self.pieces.values(texts)]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    A null text counts as empty: no bytes, no tokens. Texts of any length are counted whole.
    Repeated rows and null ids stay as they are, an empty table gives no rows, and further
    columns are not read. `tokenizer` is a file every executor can open.
    """
    def make():
        counter = once_per_worker(("token counter", tokenizer), lambda: TokenCounter(tokenizer))

        def work(texts: list) -> list:
            return [[len((text or "").encode()) for text in texts], counter.of_texts(texts)]
        return work

    counted = text_columns(docs, make, [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
