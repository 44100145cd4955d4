"""Byte-level BPE by backtracking over longest dictionary matches, and decoding."""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import pairwise

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, types as T

from tripweave.llm.common import once_per_worker, text_columns
from tripweave.llm.pieces import PIECE_LIMIT, Memo, SpacedPieces

NEVER = 1 << 60
MEMO_LIMIT = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class ByteBpe:
    """Exact byte-pair encoding in time linear in the text.

    Bytes are mapped to Latin-1 characters, so that an automaton of all tokens tells how far
    the text goes on like some token, and matches are read off from there. A sequence of tokens
    is the result of the merges exactly when each two neighbours would come out of merging
    their joined bytes. The encoder takes the longest match that is
    compatible with the token before it and goes back when none leads to the end; a prefix
    has only one encoding, so a position once given up is never tried again.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.by_text = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.reach = max(self.size.values())
        self.automaton = ahocorasick.Automaton()
        for text, rank in self.by_text.items():
            self.automaton.add_word(text, rank)
        self.find = regex.compile(pattern).findall
        self.spines: dict[int, tuple | None] = {}
        self.fitting: dict[tuple[int, int], bool] = {}
        self.known = Memo(PIECE_LIMIT)
        self.pieces = SpacedPieces(self.of_pieces)
        self.table = np.frombuffer(b"".join(self.token[r] for r in sorted(self.token)), np.uint8)
        lengths = np.zeros(max(self.token) + 1, np.int64)
        for rank, size in self.size.items():
            lengths[rank] = size
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths

    def _spine(self, token: int) -> tuple | None:
        """The tokens at the two edges of a token while its own merges run, each with the
        rank of the merge that ends it; None if the merges of its bytes don't give it."""
        if token not in self.spines:
            parts = [bytes([b]) for b in self.token[token]]
            left, right = [], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(pairwise(parts)))
                if rank == NEVER:
                    break
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            whole = (self.token[token], NEVER)
            self.spines[token] = (left + [whole], right + [whole]) if len(parts) == 1 else None
        return self.spines[token]

    def _compatible(self, before: int, after: int) -> bool:
        """Whether the second token is one of the merges and no merge crosses the border of both.

        Walks both edges in the order of their merges. A crossing pair would merge if its
        rank comes before the merge that ends either side; of equal ranks the left one is
        first.
        """
        if len(self.fitting) > MEMO_LIMIT:
            self.fitting.clear()
        fits = self.fitting[before, after] = self._spine(after) is not None and not self._crossed(
            self._spine(before)[1], self._spine(after)[0])
        return fits

    def _crossed(self, rights: list, lefts: list) -> bool:
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = rights[i], lefts[j]
            rank = self.ranks.get(x + y, NEVER)
            if rank < x_ends and rank <= y_ends and rank < NEVER:
                return True
            if x_ends == y_ends == NEVER:
                return False
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_bytes(self, text: str) -> list[int]:
        """Token ids of one pre-token, given as Latin-1 characters."""
        whole = self.by_text.get(text)
        if whole is not None and self._spine(whole):
            return [whole]
        fitting, by_text, longest, reach = self.fitting, self.by_text, self.automaton.longest_prefix, self.reach
        end, at = len(text), 0
        given_up = bytearray(end + 1)
        tokens: list[int] = []
        tries = [longest(text[:reach])]  # the longest length not tried yet, by token
        while at < end:
            length = tries[-1]
            while length > 0:
                token = by_text.get(text[at:at + length])
                if token is not None and not given_up[at + length]:
                    if tokens:
                        fits = fitting.get((tokens[-1], token))
                        if fits is None:
                            fits = self._compatible(tokens[-1], token)
                    else:
                        fits = self._spine(token) is not None
                    if fits:
                        break
                length -= 1
            if length == 0:
                given_up[at] = 1
                if not tokens:
                    raise ValueError("the ranks lack single bytes of the text")
                tries.pop()
                at -= self.size[tokens.pop()]
                continue
            tries[-1] = length - 1
            tokens.append(token)
            at += length
            tries.append(longest(text[at:at + reach]) if at < end else 0)
        return tokens

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.known.turn()
        made = []
        for piece in pieces:
            words = self.find(piece)
            for word in words:
                if word not in known and self.known.absent({word}):
                    tokens = self.encode_bytes(word.encode().decode("latin-1"))
                    known[word] = struct.pack(f"<{len(tokens)}I", *tokens)
            made.append(known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words)))
        return made

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        return [b"".join(values) for values in self.pieces.values(texts)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that encoded ids stand for."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(tokens) == 0:
            return b""
        sizes = self.lengths[tokens]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.starts[tokens] - (ends - sizes), sizes)
        return self.table[at].tobytes()


def _worker_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    return once_per_worker(("byte pairs", ranks_path, pattern), lambda: ByteBpe(read_ranks(ranks_path), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids, the token ids of every document as one binary value.

    Ids are little-endian unsigned 32-bit integers. A null or empty text gives no ids. Texts
    of any length are encoded whole; repeated rows and null ids stay as they are, an empty
    table gives no rows and further columns are not read. The rank file is opened in the tasks.
    """
    def make():
        bpe = _worker_bpe(ranks_path, pattern)
        return lambda texts: [bpe.encode(texts)]

    return text_columns(docs, make, [T.StructField("ids", T.BinaryType())])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every document encoded, then decoded
    from its ids. Same rules for odd rows as in `encode_documents`."""
    def make():
        bpe = _worker_bpe(ranks_path, pattern)

        def work(texts: list) -> list:
            encoded = bpe.encode(texts)
            return [[len(ids) // 4 for ids in encoded],
                    [hashlib.sha256(ids).hexdigest() for ids in encoded],
                    [hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in encoded]]
        return work

    return text_columns(docs, make, [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())])
