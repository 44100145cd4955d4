"""Token ids of a corpus as files of word-aligned coded segments, and reading them back."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave.llm import simple8b
from tripweave.llm.common import bound_batches, once_per_worker, slices
from tripweave.llm.pieces import Memo
from tripweave.operators.keyed import is_small

END_ID = 1
SEGMENT_IDS = 1 << 18
CHUNK_LIMIT, WORD_LIMIT = 400_000, 800_000
SEGMENT_SCHEMA = "part int, segment int, n_docs bigint, n_ids bigint, doc_ids binary, lengths binary, ids binary"


# How the vocabulary's tokenizer parts texts of ASCII and Latin letters up to y with diaeresis, a byte each:
# lower-cased, in runs of one kind, digits alone; an apostrophe alone takes the letters of an English ending.
BLANKS, LETTER, DIGIT = b"\t\n\v\f\r ", 2, 3
LOWER = bytes(range(256)).decode("latin-1").translate({c: c + 32 for c in [*range(65, 91), *range(192, 215), *range(216, 223)]}).encode("latin-1")
KINDS = bytes(0 if c in BLANKS else DIGIT if 48 <= c < 58 else LETTER if 97 <= c < 123 or c >= 192 else 1 for c in range(256))
APOSTROPHE, ENDINGS, LONG_ENDINGS = ord("'"), np.frombuffer(b"stmd", np.uint8), (b"re", b"ve", b"ll")
#: Characters of one byte that are no white space to the library but to Python, or are no letters and not ASCII.
ODD = bytes([*range(0x1C, 0x20), *range(0x80, 0xC0), 0xD7, 0xF7])
CONTROLS = re.compile("[\x1c-\x1f]").search


def _as_latin(text: str) -> bytes | None:
    """A byte for each character, or nothing if the text has others."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return data if len(data.translate(None, ODD)) == len(data) else None


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes between blanks begin, and their lengths."""
    kind = np.frombuffer(data.translate(KINDS), np.uint8)
    edge = kind == DIGIT
    edge[0] = True
    edge[1:] |= kind[1:] != kind[:-1]
    data = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(data == APOSTROPHE)
    quotes = quotes[kind[quotes - 1] != 1]
    first, second = data[quotes + 1], data[quotes + 2]
    size = np.where(np.isin(first, ENDINGS), 2, 0)
    for a, b in LONG_ENDINGS:
        size[(first == a) & (second == b)] = 3
    quotes, size = quotes[size > 0], size[size > 0]
    edge[quotes + 1] = False
    edge[quotes + size] = True
    edges = np.flatnonzero(edge)
    inked = kind[edges] != 0
    return edges[inked], np.diff(edges, append=len(data))[inked]


class IdTable(dict):
    """Numbers of words, and the token ids of all of them in one flat table.

    A word is encoded when it is first met. `trim` empties the table once it is full.
    """

    def __init__(self, encode: Callable[[bytes], Iterable[int]], limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.ids, self.ends = array("I"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.ends) - 1
        self.ids.extend(self.encode(word))
        self.ends.append(len(self.ids))
        return number

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.ids, self.ends = array("I"), array("q", [0])

    def of_texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Distinct words are looked up, the rest is copied at once."""
        data = b"\n".join([b"", *texts, b"\n\n"]).translate(LOWER)
        starts, lengths = _words(data)
        offsets, inked = np.append(0, np.cumsum(lengths)), data.translate(None, BLANKS)
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(inked)]).dictionary_encode()
        distinct = np.fromiter(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        ends = np.frombuffer(self.ends, np.int64)
        first, size = ends[distinct], ends[distinct + 1] - ends[distinct]
        number = coded.indices.to_numpy()
        sizes = size[number]
        until = np.append(0, np.cumsum(sizes))
        at = np.repeat(first[number] - until[:-1], sizes)
        at += np.arange(len(at))
        made = memoryview(np.frombuffer(self.ids, "<u4")[at] if len(at) else np.zeros(0, "<u4")).cast("B")
        ahead = np.cumsum([1, *(len(text) + 1 for text in texts)])
        stops = (4 * until[np.searchsorted(starts, ahead)]).tolist()
        return [bytes(made[a:b]) for a, b in zip(stops, stops[1:])]


class ChunkEncoder:
    """Ids of texts, encoded with the tokenizers library piece by piece.

    For tokenizers that drop white space and never join what it parts, the ids of a text are
    those of its chunks between white space, in order. Texts of ASCII and the common Latin letters,
    without special tokens, are lower-cased and split into words as the tokenizer does, all texts of a call
    at once; the library's model merges each distinct word once. Of all other texts the distinct
    chunks go through the whole tokenizer. At most about `WORD_LIMIT` words and `CHUNK_LIMIT` chunks are
    kept. Python parts texts at four control characters that are no white space to the library;
    texts with one of them are encoded as they are.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = [token["content"] for token in json.load(file)["added_tokens"]]
        as_symbols = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.symbols = {code: as_symbols(chr(code))[0][0] for code in range(256)}
        self.merges = self.tokenizer.model.tokenize
        self.raw, self.words = Memo(CHUNK_LIMIT), IdTable(self._merge, WORD_LIMIT)

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _merge(self, word: bytes) -> list[int]:
        text = str(word, "latin-1")
        return [token.id for token in self.merges(text if word.isalnum() else text.translate(self.symbols))]

    def _chunks(self, texts: list[str]) -> list[bytes]:
        known = self.raw.turn()
        cut = [[text] if CONTROLS(text) else text.split() for text in texts]
        order = self.raw.absent({chunk for chunks in cut for chunk in chunks})
        for start in range(0, len(order), 4096):
            part = order[start:start + 4096]
            known.update(zip(part, self._encode(part)))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]

    def encode(self, texts: list) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        self.words.trim()
        texts = [text or "" for text in texts]
        plain = [None if any(token in text for token in self.special) else _as_latin(text) for text in texts]
        words = iter(self.words.of_texts([data for data in plain if data is not None]))
        others = iter(self._chunks([text for text, data in zip(texts, plain) if data is None]))
        return [next(others if data is None else words) for data in plain]


def worker_encoder(path: str) -> Callable[[list], list[bytes]]:
    """The encoding of a vocabulary, with its tables and memos kept by the Python worker."""
    return once_per_worker(("chunk encoder", path), lambda: ChunkEncoder(path)).encode


def _segment(part: int, number: int, keys: list, tokens: list[bytes]) -> dict:
    """One row of the file: which documents, how many ids each, and the coded ids."""
    has_key = np.array([key is not None for key in keys], np.uint64)
    key_values = np.array([key or 0 for key in keys], np.int64).view(np.uint64)
    lengths = np.array([len(t) // 4 for t in tokens], np.uint64)
    ids = np.frombuffer(b"".join(tokens), "<u4")
    pack = lambda values: simple8b.to_bytes(simple8b.pack(values))
    return {"part": part, "segment": number, "n_docs": len(keys), "n_ids": len(ids),
            "doc_ids": pack(np.concatenate([has_key, key_values])), "lengths": pack(lengths), "ids": pack(ids)}


def write_tokens(docs: DataFrame, path: str, make_encoder: Callable[[], Callable[[list], list[bytes]]],
                 end_id: int = END_ID) -> None:
    """Writes the ids of all documents, each closed by `end_id`, in ascending order of doc_id.

    Rows are dealt by ranges of doc_id (equal ids: by the text), so the files of the parts
    follow each other in that order; null ids come first. A part is a sequence of segments of
    about `SEGMENT_IDS` ids, each a row of a Parquet file with columns coded by `simple8b`.
    Spark commits a part's file once its task is done, so a lost executor leaves no half file.
    A null text gives the end id alone, and an empty table files without rows.
    """
    bound_batches(docs.sparkSession)
    schema = docs.sparkSession.createDataFrame([], SEGMENT_SCHEMA).schema
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = None, TaskContext.get().partitionId(), 0
        keys, tokens, held = [], [], 0
        for batch in batches:
            for piece in slices(batch, "_text"):
                encode = encode or make_encoder()
                keys += piece.column(0).to_pylist()
                made = [ids + end for ids in encode(piece.column(1).to_pylist())]
                tokens += made
                held += sum(map(len, made)) // 4
                if held >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_pylist([_segment(part, number, keys, tokens)], arrow_schema)
                    keys, tokens, held, number = [], [], 0, number + 1
        if keys:
            yield pa.RecordBatch.from_pylist([_segment(part, number, keys, tokens)], arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow_schema = to_arrow_schema(schema)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("_id"), docs["text"].cast("string").alias("_text"))
    order = [F.col("_id"), F.xxhash64("_text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, schema).write.parquet(path)


def unpack_segment(row: dict) -> tuple[list, np.ndarray, np.ndarray]:
    """The document ids of a segment, their numbers of ids, and all ids."""
    read = lambda name: simple8b.unpack(simple8b.from_bytes(row[name]))
    keys, n = read("doc_ids"), row["n_docs"]
    doc_ids = [int(key) if has else None for has, key in zip(keys[:n], keys[n:].view(np.int64))]
    return doc_ids, read("lengths").astype(np.int64), read("ids").astype("<u4")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files.

    `start` counts the ids of all documents before it. Ids before a part come from one sum
    per part (the number of files), those before a segment from the segments of its part;
    both sums read the counts only.
    """
    from pyspark.sql import Window

    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_start = parts.select("part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_inside")).join(
        part_start, "part").select("part", "segment", (F.col("_part_start") + F.col("_inside")).alias("_start"))
    if is_small(starts):
        starts = F.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = batch.slice(row, 1).to_pylist()[0]
                doc_ids, lengths, ids = unpack_segment(segment)
                first = np.cumsum(lengths) - lengths
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a:4 * (a + n)]) for a, n in zip(first.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(first + segment["_start"], pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(starts, ["part", "segment"]).mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
