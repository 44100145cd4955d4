"""Collocations: phrases that occur far more often than their parts would by chance.

Phrases grow by relational mining (SETM). An occurrence relation holds (place, phrase) for every
occurrence of a phrase, sorted by place and persisted; a place is the number of a word, and
pieces lie one place apart, so adjacent places are of one piece. Each round

1. counts the phrases of the relation in groups and keeps those that are frequent (only phrases whose
   hash slot is heavy enough are grouped, which leaves out no frequent one),
2. takes their numbers back to the relation, a semi-join that leaves frequent occurrences only,
3. merge-joins the relation with itself on adjacent places: a phrase at a place and one at the
   next share all words but two, and make a phrase that is one word longer.

A phrase that is frequent consists of frequent ones, so none is missed. The relation is cut into
chunks of neighbouring pieces, each a row with sorted arrays, that never leave their place in
the relation: only the distinct phrases of a chunk are shuffled, with how often they occur in it,
those of two words or more packed by task and bucket of their hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tripweave.llm.common import bound_batches, slices, written
from tripweave.operators.keyed import is_small, top_per_key

LEAST_COUNT = 100
MOST_WORDS = 5
MOST_ROWS = 2000
#: A longer phrase that covers this share (in percent) of a phrase's occurrences replaces it.
COVERED = 100
SCALE = 1000
NO_LANGUAGE = "und"
#: Words of a chunk, and of all chunks that a task is filling.
CHUNK_WORDS, HELD_WORDS = 1 << 19, 3 << 19
#: Phrases are counted by hash first, into as many slots as there are words for each, within these bits.
SLOT_WORDS, LEAST_BITS, MOST_BITS = 32, 16, 26
#: What a task sends of its slots and words grows far less than the words it reads, so tasks read so many where all cores stay busy.
TASK_WORDS = 1 << 25
PAGE = 1 << 16
#: Pairs of phrases are dealt into buckets of at most so many words, and a task packs so many at a time.
BUCKET_WORDS, LEAST_BUCKETS, PACKED_PAIRS = 1 << 20, 64, 1 << 20
#: The number of a longer phrase: its bucket, then its place there.
BUCKET_BITS = 36
TEXT_BYTES = 4 * 1024 * 1024
#: Frequent phrases that are broadcast, with their keys; in a task they take a few times as much.
KNOWN_BYTES = 16 * 1024 * 1024
#: Chunks that a task writes and reads at a time; each is a row of some 15 MB.
HELD_CHUNKS = 1
# Numbers of words: that of a chunk, then that of the word in it.
PHRASE_BITS, CHUNK_BITS = 24, 18
#: Ends of pieces become a byte that no text holds.
BREAK = b"\xff"
MIX = np.uint64(0x9E3779B97F4A7C15)
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BREAKS = bytes.maketrans(PIECE_ENDS, BREAK * len(PIECE_ENDS))

WORDS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("size", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("phrases", T.BinaryType())])
LONGER = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("left", T.ArrayType(T.LongType())),
    T.StructField("right", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("size", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("phrases", T.BinaryType())])


class Numbers(dict):
    """Words in the order in which they are first seen; the end of a piece is -1."""

    def __init__(self):
        super().__init__({BREAK: -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text with the ends of its pieces, in parts of a bounded size."""
    data = (text or "").encode().lower().translate(BREAKS)
    at = 0
    while at < len(data):
        cut = data.find(BREAK, at + TEXT_BYTES)
        end = len(data) if cut < 0 else cut
        yield (data[at:end].replace(BREAK, b" " + BREAK + b" ") + b" " + BREAK).split()
        at = end


def occurrences(docs: DataFrame) -> DataFrame:
    """The relation of words: per chunk of one language its distinct words, their counts, and the
    word at every place. Null texts are empty, null languages are `NO_LANGUAGE`."""
    bound_batches(docs.sparkSession)
    arrow = to_arrow_schema(WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << CHUNK_BITS, 0
        held: dict[str, tuple[Numbers, list]] = {}
        sizes: dict[str, int] = {}

        def done(lang: str) -> pa.RecordBatch:
            nonlocal number
            numbers, parts = held.pop(lang)
            del sizes[lang]
            at = np.concatenate(parts)
            counts = np.bincount(at[at >= 0], minlength=len(numbers) - 1)
            words = [word.decode() for word in numbers if word != BREAK]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((
                [lang], [first + number - 1], [int(counts.sum())], [words], [counts], [len(words)], [None], [at.tobytes()]), arrow)],
                schema=arrow)

        for batch in batches:
            for piece in slices(batch, "text"):
                for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    for part in tokens(text):
                        numbers, parts = held.setdefault(lang, (Numbers(), []))
                        parts.append(np.fromiter(map(numbers.__getitem__, part), np.int32, len(part)))
                        sizes[lang] = sizes.get(lang, 0) + len(part)
                        if sizes[lang] >= CHUNK_WORDS:
                            yield done(lang)
                        elif sum(sizes.values()) >= HELD_WORDS:
                            yield done(max(sizes, key=sizes.get))
        for lang in list(held):
            yield done(lang)

    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, WORDS)


def joined(places: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge join of a sorted relation with itself on adjacent places: place, left and right phrase."""
    adjacent = np.flatnonzero(places[1:] == places[:-1] + 1)
    return places[adjacent], phrases[adjacent], phrases[adjacent + 1]


def _extended(chunk: int, places: np.ndarray, phrases: np.ndarray, number: np.ndarray) -> pa.RecordBatch | None:
    """A chunk of the next relation. `number` holds the number of each frequent phrase of this one, -1 for
    the others and, at its end, for no phrase."""
    kept = number[phrases] >= 0
    place, left, right = joined(places[kept], phrases[kept])
    if not len(place):
        return None
    pairs, which, counts = np.unique(left.astype(np.int64) * len(number) + right, return_inverse=True, return_counts=True)
    return pa.RecordBatch.from_arrays([
        pa.array([chunk], pa.int64()), pa.array([number[pairs // len(number)]], pa.list_(pa.int64())),
        pa.array([number[pairs % len(number)]], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
        pa.array([len(pairs)], pa.int32()), pa.array([place.tobytes()]), pa.array([which.astype(np.int32).tobytes()])],
        schema=to_arrow_schema(LONGER))


class Known:
    """The numbers of frequent phrases, by language and word or by the numbers of their two parts."""

    def __init__(self, frequent: list, keys: list[str]):
        ids = np.array([row.id for row in frequent], np.int64)
        self.words: dict[str, dict[str, int]] = {}
        if keys == ["lang", "word"]:
            for row in frequent:
                self.words.setdefault(row.lang, {})[row.word] = row.id
            return
        left, right = (np.array([row[key] for row in frequent], np.int64) for key in keys)
        self.parts = np.unique(np.concatenate([left, right]))
        pairs = np.searchsorted(self.parts, left) * len(self.parts) + np.searchsorted(self.parts, right)
        order = np.argsort(pairs)
        self.pairs, self.ids = pairs[order], ids[order]

    def of_words(self, lang: str, words: list[str]) -> np.ndarray:
        known = self.words.get(lang, {})
        return np.fromiter((known.get(word, -1) for word in words), np.int64, len(words))

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = np.full(len(left), -1, np.int64)
        if len(self.pairs):
            a, b = (np.minimum(np.searchsorted(self.parts, x), len(self.parts) - 1) for x in (left, right))
            pairs = a * len(self.parts) + b
            at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
            same = (self.parts[a] == left) & (self.parts[b] == right) & (self.pairs[at] == pairs)
            found[same] = self.ids[at[same]]
        return found


def _arrays(places: pa.Scalar, phrases: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    phrases = np.frombuffer(phrases.as_buffer(), np.int32)
    return (np.frombuffer(places.as_buffer(), np.int32) if places.is_valid else np.arange(len(phrases), dtype=np.int32)), phrases


def longer(relation: DataFrame, rows: DataFrame, frequent: DataFrame, keys: list[str]) -> DataFrame:
    """The relation of phrases one word longer than those of a relation, after its semi-join with the
    frequent ones.

    Few frequent phrases are broadcast and found in every chunk. Beyond that they meet the distinct
    phrases of the chunks in a join, and what each chunk keeps goes back to it in another.
    """
    known = frequent.select(*keys, "id")
    if is_small(known, KNOWN_BYTES):
        shared = frequent.sparkSession.sparkContext.broadcast(Known(known.collect(), keys))
        first, second = ("lang", "words") if keys == ["lang", "word"] else ("left", "right")

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    chunk, a, b, places, phrases = (batch.column(i)[row] for i in range(5))
                    number = (shared.value.of_words(a.as_py(), b.as_py()) if first == "lang"
                              else shared.value.of_pairs(a.values.to_numpy(), b.values.to_numpy()))
                    made = _extended(chunk.as_py(), *_arrays(places, phrases), np.append(number, -1))
                    if made:
                        yield made

        return relation.select("chunk", first, second, "places", "phrases").mapInArrow(look_up, LONGER)

    found = rows.select("chunk", "at", *keys).join(known, keys)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            at, ids = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([at.tobytes()]), pa.array([ids.tobytes()])], names=["chunk", "at", "ids"])

        current, held = None, []
        for batch in batches:
            chunk, at, ids = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk)).tolist()
            for start, stop in zip(cuts, cuts[1:]):
                if held and chunk[start] != current:
                    yield done()
                    held = []
                current = int(chunk[start])
                held.append((at[start:stop].copy(), ids[start:stop].copy()))
        if held:
            yield done()

    alive = found.select("chunk", "at", "id").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(
        packed, "chunk bigint, at binary, ids binary")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, places, phrases, size, at, ids = (batch.column(i)[row] for i in range(6))
                number = np.full(size.as_py() + 1, -1, np.int64)
                number[np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(ids.as_buffer(), np.int64)
                made = _extended(chunk.as_py(), *_arrays(places, phrases), number)
                if made:
                    yield made

    joint = relation.select("chunk", "places", "phrases", "size").join(alive, "chunk")
    return joint.select("chunk", "places", "phrases", "size", "at", "ids").mapInArrow(extend, LONGER)


def _hashes(relation: DataFrame, keys: list[str]) -> tuple[DataFrame, Callable]:
    """The columns that tell a relation's phrases, and a function that hashes those of one chunk."""
    if keys == ["lang", "word"]:
        def of_words(lang: pa.Scalar, words: pa.Scalar) -> np.ndarray:
            seed = xxhash.xxh64_intdigest(lang.as_py())
            return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.as_py()), np.uint64, len(words))
        return relation.select("chunk", "lang", "words", "counts"), of_words

    def of_pairs(left: pa.Scalar, right: pa.Scalar) -> np.ndarray:
        mixed = (left.values.to_numpy().view(np.uint64) * MIX + right.values.to_numpy().view(np.uint64)) * MIX
        return (mixed ^ (mixed >> np.uint64(31))) * MIX
    return relation.select("chunk", "left", "right", "counts"), of_pairs


def _in_large_tasks(relation: DataFrame, n_words: int) -> DataFrame:
    """The relation of so many words, read by few tasks."""
    return relation.coalesce(max(relation.sparkSession.sparkContext.defaultParallelism, n_words // TASK_WORDS))


def _slot_kind(least: int) -> type:
    return next(kind for kind in (np.uint8, np.uint16, np.uint32) if least <= np.iinfo(kind).max)


def slot_sums(relation: DataFrame, keys: list[str], least: int, bits: int, n_words: int = 0) -> DataFrame:
    """How often the phrases of each slot come in the chunks of a task, up to `least`: a row per task and page of slots."""
    source, hashes = _hashes(_in_large_tasks(relation, n_words), keys)
    kind = _slot_kind(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in range(batch.num_rows):
                total = np.zeros(1 << bits, kind) if total is None else total
                a, b, counts = (batch.column(i)[row] for i in (1, 2, 3))
                slots, where = np.unique((hashes(a, b) >> np.uint64(64 - bits)).astype(np.int64), return_inverse=True)
                own = np.bincount(where, counts.values.to_numpy(), len(slots))
                total[slots] = np.minimum(total[slots] + own, least).astype(kind)
        if total is not None:
            for page, values in enumerate(total.reshape(-1, PAGE)):
                yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([zlib.compress(values.tobytes(), 1)])], names=["page", "sums"])

    return source.mapInArrow(run, "page int, sums binary")


def heavy_slots(relation: DataFrame, keys: list[str], least: int, bits: int, n_words: int = 0) -> np.ndarray:
    """A bit for every slot of the hash: whether the phrases in it occur `least` times together.

    A frequent phrase lies in such a slot, whatever shares it. Tasks add up to at most `least` in each
    slot, which is enough to tell; the sums have a fixed size.
    """
    kind = _slot_kind(least)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        for batch in batches:
            for page, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page != current:
                    if total is not None:
                        yield bits_of(current, total)
                    current, total = page, np.zeros(PAGE, np.int64)
                total += np.frombuffer(zlib.decompress(sums), kind)
        if total is not None:
            yield bits_of(current, total)

    def bits_of(page: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([np.packbits(total >= least).tobytes()])], names=["page", "sums"])

    schema = "page int, sums binary"
    heavy = np.zeros(((1 << bits) // PAGE, PAGE // 8), np.uint8)
    summed = slot_sums(relation, keys, least, bits, n_words).repartition("page").sortWithinPartitions("page").mapInArrow(add, schema)
    for row in summed.collect():  # 8 MB at most, and one job whatever the partitions
        heavy[row.page] = np.frombuffer(row.sums, np.uint8)
    return heavy.ravel()


def _candidates(relation: DataFrame, keys: list[str], bits: int, shared) -> DataFrame:
    """chunk, at, the keys and count of the phrases of every chunk that lie in a heavy slot."""
    source, hashes = _hashes(relation, keys)
    words = keys == ["lang", "word"]
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("at", T.IntegerType()),
        *[T.StructField(key, T.StringType() if words else T.LongType()) for key in keys], T.StructField("count", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, a, b, counts = (batch.column(i)[row] for i in range(4))
                slots = (hashes(a, b) >> np.uint64(64 - bits)).astype(np.int64)
                at = np.flatnonzero((shared.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1)
                first = pa.repeat(a, len(at)) if words else a.values.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip((
                    pa.repeat(chunk, len(at)), pa.array(at), first, b.values.take(pa.array(at)), counts.values.take(pa.array(at))), arrow)],
                    schema=arrow)

    return source.mapInArrow(run, schema)


def _summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their counts."""
    order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    return left[first], right[first], np.add.reduceat(counts, first)


def _squeezed(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs in order as bytes: equal bytes of the numbers side by side, which packs well."""
    columns = np.stack([np.diff(left, prepend=0), right, counts]).astype("<i8")
    return zlib.compress(columns.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1).tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(3, 8, -1)
    columns = raw.transpose(0, 2, 1).copy().view("<i8")[:, :, 0]
    columns[0] = np.cumsum(columns[0])
    return columns


def packed_pairs(relation: DataFrame, bits: int, buckets: int, shared) -> DataFrame:
    """The pairs of a relation that lie in a heavy slot, with how often the chunks of a task hold them: a row
    per task, bucket and about `PACKED_PAIRS` pairs."""
    source, hashes = _hashes(relation, ["left", "right"])

    def packed(held: list) -> Iterator[pa.RecordBatch]:
        left, right, counts, bucket = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for number, (start, end) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            if end > start:
                own = order[start:end]
                data = _squeezed(*_summed(left[own], right[own], counts[own]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([data])], names=["bucket", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                left, right, counts = (batch.column(i)[row] for i in (1, 2, 3))
                hashed = hashes(left, right)
                slots = (hashed >> np.uint64(64 - bits)).astype(np.int64)
                at = np.flatnonzero((shared.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1)
                bucket = ((hashed[at] >> np.uint64(8)) & np.uint64(buckets - 1)).astype(np.int32)
                held.append((*(x.values.to_numpy()[at] for x in (left, right, counts)), bucket))
                size += len(at)
                if size >= PACKED_PAIRS:
                    yield from packed(held)
                    held, size = [], 0
        if size:
            yield from packed(held)

    return source.mapInArrow(run, "bucket int, pairs binary")


def _frequent_pairs(packed: DataFrame, least: int) -> DataFrame:
    """left, right, a and id of the pairs that occur `least` times or more. A bucket is summed at once."""
    def summed(bucket: int, held: list) -> pa.RecordBatch:
        left, right, total = _summed(*np.concatenate(held, axis=1))
        often = np.flatnonzero(total >= least)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (
            left[often], right[often], total[often], (bucket << BUCKET_BITS) + np.arange(len(often)))], names=["left", "right", "a", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and bucket != current:
                    yield summed(current, held)
                    held = []
                current = bucket
                held.append(_unsqueezed(pairs))
        if held:
            yield summed(current, held)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "left bigint, right bigint, a bigint, id bigint")


def _grouped(relation: DataFrame, keys: list[str], least: int, bits: int, n_words: int) -> tuple[DataFrame, DataFrame]:
    """The phrases of a relation that may be frequent, one row per chunk and phrase, and the frequent ones
    among them with their counts and numbers. The number of a word is its place in the first
    chunk that has it."""
    shared = relation.sparkSession.sparkContext.broadcast(heavy_slots(relation, keys, least, bits, n_words))
    rows = _candidates(relation, keys, bits, shared)
    if keys == ["left", "right"]:
        buckets = max(LEAST_BUCKETS, 1 << (n_words // BUCKET_WORDS).bit_length())
        return rows, written(_frequent_pairs(packed_pairs(relation, bits, buckets, shared), least), "frequent")
    number = F.shiftleft(F.col("chunk"), PHRASE_BITS) + F.col("at")
    frequent = _candidates(_in_large_tasks(relation, n_words), keys, bits, shared).groupBy(*keys).agg(F.sum("count").alias("a"), F.min(number).alias("id")).filter(F.col("a") >= least)
    return rows, written(frequent, "frequent")


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """lang, n: all words of each language; and lang, phrase, size, a: every phrase of up to
    `most_words` words that occurs `least` times or more, with its number of occurrences."""
    relation = written(occurrences(docs), "words", HELD_CHUNKS)
    totals = relation.groupBy("lang").agg(F.sum("n").alias("n"))
    n_words = relation.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (n_words // SLOT_WORDS).bit_length()))
    keys = ["lang", "word"]
    rows, frequent = _grouped(relation, keys, least, bits, n_words)
    level = frequent.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", F.lit(1).alias("size"))
    found = [level]
    for size in range(2, most_words + 1):
        if frequent.isEmpty():
            break
        relation = written(longer(relation, rows, frequent, keys), "phrases", HELD_CHUNKS)
        keys = ["left", "right"]
        rows, frequent = _grouped(relation, keys, least, bits, n_words)
        left = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"))
        right = level.select(F.col("id").alias("right"), "last")
        level = written(frequent.join(left, "left").join(right, "right").select(
            "id", "lang", F.concat("start", F.lit(" "), "last").alias("phrase"), "last", "a", F.lit(size).alias("size")), "level")
        found.append(level)
    phrases = found[0]
    for level in found[1:]:
        phrases = phrases.unionByName(level)
    return totals, phrases.select("lang", "phrase", "size", "a")


def _part(first, length) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def scored(totals: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases of two words or more with the score of their worst cut, in exact arithmetic."""
    whole = phrases.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = whole.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "size", "a", "k", _part(F.lit(1), F.col("k")).alias("first"),
        _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    first = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    parts = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(F.broadcast(totals) if is_small(totals) else totals, "lang")
    exact = {name: F.col(name).cast("decimal(18,0)") for name in ("a", "n", "l", "r")}
    parts = parts.withColumn("over", F.lit(SCALE).cast("decimal(4,0)") * exact["a"] * exact["n"]).withColumn(
        "under", exact["l"] * exact["r"]).withColumn("score", F.expr("over div under"))
    worst = parts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return worst.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def uncovered(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """Phrases that no longer phrase holds in at least `covered` percent of their occurrences."""
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(F.slice("words", at, n), " "))))
    inside = phrases.filter("size > 2").withColumn("words", F.split("phrase", " ")).select(
        "lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, most_rows: int = MOST_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first `most_rows` phrases of each language.

    Texts are read whole; a null or empty text has no phrase, a null language is `und`, repeated
    rows count as often as they come, an empty table gives no rows, and further columns are
    not read. Ties in the score go to the more frequent phrase, then to the first in order of bytes.
    """
    totals, phrases = frequent_phrases(docs, least, most_words)
    ranked = top_per_key(written(uncovered(scored(totals, phrases)), "scored"), ["lang"],
                         [F.desc("score"), F.desc("a"), F.asc("phrase")], most_rows, "rank")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
occurrences AS (
  SELECT lang, size, words[i:i + size - 1] AS words
  FROM (SELECT lang, size, words, unnest(generate_series(1, len(words) - size + 1)) AS i
        FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(words) >= size)),
phrases AS (SELECT lang, size, words, count(*) AS a FROM occurrences GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, size, words, a, unnest(generate_series(1, size - 1)) AS k FROM phrases WHERE size > 1),
parts AS (
  SELECT c.lang, c.size, c.words, c.a, c.k, l.a AS l, r.a AS r, n,
         CAST(1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts c JOIN phrases l ON l.lang = c.lang AND l.words = c.words[1:c.k]
  JOIN phrases r ON r.lang = c.lang AND r.words = c.words[k + 1:c.size]
  JOIN totals t ON t.lang = c.lang),
worst AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inside AS (
  SELECT lang, words[i:i + n - 1] AS words, max(a) AS longer
  FROM (SELECT lang, words, a, n, unnest(generate_series(1, size - n + 1)) AS i
        FROM (SELECT lang, size, words, a, unnest(generate_series(2, size - 1)) AS n FROM phrases WHERE size > 2))
  GROUP BY ALL),
kept AS (
  SELECT w.*, array_to_string(w.words, ' ') AS phrase FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.words = w.words
  WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
