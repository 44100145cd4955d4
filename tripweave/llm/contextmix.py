"""Language-model scores of texts by logistic mixing of hashed-context bit predictors.

A text is a sequence of lower-cased bytes and an end. Each byte is a path of binary decisions in a
code tree. For every decision several contexts (the last bytes, the word so far) are hashed together with the place in the tree, and the counts of zeros and ones seen there
in the learning part of the corpus make one prediction each, as a log odds. A mixer adds them
with weights chosen by a gate, the set of contexts that are known at all; a table of adaptive
probabilities, by place in the tree and mixed odds, refines the sum. The weights start as learned
online from all learning documents and go on learning within every text: each block of it is predicted with
what the blocks before it taught. The sum over all decisions is the log probability of the text.

The code, the counts, the weights and the refining table cover every learning document. Slots grow with the learning bytes up to
2^MOST_BITS for the largest context, so that the table always fits in a broadcast; from there on
contexts share slots more often, as hashing allows, and are still all counted, each slot as far as it goes.
"""

from __future__ import annotations

import functools
import heapq
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tripweave.llm.common import bound_batches, slices, written

FOLDS, HELD_FOLD = 5, 1
ORDERS = (3, 5)
CONTEXTS = len(ORDERS) + 1
LEAST_BITS, MOST_BITS = 20, 22
SLOT_BYTES = 4
PAGE = 4096
#: Bytes that are worked on at once, so few that their decisions stay in a processor's cache.
PACK_BYTES = 256 * 1024
#: Bytes whose contexts are sorted together to be counted.
COUNT_BYTES = 2 * 1024 * 1024
#: Decisions that a task adds up before it gives its pages, so that none of its counts passes 32 bits.
MOST_HELD = 1 << 32
BEFORE = 1024
#: Decisions that are worked on at once, and those after which weights learn from a corpus.
PART, LOT = 1 << 15, 1 << 17
#: A text is cut into at most so many blocks, each of at least so many bytes.
BLOCKS, BLOCK = 8, 1024
END = 0xFF
PAD = bytes(8)
#: Log odds are kept in twelfths, as bytes.
STEP = 12.0
SMOOTH = 0.4
FIRST_WEIGHT = 0.3
GATES = 1 << CONTEXTS
LEARN_PRIOR, ADAPT_PRIOR = 100.0, 1_000.0
#: Weights of tasks are added as whole multiples of 1 / EXACT, so that their order doesn't matter.
EXACT = 1 << 16
#: Sums of a set are added up side by side, so that one addition needn't wait for the other.
SPREAD = 8
#: Every so many bytes of a text teach its weights: all of them.
TEACH = 1
BUCKETS, REACH = 33, 8.0
REFINE_PRIOR = 30.0
CHUNK_WORDS = 1 << 21
CHUNK_BITS = 24
MIX = np.uint64(0x9E3779B97F4A7C15)
POWER = 0x5851F42D4C957F2D
INVERSE = pow(POWER, -1, 1 << 64)


# ---- bytes as paths in a tree -------------------------------------------------------------------

class Code(NamedTuple):
    """A prefix code of bytes: how long each path is, and the place and turn at each step of it."""

    length: np.ndarray
    place: np.ndarray
    turn: np.ndarray
    longest: int


def make_code(histogram: np.ndarray) -> Code:
    """Huffman's code of smoothed byte counts, so frequent bytes take few decisions."""
    weights = histogram.astype(np.float64) + max(1.0, histogram.sum() / (1 << 14))
    heap = [(float(w), symbol, symbol) for symbol, w in enumerate(weights)]
    heapq.heapify(heap)
    number = 0
    children = {}
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        children[256 + number] = (left, right)
        heapq.heappush(heap, (a + b, 256 + number, 256 + number))
        number += 1
    paths: dict[int, list] = {}
    waiting = [(heap[0][2], [])]
    while waiting:
        node, path = waiting.pop()
        if node < 256:
            paths[node] = path
        else:
            waiting += [(child, path + [(node - 256, turn)]) for turn, child in enumerate(children[node])]
    longest = max(map(len, paths.values()))
    length = np.array([len(paths[s]) for s in range(256)], np.int64)
    place, turn = np.zeros((256, longest), np.uint8), np.zeros((256, longest), bool)
    for symbol, path in paths.items():
        for k, (node, way) in enumerate(path):
            place[symbol, k], turn[symbol, k] = node, way
    return Code(length, place.ravel(), turn.ravel(), longest)


def text_bytes(text: str | None) -> bytes:
    """The bytes that are scored: A to Z in lower case, then the end."""
    return (text or "").encode().lower() + bytes([END])


def windows(texts: list) -> Iterator[tuple[int, bytes, bytes]]:
    """Which text, what comes before, and the bytes of each window of the texts. A very long text
    has several windows; each knows the last bytes of the one before it."""
    for number, text in enumerate(texts):
        data = text_bytes(text)
        for at in range(0, len(data), PACK_BYTES):
            yield number, data[max(0, at - BEFORE):at] if at else PAD, data[at:at + PACK_BYTES]


def packs(texts: list) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Windows in lists of about `PACK_BYTES`."""
    held, size = [], 0
    for window in windows(texts):
        if held and size + len(window[2]) > PACK_BYTES:
            yield held
            held, size = [], 0
        held.append(window)
        size += len(window[2])
    if held:
        yield held


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of POWER and of its inverse."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64) for base in (POWER, INVERSE))


def contexts(data: np.ndarray) -> list[np.ndarray]:
    """Hashes of what stands before each byte, one array for each kind of context."""
    n = len(data)
    last = np.ndarray(n, ">u8", PAD + data.tobytes(), strides=(1,)).astype(np.uint64)  # the eight bytes before each
    out = [last & np.uint64((1 << 8 * order) - 1) for order in ORDERS]
    powers, inverse = _powers(max(1 << 19, 1 << n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    starts = np.flatnonzero(np.append(True, (data[:-1] <= 32) | (data[:-1] == END)))
    sizes = np.diff(np.append(starts, n))
    word = sums[:n] - np.repeat(sums[starts], sizes)
    word *= np.repeat(inverse[starts], sizes)
    out.append(word)
    for kind, values in enumerate(out):
        values += np.uint64(kind + 1)
        values *= MIX
        values ^= values >> np.uint64(29)
        values *= MIX
        values >>= np.uint64(32)
    return [values.astype(np.uint32) for values in out]


def marks_of(code: Code) -> np.ndarray:
    """What each place in the tree adds to a context's hash."""
    return (code.place.astype(np.uint64) + np.uint64(1)) * MIX >> np.uint64(32)


def widths(bits: int) -> tuple[int, ...]:
    """The bits of each context's slots; the short ones have few contexts, however long the corpus."""
    return (19, bits - 1, bits)


def picked(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at] for places that are known to exist, which spares their check."""
    return values.take(at, mode="clip")


class Part(NamedTuple):
    """Bytes of one block, those with the longest paths first, so that those that take a k-th step are the first ones."""

    start: int
    reach: list  # how many of the bytes take each step
    first: int   # where the decisions begin, first steps first
    end: int
    block: int
    lot: int     # how many whole lots of decisions lie before its end


class Paths:
    """The decisions of a pack, in parts of about `PART`: those of first blocks, then those of second ones, and so on."""

    def __init__(self, pack: list, code: Code):
        data = np.frombuffer(b"".join(part for _, before, body in pack for part in (before, body)), np.uint8)
        before = np.cumsum([len(w[1]) for w in pack])
        size = np.array([len(w[2]) for w in pack], np.int64)
        start = np.cumsum(size) - size
        each = np.maximum(BLOCK, -(-size // BLOCKS))
        blocks = -(-size // each)
        window = np.repeat(np.arange(len(pack)), blocks)  # of each block, and which one of the window's it is
        number = np.arange(len(window)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        order = np.argsort(number, kind="stable")
        window, number = window[order], number[order]
        begin = number * each[window]
        held = np.minimum(begin + each[window], size[window]) - begin
        ends = np.cumsum(held)
        byte = np.arange(ends[-1]) + np.repeat(start[window] + begin - (ends - held), held)
        at = byte + np.repeat(before[window], held)
        symbol = picked(data, at).astype(np.intp)
        length = picked(code.length.astype(np.uint8), symbol)
        until = np.cumsum(length, dtype=np.int64)
        cuts = np.unique(np.concatenate([ends[np.flatnonzero(np.diff(number))], ends[-1:], np.searchsorted(until, np.arange(PART, until[-1], PART), "right")]))
        short, order, self.parts, done = np.uint8(code.longest) - length, np.empty(len(byte), np.intp), [], 0
        for low, high in zip([0] + cuts.tolist(), cuts.tolist()):
            order[low:high] = np.argsort(short[low:high], kind="stable")
            order[low:high] += low
            reach = np.bincount(short[low:high], minlength=code.longest + 1).cumsum()[:-1][::-1]
            end = int(until[high - 1])
            self.parts.append(Part(low, [n for n in reach.tolist() if n], done, end, int(number[np.searchsorted(ends, low, "right")]), (end - 1) // LOT))
            done = end
        self.n, self.blocks = done, blocks
        self.byte = picked(byte, order)
        self.lane = picked(np.repeat(window, held), order)
        at = picked(at, order)
        self.hashes = [picked(base, at) for base in contexts(data)]
        path = picked((symbol * code.longest).astype(np.uint16), order)
        self.step = np.empty(done, np.uint16)  # where in the code's tables each decision is
        for part in self.parts:
            done = part.first
            for k, n in enumerate(part.reach):
                np.add(path[part.start:part.start + n], np.uint16(k), out=self.step[done:done + n])
                done += n
        self.marks = picked(marks_of(code).astype(np.uint32), self.step)

    def slots(self, kind: int, width: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Where the counts of a context's decisions are, part by part."""
        for part in self.parts:
            now = slice(part.first, part.end)
            slot = stepped(self.hashes[kind], part)
            slot += self.marks[now]
            slot >>= np.uint32(32 - width)
            yield now, slot

    def found(self, kind: int, width: int, values: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
        """What a context's slots hold for all decisions; with turns, for each slot and turn. One context after the
        other, so that the slots a pack needs stay in a processor's cache."""
        made = np.empty(self.n, values.dtype)
        for now, slot in self.slots(kind, width):
            if turn is not None:
                slot <<= np.uint32(1)
                slot |= turn[now]
            values.take(slot, mode="clip", out=made[now])
        return made

    def teaching(self, pack: list) -> np.ndarray:
        """Which bytes teach the later blocks of their window."""
        made, start = np.zeros(len(self.byte), bool), 0
        for (_, _, body), blocks in zip(pack, self.blocks.tolist()):
            made[start:start + (blocks - 1) * max(BLOCK, -(-len(body) // BLOCKS)):TEACH] = True
            start += len(body)
        return picked(made, self.byte)


def stepped(values: np.ndarray, part: Part) -> np.ndarray:
    """What each byte of a part has, for every decision of the part."""
    return np.concatenate([values[part.start:part.start + n] for n in part.reach])


class Decisions(NamedTuple):
    """All decisions of a pack, byte after byte."""

    place: np.ndarray   # where in the tree
    turn: np.ndarray    # what came
    slots: list         # per context, where its counts are


def decisions(pack: list, code: Code, bits: int) -> Decisions:
    paths = Paths(pack, code)
    order = np.argsort(np.concatenate([stepped(paths.byte, part) for part in paths.parts]), kind="stable")
    step = paths.step[order]
    return Decisions(code.place[step], code.turn[step], [
        np.concatenate([slot for _, slot in paths.slots(kind, width)])[order] for kind, width in enumerate(widths(bits))])


# ---- predictions --------------------------------------------------------------------------------

def odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Smoothed log odds of counts in steps of 1 / STEP, as bytes."""
    value = np.log((ones.astype(np.float32) + np.float32(SMOOTH)) / (zeros.astype(np.float32) + np.float32(SMOOTH))) * np.float32(STEP)
    return np.clip(np.rint(value), -127, 127).astype(np.int8)


class Mixer:
    """Weights by set and context, and how much each set has learned."""

    def __init__(self, weights: np.ndarray, prior: float):
        self.weights = weights.astype(np.float32).copy()  # context by set
        self.seen = np.full(weights.shape[1], prior)
        self.noted = np.zeros((1 + len(weights), weights.shape[1]))

    def mixed(self, sets: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
        total = picked(self.weights[0], sets) * inputs[0]
        for weights, values in zip(self.weights[1:], inputs[1:]):
            total += picked(weights, sets) * values
        return total

    def mixed_by(self, one: int, inputs: list[np.ndarray]) -> np.ndarray:
        """The same where all are of one set."""
        total = self.weights[0, one] * inputs[0]
        for weights, values in zip(self.weights[1:], inputs[1:]):
            total += weights[one] * values
        return total

    def note(self, sets: np.ndarray, inputs: list[np.ndarray], error: np.ndarray, likely: np.ndarray) -> None:
        """Adds decisions to what the next step learns from; the error is what came less what was likely."""
        spread = sets * SPREAD
        spread += np.arange(len(sets)) & (SPREAD - 1)

        def summed(values: np.ndarray) -> np.ndarray:
            return np.bincount(spread, values, self.noted.shape[1] * SPREAD).reshape(-1, SPREAD).sum(1)

        for into, values in zip(self.noted, self.terms(inputs, error, likely)):
            into += summed(values)

    def note_by(self, one: int, inputs: list[np.ndarray], error: np.ndarray, likely: np.ndarray) -> None:
        """The same where all whose error is not zero are of one set."""
        for into, values in zip(self.noted, self.terms(inputs, error, likely)):
            into[one] += values.sum(dtype=np.float64)

    @staticmethod
    def terms(inputs: list[np.ndarray], error: np.ndarray, likely: np.ndarray) -> Iterator[np.ndarray]:
        square = inputs[0] * inputs[0]
        for values in inputs[1:]:
            square += values * values
        square *= likely
        square *= 1 - likely
        yield square
        for values in inputs:
            yield error * values

    def learn(self) -> None:
        """One step down the gradient of the coding cost, shorter the more a set has learned."""
        self.seen += self.noted[0]
        self.weights += (self.noted[1:] / self.seen).astype(np.float32)
        self.noted[:] = 0


class Model(NamedTuple):
    """What is learned from a corpus: the code, the counts by context, the weights, the refining table."""

    code: Code
    bits: int
    counts: list         # per context, zeros and ones of each slot
    weights: np.ndarray  # context by gate
    refined: np.ndarray  # place by bucket, probability of a one


def gates(inputs: list[np.ndarray]) -> np.ndarray:
    """Which contexts say anything."""
    gate = (inputs[0] != 0).astype(np.uint8)
    for k, values in enumerate(inputs[1:], 1):
        gate |= (values != 0).view(np.uint8) << np.uint8(k)
    return gate


def bucket_of(place: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return bucket_in(place.astype(np.intp) * BUCKETS, mixed)


def bucket_in(row: np.ndarray, mixed: np.ndarray, apart: int = 1) -> np.ndarray:
    """The bucket of mixed odds in a row of the refining table, whose buckets lie so far apart."""
    at = np.clip(mixed, -REACH, REACH)
    at += np.float32(REACH)
    at *= np.float32((BUCKETS - 1) / (2 * REACH))
    np.rint(at, out=at)
    if apart > 1:
        at *= np.float32(apart)
    row += at.astype(np.int32)
    return row


def likelihood(mixed: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(mixed, -20, 20)))


def score_texts(texts: list, model: Model, table: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each text. `table` holds the odds of each context's slots."""
    total, code = np.zeros(len(texts)), model.code
    rows, others = code.place.astype(np.intp) * BUCKETS, 1 - code.turn.astype(np.float32)
    for pack in packs(texts):
        paths = Paths(pack, code)
        small = [paths.found(kind, width, odds_of) for kind, (width, odds_of) in enumerate(zip(widths(model.bits), table))]
        gate, lanes, teaches = gates(small), paths.lane * GATES, paths.teaching(pack)
        mixer = Mixer(np.tile(model.weights, (1, len(pack))), ADAPT_PRIOR)
        chance = np.ones(len(paths.byte))
        for number, part in enumerate(paths.parts):
            now = slice(part.first, part.end)
            sets = stepped(lanes, part)
            sets += gate[now]
            inputs = [values[now].astype(np.float32) for values in small]
            for values in inputs:
                values *= np.float32(1 / STEP)
            mixed = mixer.mixed(sets, inputs)
            likely = likelihood(mixed)
            other = picked(others, paths.step[now])
            one = picked(model.refined, bucket_in(picked(rows, paths.step[now]), mixed))
            one += likely
            one *= np.float32(0.5)
            one -= other
            np.abs(one, out=one)  # the probability of what came
            at = 0
            for n in part.reach:
                chance[part.start:part.start + n] *= one[at:at + n]
                at += n
            if number + 1 < len(paths.parts):
                some = np.flatnonzero(stepped(teaches, part))
                if len(some):
                    likely = picked(likely, some)
                    mixer.note(picked(sets, some), [picked(values, some) for values in inputs], 1 - picked(other, some) - likely, likely)
                if paths.parts[number + 1].block != part.block:
                    mixer.learn()
        np.add.at(total, [w[0] for w in pack], np.bincount(paths.lane, np.log(chance), len(pack)))
    return total / math.log(10)


def odds_apart(counts: np.ndarray) -> np.ndarray:
    """The odds of each slot as a decision that was counted in it finds them, without itself: for a zero, then for a one."""
    apart = np.empty(counts.shape, np.int8)
    for start in range(0, len(counts), 1 << 18):
        part = counts[start:start + (1 << 18)]
        fewer = np.maximum(part, 1) - part.dtype.type(1)
        apart[start:start + len(part), 0] = odds(fewer[:, 0], part[:, 1])
        apart[start:start + len(part), 1] = odds(part[:, 0], fewer[:, 1])
    return apart.ravel()


def together(tables: list) -> list[np.ndarray]:
    """Tables in one piece of new memory, which the system can hold in large pages: random look-ups are cheaper there
    than in what a broadcast was unpacked to."""
    return np.split(np.concatenate(tables), np.cumsum([len(t) for t in tables])[:-1])


def learn_weights(texts: list, code: Code, bits: int, apart: list, mixer: Mixer, tries: np.ndarray) -> None:
    """Goes on learning weights, and what comes of each mixed prediction, from texts that were counted:
    every decision is predicted by the counts without itself. `apart` holds `odds_apart` of each context.

    Most decisions know all contexts, so those are worked on as one set."""
    turns, rows, known = code.turn, code.place.astype(np.intp) * (2 * BUCKETS), GATES - 1
    rows += code.turn
    for pack in packs(texts):
        paths = Paths(pack, code)
        turn = picked(turns, paths.step)
        small = [paths.found(kind, width, odds_of, turn) for kind, (width, odds_of) in enumerate(zip(widths(bits), apart))]
        gate, came = gates(small), np.zeros(2 * tries.shape[1], np.int64)
        for number, part in enumerate(paths.parts):
            now = slice(part.first, part.end)
            inputs = [values[now].astype(np.float32) for values in small]
            for values in inputs:
                values *= np.float32(1 / STEP)
            rest = np.flatnonzero(gate[now] != known)
            sets, few = picked(gate[now], rest).astype(np.intp), [picked(values, rest) for values in inputs]
            mixed = mixer.mixed_by(known, inputs)
            mixed[rest] = mixer.mixed(sets, few)
            likely = likelihood(mixed)
            np.add.at(came, bucket_in(picked(rows, paths.step[now]), mixed, 2), 1)
            error = turn[now].astype(np.float32)
            error -= likely
            mixer.note(sets, few, picked(error, rest), picked(likely, rest))
            error[rest] = likely[rest] = 0
            mixer.note_by(known, inputs, error, likely)
            if number + 1 == len(paths.parts) or paths.parts[number + 1].lot != part.lot:
                mixer.learn()
        tries[0] += came.reshape(-1, 2).sum(1)
        tries[1] += came[1::2]


# ---- learning from a corpus ---------------------------------------------------------------------

def held_out(fold: int = HELD_FOLD, folds: int = FOLDS):
    """Whether a document is not learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(True))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text")


def histogram(learning: DataFrame) -> np.ndarray:
    """How often each byte comes in the texts, and how many ends there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for piece in _batches(batches):
            data = b"".join(map(text_bytes, piece.column(1).to_pylist()))
            total += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    found = learning.mapInArrow(run, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    made = np.zeros(256, np.int64)
    for row in found:
        made[row.byte] = row.n
    return made


def _narrowest(values: np.ndarray) -> bytes:
    """Counts as the smallest unsigned numbers that hold them all."""
    most = int(values.max())
    kind = next(kind for kind in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(kind).max)
    return zlib.compress(values.astype(kind).tobytes(), 1)


def _counted(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, f"<u{len(raw) // (2 * PAGE)}")


def add_counts(texts: list, code: Code, bits: int, total: np.ndarray) -> None:
    """Adds what the texts hold to the zeros and ones of all slots, context after context.

    The same byte after an equal context takes the same path, so what is equal is sorted together first and
    takes the path once, with its number."""
    keys, size = [], 0
    for pack in packs(texts):
        runs = [part for _, before, body in pack for part in (before, body)]
        data = np.frombuffer(b"".join(runs), np.uint8)
        scored = np.repeat(np.tile([False, True], len(pack)), [len(run) for run in runs])
        keys.append([((base.astype(np.int64) << 8) | data)[scored] for base in contexts(data)])
        size += len(data)
        if size >= COUNT_BYTES:
            add_keys(keys, code, bits, total)
            keys, size = [], 0
    if keys:
        add_keys(keys, code, bits, total)


def add_keys(keys: list, code: Code, bits: int, total: np.ndarray) -> None:
    """Adds bytes after contexts to the zeros and ones of all slots. `keys` holds, per pack and context, hashes and bytes."""
    marks = marks_of(code).astype(np.uint32)
    short = (code.longest - code.length).astype(np.uint8)
    start = 0
    for held, width in zip(zip(*keys), widths(bits)):
        key = np.concatenate(held)
        key.sort()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(starts, len(key))).astype(np.uint32)
        key = key[starts]
        order = np.argsort(picked(short, key & 255), kind="stable")  # the longest paths first
        key, times = key[order], times[order]
        path, base = (key & 255) * code.longest, (key >> 8).astype(np.uint32)
        takes = np.bincount(picked(short, key & 255), minlength=code.longest + 1).cumsum()[:-1][::-1]
        slots = total[start:start + (2 << width)]
        for k, n in enumerate(takes.tolist()):
            step = path[:n] + k
            at = (base[:n] + picked(marks, step) >> np.uint32(32 - width)).astype(np.intp)
            at <<= 1
            at |= picked(code.turn, step)
            np.add.at(slots, at, times[:n])
        start += 2 << width


def count_slots(learning: DataFrame, code: Code, bits: int) -> list[np.ndarray]:
    """Zeros and ones of every slot over all learning documents, however many.

    Tasks add up what their texts hold and give pages of it; pages meet by number and are added one
    after the other. The number of slots is fixed, so the result comes to the driver.
    """
    slots = [1 << width for width in widths(bits)]
    first = np.append(0, np.cumsum(slots))
    pages = -(-int(first[-1]) // PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = None, 0
        for piece in _batches(batches):
            size = ((pc.sum(pc.binary_length(piece.column(1))).as_py() or 0) + piece.num_rows) * code.longest
            if held + size >= MOST_HELD and held:
                yield from paged(total)
                total, held = None, 0
            total = np.zeros(2 * PAGE * pages, np.uint32) if total is None else total
            add_counts(piece.column(1).to_pylist(), code, bits, total)
            held += size
        if held:
            yield from paged(total)

    def paged(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for page, values in enumerate(total.reshape(pages, 2 * PAGE)):
            if values.any():
                yield done(page, values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        for batch in batches:
            for page, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page != current:
                    if total is not None:
                        yield done(current, total)
                    current, total = page, np.zeros(2 * PAGE, np.int64)
                total += _counted(counts).astype(np.int64)
        if total is not None:
            yield done(current, total)

    def done(page: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([_narrowest(total)])], names=["page", "counts"])

    schema = "page int, counts binary"
    summed = learning.mapInArrow(run, schema).repartition("page").sortWithinPartitions("page").mapInArrow(add, schema)
    found = {row.page: _counted(row.counts) for row in summed.collect()}  # one job whatever the partitions
    counts = np.zeros((pages, 2 * PAGE), np.result_type(np.uint16, *{values.dtype for values in found.values()}))
    for page, values in found.items():
        counts[page] = values
    pairs = counts.reshape(-1, 2)
    return [pairs[start:start + n] for start, n in zip(first, slots)]


def fit(docs: DataFrame) -> Model:
    """Learns from all documents that are not held out. Null and empty texts teach their end alone;
    without learning documents every decision is even.

    Weights are learned online in every task from its own documents, so they depend on how the table is split; those of the tasks are averaged by how
    much each set has learned.
    """
    bound_batches(docs.sparkSession)
    learning = _texts(docs).filter(~held_out())
    bytes_seen = histogram(learning)
    n_bytes = int(bytes_seen.sum() - bytes_seen[END])
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n_bytes // SLOT_BYTES)))))
    code = make_code(bytes_seen)
    counts = count_slots(learning, code, bits)
    shared = docs.sparkSession.sparkContext.broadcast([odds_apart(c) for c in counts])
    first = np.full((CONTEXTS, GATES), FIRST_WEIGHT)
    width = 256 * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, tries = Mixer(first, LEARN_PRIOR), np.zeros((2, width), np.int64)
        apart = together(shared.value)
        for piece in _batches(batches):
            learn_weights(piece.column(1).to_pylist(), code, bits, apart, mixer, tries)
        at, seen = np.flatnonzero(tries[0]), mixer.seen - LEARN_PRIOR
        rows = [np.concatenate([at, width + np.arange(CONTEXTS * GATES)]),
                np.concatenate([tries[0][at], np.rint(np.tile(seen, CONTEXTS) * EXACT).astype(np.int64)]),
                np.concatenate([tries[1][at], np.rint((mixer.weights * seen).ravel() * EXACT).astype(np.int64)])]
        yield pa.RecordBatch.from_arrays([pa.array(row) for row in rows], names=["at", "n", "sum"])

    parts = learning.mapInArrow(run, "at bigint, n bigint, sum bigint").groupBy("at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    total = np.zeros((2, width + CONTEXTS * GATES))
    for row in parts.collect():  # no more rows than the table and the weights have places
        total[:, row.at] = row.n, row["sum"]
    shared.unpersist()
    tries, (share, learned) = total[:, :width], total[:, width:].reshape(2, CONTEXTS, GATES)
    weights = np.where(share > 0, learned / np.maximum(share, 1), first)
    middle = likelihood(np.tile(np.linspace(-REACH, REACH, BUCKETS), 256))
    refined = (tries[1] + REFINE_PRIOR * middle) / (tries[0] + REFINE_PRIOR)
    return Model(code, bits, counts, weights, refined.astype(np.float32))


# ---- scores of a corpus -------------------------------------------------------------------------

CHUNK = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())),
                      T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())),
                      T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("words", T.ArrayType(T.StringType())),
                      T.StructField("learned", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.BinaryType())])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A to Z in lower case, one text after the other, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy()
    full = pc.not_equal(pc.binary_length(words), 0)  # nothing stands before a first space and after a last one
    until = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[np.append(0, np.cumsum(sizes))]
    return words.filter(full), np.diff(until)


def scored_chunks(docs: DataFrame, model: Model) -> DataFrame:
    """Chunks of documents with their scores, their distinct words, how often the learning documents
    of the chunk hold each, and the words of every document in order. The end is the empty word."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((model.code, model.bits, model.weights, model.refined,
                                           [odds(c[:, 0], c[:, 1]) for c in model.counts]))
    arrow = to_arrow_schema(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bits, weights, refined, table = shared.value
        model, table = Model(code, bits, None, weights, refined), together(table)
        first, chunk = TaskContext.get().partitionId() << CHUNK_BITS, 0
        rows, parts, held = [], [], 0

        def done() -> pa.RecordBatch:
            ids, out, sizes, scores = zip(*rows)
            coded = pa.concat_arrays(parts).dictionary_encode()
            sizes = np.array(sizes)
            tokens, word = np.zeros(held, np.int32), np.ones(held, bool)
            word[np.cumsum(sizes) - 1] = False  # the end has number 0
            tokens[word] = coded.indices.to_numpy() + 1
            names = pa.concat_arrays([pa.array([""], coded.dictionary.type), coded.dictionary])
            learned = np.bincount(tokens[np.repeat(~np.array(out), sizes)], minlength=len(names))
            columns = [pa.array([first + chunk])]
            for values, field in zip((ids, out, sizes, scores, names, learned), list(arrow)[1:7]):
                columns.append(pa.ListArray.from_arrays([0, len(values)], pa.array(values, field.type.value_type)))
            columns.append(pa.array([pa.compress(tokens.tobytes(), codec="zstd", asbytes=True)], arrow.field("tokens").type))
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for piece in _batches(batches):
            scores = score_texts(piece.column(1).to_pylist(), model, table).tolist()
            words, sizes = split_words(piece.column(1))
            parts.append(words)
            rows += zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), (sizes + 1).tolist(), scores)
            held += len(words) + len(sizes)
            if held >= CHUNK_WORDS:
                yield done()
                chunk += 1
                rows, parts, held = [], [], 0
        if rows:
            yield done()

    return _texts(docs).withColumn("held", held_out()).mapInArrow(run, CHUNK)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The base counts words of all learning documents. Words of a chunk meet those of the others as one
    row each, so a word has no more rows than there are chunks; a count goes back only where it differs
    from the chunk's own. Null and empty texts
    are their end alone, null ids are held out, repeated rows stay as they are, an empty table
    gives no rows, and further columns are not read.
    """
    chunks = written(scored_chunks(docs, model), "chunks")
    n_tokens = chunks.agg(F.sum(F.aggregate("learned", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "learned")).alias("at", "w")).select(
        "chunk", "at", F.col("w.words").alias("word"), F.col("w.learned").cast("bigint").alias("own"))
    one = Window.partitionBy("word")
    total = words.select("chunk", "at", "own", F.sum("own").over(one).alias("c"),
                         (F.min(F.struct("chunk", "at")).over(one) == F.struct("chunk", "at")).alias("first"))
    counted = written(total.select("chunk", "at", "c", (F.col("c") != F.col("own")).alias("goes"), "first").filter(
        "c > 0 AND (goes OR first)"), "vocabulary")
    n_words = counted.filter("first").count()
    under = n_tokens + 0.5 * (n_words + 1)
    back = counted.filter("goes").groupBy("chunk").agg(F.collect_list(F.struct("at", "c")).alias("back"))
    joined = chunks.drop("words").join(back, "chunk", "left").select(
        "ids", "held", "sizes", "scores", "learned", "tokens", F.col("back.at").alias("at"), F.col("back.c").alias("c"))
    schema = T.StructType([T.StructField(name, kind) for name, kind in (
        ("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()),
        ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, out, sizes, scores, learned, tokens, at, c = (batch.column(i)[row] for i in range(8))
                counts = learned.values.to_numpy().astype(np.int64)
                if at.is_valid:
                    counts[at.values.to_numpy()] = c.values.to_numpy()
                size = sizes.values.to_numpy()
                each = np.frombuffer(pa.decompress(tokens.as_buffer(), 4 * int(size.sum()), codec="zstd"), np.int32)
                first = np.cumsum(size) - size
                made = [ids.values, out.values, sizes.values, np.add.reduceat((counts > 0)[each].astype(np.int64), first),
                        np.full(len(size), n_tokens), np.add.reduceat(np.log10((counts + 0.5) / under)[each], first), scores.values]
                yield pa.RecordBatch.from_arrays([pa.array(m, f.type) for m, f in zip(made, arrow)], schema=arrow)

    return joined.mapInArrow(run, schema)
