"""SimHash fingerprints, links of near ones by a binary trie self-join, and their groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tripweave.llm.common import text_columns, written
from tripweave.llm.components import connected_components, union

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
BITS = 64
BUCKET_ROWS = 20_000
CHUNK_ROWS = 50_000
FRONTIER = 2_000_000
EACH_BYTE = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words_each: int = SHINGLE_WORDS) -> list[int]:
    """Hashes of the runs of `words_each` words, repeats included; fewer words are one run."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return [digest(joined, HASH_SEED)]
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[end + 1 for end in ends[:-words_each]]]
    return [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[words_each - 1:])]


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text the bits set in over half of its hashes; no hashes give zero.

    One bit of all eight bytes is added up at a time, in groups of at most 255 hashes, so
    that the eight sums of a group share one number.
    """
    result = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return result
    size = lengths[full]
    first = np.cumsum(size) - size
    groups = -(-size // 255)
    text = np.repeat(np.arange(len(full)), groups)
    number = np.arange(len(text)) - np.repeat(np.cumsum(groups) - groups, groups)
    starts = first[text] + 255 * number
    firsts = np.cumsum(groups) - groups
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & EACH_BYTE, starts)
        counts = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), firsts)
        most = (2 * counts > size[:, None]).astype(np.uint64)
        for byte in range(8):
            result[full] |= most[:, byte] << np.uint64(8 * byte + bit)
    return result


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words_each: int = SHINGLE_WORDS) -> DataFrame:
    """The columns `keep` of every document and fp, its 64-bit fingerprint as a signed number."""
    def make():
        def work(texts: list) -> list:
            each = [shingle_hashes(text, words_each) for text in texts]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter((h for hashes in each for h in hashes), np.uint64, int(lengths.sum()))
            return [majority_bits(flat, lengths).view(np.int64)]
        return work

    return text_columns(docs, make, [T.StructField("fp", T.LongType())], keep)


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> Iterator[tuple]:
    """Positions of all pairs within a bucket that differ in at most `budget` bits.

    The values of a bucket lie sorted between its start and end, so the nodes of its binary
    trie are ranges. Pairs of nodes go down together, one bit at a time for all pairs at
    once: children on the same side keep the count of differing bits, others add one, and
    pairs over the budget are dropped. A long list of pairs is halved and one half waits, so
    memory stays bounded.
    """
    whole = np.flatnonzero(ends - starts > 1)
    waiting = [(BITS - 1, starts[whole], ends[whole], starts[whole], ends[whole], np.zeros(len(whole), np.int8))]
    ones = {}
    for bit in range(BITS):
        ones[bit] = np.append(0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int32))
    while waiting:
        bit, a0, a1, b0, b1, spent = waiting.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            for part in (slice(None, half), slice(half, None)):
                waiting.append((bit, a0[part], a1[part], b0[part], b1[part], spent[part]))
            continue
        if bit < 0:
            yield a0, b0
            continue
        count = ones[bit]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        own = (a0 == b0) & (a1 == b1)
        sides = [(a0, am, b0, bm, spent, None), (am, a1, bm, b1, spent, None),
                 (a0, am, bm, b1, spent + 1, None), (am, a1, b0, bm, spent + 1, ~own)]
        parts = []
        for lo, hi, low, high, errors, allowed in sides:
            held = (hi > lo) & (high > low) & (errors <= budget) & ~((lo == low) & (hi - lo == 1))
            held = np.flatnonzero(held if allowed is None else held & allowed)
            if len(held):
                parts.append((lo[held], hi[held], low[held], high[held], errors[held]))
        if parts:
            waiting.append((bit - 1, *map(np.concatenate, zip(*parts))))


def bucket_links(buckets: np.ndarray, values: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of distinct values to the lowest value of their group within a bucket."""
    order = np.lexsort((values, buckets))
    buckets, values = buckets[order], values[order]
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    ends = np.append(starts[1:], len(buckets))
    labels = np.arange(len(values))
    for left, right in trie_pairs(values, starts, ends, budget):
        labels = union(labels, left, right)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return values[linked], values[labels[linked]]


def _blocks(free: int, parts: int) -> list[tuple[int, int]]:
    """`free` bits cut into as many blocks of about equal width: place and width of each."""
    edges = [free * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _spread(rows: DataFrame, level: int, budget: int) -> DataFrame:
    """Each row once per block of its free bits, in the bucket of the block's value.

    Values that differ in at most `budget` bits agree in one of budget + 1 blocks. `mask`
    holds the bits that all rows of a bucket share. The free bits of a mask are numbered
    from the lowest; blocks are cut from them, so every level shares more bits.
    """
    masks: list[int] = [0]
    for _ in range(level):
        masks = [mask | extra for mask in masks for extra in _block_masks(mask, budget)]
    choices = {mask: _block_masks(mask, budget) for mask in dict.fromkeys(masks)}
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    options: Column | None = None
    for mask, extras in choices.items():
        array = F.array(*[F.lit(signed(mask | extra)) for extra in extras])
        case = F.col("mask") == F.lit(signed(mask))
        options = F.when(case, array) if options is None else options.when(case, array)
    spread = rows.select("fp", F.explode(options).alias("mask"))
    return spread.withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def _block_masks(mask: int, budget: int) -> list[int]:
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    return [sum(1 << bit for bit in free[at:at + width]) for at, width in _blocks(len(free), budget + 1)]


def near_links(distinct: DataFrame, budget: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links a, b that join all fingerprints within `budget` bits of each other, as stars.

    Takes distinct fingerprints, so copies meet as one row. Rows are dealt to buckets of equal
    blocks of bits. A bucket of more than `bucket_rows` is dealt again by blocks of its
    other bits; each level leaves at most two thirds of the bits free (with a budget of 2),
    so a few levels bound any bucket of distinct values. The trie self-join then runs in the
    buckets of a task, and of each group found only one link per member leaves it.
    """
    level, rows = 0, distinct.select("fp", F.lit(0).cast("bigint").alias("mask"))
    settled = []
    while True:
        spread = written(_spread(rows, level, budget), "buckets")
        large = spread.groupBy("bucket").count().filter(F.col("count") > bucket_rows).select("bucket")
        large = written(large, "large")
        if large.isEmpty():
            settled.append(spread)
            break
        settled.append(spread.join(large, "bucket", "left_anti"))
        rows = spread.join(large, "bucket", "left_semi").select("fp", "mask")
        level += 1
    dealt = settled[0]
    for more in settled[1:]:
        dealt = dealt.unionByName(more)
    dealt = dealt.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_buckets, held_values = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(buckets: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_links(buckets, values.view(np.uint64), budget)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held_buckets = np.concatenate([held_buckets, batch.column(0).to_numpy()])
            held_values = np.concatenate([held_values, batch.column(1).to_numpy()])
            if len(held_buckets) >= CHUNK_ROWS:
                cut = int(np.searchsorted(held_buckets, held_buckets[-1]))
                if cut:
                    yield links(held_buckets[:cut], held_values[:cut])
                    held_buckets, held_values = held_buckets[cut:], held_values[cut:]
        if len(held_buckets):
            yield links(held_buckets, held_values)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def groups(prints: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """fp, root and component_id of every distinct fingerprint of a stored table doc_id, fp.

    root is the lowest fingerprint of the group. component_id is the lowest doc_id among all documents whose fingerprints are reachable
    by links of at most `budget` differing bits; null ids don't count, and a group of null
    ids alone has null.
    """
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    members = connected_components(near_links(classes, budget), "a", "b")
    joined = classes.join(members.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root"))
    joined = written(joined, "members")
    lowest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return joined.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    A null or empty text has fingerprint zero and links like any other. Repeated rows and
    null ids stay as they are (see `groups`), an empty table gives no rows, and further
    columns are not read.
    """
    prints = written(fingerprints(docs), "prints")
    return prints.join(groups(prints, budget), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _hashable(name: str, kind: str) -> Column:
    """A column as something that can be hashed; maps, wherever they lie in it, as JSON."""
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column), {"ignoreNullFields": "false"}) if "map<" in kind else column


def keyed_rows(docs: DataFrame) -> DataFrame:
    """Documents as one column `doc`, whatever their columns are called, with what tells rows
    apart: `key`, the id as text, and `row`, a hash of all columns."""
    return docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
        F.xxhash64(*[_hashable(*column) for column in docs.dtypes]).alias("row"))


def first_of_each(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Of the keyed rows, the document of one of each root in `found` (doc_id, key, row, root): the
    one with the lowest id (nulls last), of equal ids the one with the lowest hash.

    Rows that lose are taken out by an anti join, so the texts themselves are joined only where
    the losers are too many to broadcast. Repeated rows that win are taken out the same
    way and come back once each.
    """
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row").alias("r"))
    rows = written(found.select(F.col("root").alias("owner"), "key", "row", order.alias("place")), "rows")
    first = rows.groupBy("owner").agg(F.min("place").alias("first"))
    winners = first.select(F.coalesce(F.col("first.i").cast("string"), F.lit("")).alias("key"),
                           F.col("first.r").alias("row"), F.lit(True).alias("wins"))
    keys = ["key", "row"]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(winners, keys, "left")
    out = written(counted.filter("wins IS NULL OR n > 1"), "out")
    kept = keyed.join(out.select(*keys), keys, "left_anti")
    again = keyed.join(out.filter("wins").select(*keys), keys, "left_semi").dropDuplicates(keys)
    return kept.unionByName(again).select("doc.*")


def keep_one_of_each(docs: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """One document of each group of near fingerprints, with all its columns (see `first_of_each`).

    Null and empty texts are one group. Of repeated rows one stays, null ids lose against any
    id, an empty table gives no rows, and further columns may have any name and type.
    """
    keyed, place = keyed_rows(docs), ("doc_id", "key", "row")
    prints = written(fingerprints(keyed.select("doc.doc_id", "doc.text", "key", "row"), place), "prints")
    return first_of_each(keyed, prints.join(groups(prints, budget).select("fp", "root"), "fp"))
