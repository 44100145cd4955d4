"""Stored positional postings: keyword search that reads its terms instead of all texts.

An index is a folder of two tables. `postings` has a row per term and document with the places of
the term, in folders by generation and term bucket; in a bucket rows lie by parts of the documents
and in order of term, so that a search reads the buckets of its terms and of those the row groups
with them, and a term that is everywhere is spread over all parts. Places are delta-coded by the
file format. `documents` names the generation in which each document was indexed last.

New and changed documents are a generation of their own: nothing that is stored is touched, and
postings of older generations of a document no longer count. `compact` writes the living postings
anew as one generation.

An index is built in one pass: places are grouped by word where the texts lie, a chunk of
documents at a time, each chunk's words are stemmed there, and what is shuffled are a chunk's places for each
bucket and part, packed. A search shuffles the postings of its terms by document before they meet the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.functions.stemming import with_stem
from tripweave.functions.text import STOP_WORDS, tokens
from tripweave.operators import textsearch
from tripweave.operators.keyed import is_small, settle
from tripweave.session import bound_batches
from tripweave.sources.tables import create_if_absent, overwrite_touched

BUCKETS = 64
#: Parts of the documents within a bucket; a term's postings are spread over as many files.
PARTS = 8
#: Documents are kept in folders by a hash of the id, so that a change rewrites its folders only.
SHELVES = 32
DOCUMENTS = "generation bigint, doc_id bigint, n_words int, embedded boolean, shelf int"
#: Words of a chunk: a word is stemmed once in each, and its places are packed together.
CHUNK_WORDS, CHUNK_BITS = 1 << 22, 40
#: Packed postings that are unpacked into one batch.
UNPACKED_ROWS = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _by_word(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """chunk, term and held: for every chunk of documents a row with their ids, under the empty term, and one per word that is
    no stop word, with its places. A place is the number of the document in the chunk, then that of the word in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << CHUNK_BITS
        held, n_words = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy(), batch.column(1).flatten()))
            n_words += len(held[-1][2])
            if n_words >= CHUNK_WORDS:
                yield grouped(chunk, *zip(*held))
                chunk += 1
                held, n_words = [], 0
        if held:
            yield grouped(chunk, *zip(*held))

    def grouped(chunk: int, ids: tuple, sizes: tuple, words: tuple) -> pa.RecordBatch:
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        coded = pa.chunked_array(words, pa.string()).dictionary_encode().unify_dictionaries().combine_chunks()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        word, n = coded.indices.to_numpy(), len(coded.dictionary)
        place = np.repeat(np.arange(len(sizes)) << 32, sizes) + np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        counts = np.bincount(word, minlength=n)
        counts[pc.is_in(coded.dictionary, pa.array(STOP_WORDS, pa.string())).to_numpy(zero_copy_only=False)] = 0
        kept = np.flatnonzero(counts[word])
        order = kept[np.argsort(word[kept], kind="stable")]
        used = np.flatnonzero(counts)
        terms = pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(used))])
        ends = np.cumsum(np.concatenate([[0, len(sizes)], counts[used]]))
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), np.concatenate([ids, place[order]]))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), chunk)), terms, places], names=["chunk", "term", "held"])

    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), tokens(F.coalesce(text, F.lit(""))).alias("words"))
    return rows.filter("doc_id IS NOT NULL").mapInArrow(run, "chunk bigint, term string, held array<bigint>")


def _packed(terms: DataFrame) -> DataFrame:
    """bucket, part and the packed postings of each chunk's terms that fall there. Rows of a chunk follow each other, its ids
    first; words that have become one term are merged."""
    def packed(chunk: pa.Table) -> Iterator[tuple]:
        held = chunk.column("held").combine_chunks()
        sizes = pc.list_value_length(held).to_numpy()
        values = held.flatten().to_numpy()
        ids, place = values[:sizes[0]], values[sizes[0]:]
        if not len(place):
            return
        coded = chunk.column("term").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        bucket = np.zeros(len(coded.dictionary), np.int64)
        bucket[code] = chunk.column("bucket").to_numpy()
        part = ((ids.astype(np.uint64) * MIX) >> np.uint64(40)).astype(np.int64) % PARTS
        term = np.repeat(code[1:], sizes[1:])
        group = (bucket[term] * PARTS + part[place >> 32]) * len(bucket) + term
        order = np.lexsort((place, group))
        group, place = group[order], place[order]
        document = place >> 32
        starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (document[1:] != document[:-1])))
        times = np.diff(np.append(starts, len(place)))
        own, document = group[starts], ids[document[starts]]  # of each term and document
        where = own // len(bucket)
        cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        place = (place & 0xFFFFFFFF).astype(np.int32)
        for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)]):
            first, end = starts[start], starts[stop] if stop < len(own) else len(place)
            each = np.flatnonzero(np.append(True, own[start + 1:stop] != own[start:stop - 1]))
            words = "\n".join(coded.dictionary.take(pa.array(own[start:stop][each] % len(bucket))).to_pylist())
            yield int(where[start]) // PARTS, int(where[start]) % PARTS, _squeezed(words, np.diff(np.append(each, stop - start)), document[start:stop], times[start:stop], place[first:end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            rows = list(packed(pa.Table.from_batches(held)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "part", "packed"])

        held: list = []
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for start, stop in zip(cuts, cuts[1:]):
                if held and held[-1].column(0)[0].as_py() != chunk[start]:
                    yield from done()
                    held = []
                held.append(batch.slice(start, stop - start))
        if held:
            yield from done()

    return terms.select("chunk", "term", _bucket("term").alias("bucket"), "held").mapInArrow(run, "bucket int, part int, packed binary")


def _squeezed(words: str, documents_of: np.ndarray, documents: np.ndarray, places_of: np.ndarray, places: np.ndarray) -> bytes:
    """Terms, how many documents each has, these, how many places each has, and these, with equal bytes of the numbers side by side."""
    text = words.encode()
    sizes = np.array([len(text), len(documents_of), len(documents), len(places)], "<i8")
    data = [sizes.tobytes(), text]
    for values, kind in ((documents_of, "<i4"), (np.diff(documents, prepend=0), "<i8"), (places_of, "<i4"), (np.diff(places, prepend=0), "<i4")):
        data.append(values.astype(kind).view(np.uint8).reshape(-1, int(kind[2:])).T.tobytes())
    raw = b"".join(data)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes) -> tuple[list, list[np.ndarray]]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    sizes = np.frombuffer(raw, "<i8", 4).tolist()
    at, made = 32 + sizes[0], []
    for n, kind in zip((sizes[1], sizes[2], sizes[2], sizes[3]), ("<i4", "<i8", "<i4", "<i4")):
        width = int(kind[2:])
        made.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind)[:, 0])
        at += n * width
    made[1], made[3] = np.cumsum(made[1]), np.cumsum(made[3], dtype=np.int32)
    return raw[32:32 + sizes[0]].decode().split("\n"), made


def _unpacked(rows: DataFrame) -> DataFrame:
    """bucket, term, doc_id and places of packed postings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, UNPACKED_ROWS):
                yield pa.Table.from_batches([one(*row) for row in zip(*(batch.column(i)[start:start + UNPACKED_ROWS].to_pylist() for i in (0, 1)))]
                                            ).combine_chunks().to_batches()[0]

    def one(bucket: int, data: bytes) -> pa.RecordBatch:
        words, (documents_of, documents, places_of, places) = _unsqueezed(data)
        terms = pa.array(words, pa.string()).take(pa.array(np.repeat(np.arange(len(words)), documents_of)))
        held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(places_of)), pa.int32()), pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), bucket), pa.int32()), terms, pa.array(documents), held],
                                          names=["bucket", "term", "doc_id", "places"])

    return rows.select("bucket", "packed").mapInArrow(run, "bucket int, term string, doc_id bigint, places array<int>")


def _postings(documents: DataFrame, doc_id: str, text: str, stemmed: bool) -> DataFrame:
    """bucket, term, doc_id and places of every word that is no stop word, dealt by bucket and part."""
    bound_batches(documents.sparkSession)
    terms = _by_word(documents, doc_id, text)
    if stemmed:
        terms = with_stem(terms, "term", "term")
    return _unpacked(_packed(terms).repartition("bucket", "part"))


def _write(dealt: DataFrame, path: str, generation: int) -> None:
    (dealt.sortWithinPartitions("bucket", "term", "doc_id").select("doc_id", "term", "places", "bucket")
     .withColumn("generation", F.lit(generation).cast("bigint"))
     .write.mode("append").partitionBy("generation", "bucket").option("parquet.writer.version", "v2").parquet(f"{path}/postings"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return create_if_absent(spark, f"{path}/documents", spark.createDataFrame([], DOCUMENTS).schema, ("shelf",))


def add_documents(documents: DataFrame, path: str, doc_id: str = "activity_id", text: str = "document_text",
                  embedding: str = "embedding", stemmed: bool = True) -> int:
    """Indexes documents that are new or have changed, as the next generation, and gives its number.

    Ids are unique in the rows. Only the shelves of these documents are rewritten.
    """
    spark = documents.sparkSession
    known = _documents(spark, path)
    generation = (known.agg(F.max("generation")).first()[0] or 0) + 1
    _write(_postings(documents, doc_id, text, stemmed), path, generation)
    fresh = documents.select(
        F.lit(generation).cast("bigint").alias("generation"), F.col(doc_id).cast("bigint").alias("doc_id"),
        F.size(tokens(F.coalesce(text, F.lit("")))).alias("n_words"), F.col(embedding).isNotNull().alias("embedded"),
    ).withColumn("shelf", F.pmod(F.xxhash64("doc_id"), F.lit(SHELVES)).cast("int"))
    _replace(known, fresh, fresh, path)
    return generation


def remove_documents(ids: DataFrame, path: str, doc_id: str = "activity_id") -> None:
    """Takes documents out of the index; their postings no longer count."""
    gone = ids.select(F.col(doc_id).cast("bigint").alias("doc_id")).withColumn(
        "shelf", F.pmod(F.xxhash64("doc_id"), F.lit(SHELVES)).cast("int"))
    known = _documents(ids.sparkSession, path)
    _replace(known, gone, gone.sparkSession.createDataFrame([], known.schema), path)


def _replace(known: DataFrame, changed: DataFrame, fresh: DataFrame, path: str) -> None:
    shelves = [row[0] for row in changed.select("shelf").distinct().collect()]  # at most SHELVES
    kept = known.filter(F.col("shelf").isin(shelves)).join(changed.select("doc_id"), "doc_id", "left_anti")
    # a shelf that loses its last document keeps a row without an id, so that its folder is replaced
    empty = changed.select("shelf").distinct().select(*[
        F.col("shelf") if name == "shelf" else F.lit(None).cast(kind).alias(name) for name, kind in known.dtypes])
    overwrite_touched(kept.select(*known.columns).unionByName(fresh.select(*known.columns)).unionByName(empty),
                      f"{path}/documents", ("shelf",))


def compact(spark: SparkSession, path: str, new_path: str) -> None:
    """The living postings of an index as one generation of a new one."""
    known = _documents(spark, path).filter("doc_id IS NOT NULL")
    living = spark.read.parquet(f"{path}/postings").join(known.select("generation", "doc_id"), ["generation", "doc_id"], "left_semi")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    _write(living.select("doc_id", "term", "places", _bucket("term").alias("bucket"), part.alias("part")).repartition("bucket", "part"), new_path, 1)
    known.withColumn("generation", F.lit(1).cast("bigint")).write.partitionBy("shelf").parquet(f"{new_path}/documents")


def term_postings(spark: SparkSession, path: str, terms: DataFrame, few: bool) -> DataFrame:
    """The stored postings of a table of terms. Few terms are named in filters on bucket and term, so other
    buckets are not listed and row groups without them are skipped."""
    stored = spark.read.parquet(f"{path}/postings")
    wanted = terms.select("term", _bucket("term").alias("bucket")).distinct()
    if not few:
        return stored.join(wanted, ["bucket", "term"], "left_semi")
    named = wanted.collect()
    return stored.filter(F.col("bucket").isin(sorted({row.bucket for row in named}))
                         & F.col("term").isin(sorted(row.term for row in named)))


def search(spark: SparkSession, path: str, activities: DataFrame, queries: DataFrame, doc_id: str = "activity_id",
           name: str = "name", category: str = "category", query_id: str = "query_id", query: str = "q",
           results: int = textsearch.RESULTS, stemmed: bool = True) -> DataFrame:
    """The rows of `textsearch.keyword_search`, from an index built with the same `stemmed`.

    The postings of a document meet once, next to its name; no text is read.
    """
    asked = textsearch.usable_queries(queries, query)
    few = is_small(asked.select(query), textsearch.QUERY_BYTES)
    terms = settle(textsearch.search_terms(asked, query_id, query, stemmed))
    few_terms = is_small(terms)
    plain, anywhere = textsearch.split_anywhere(terms, query_id, few_terms)
    known = _documents(spark, path).filter("doc_id IS NOT NULL")
    words = plain.filter(F.col("term") != textsearch.ANY_DOCUMENT)
    living = known.join(activities.select(F.col(doc_id).alias("doc_id"), F.col(name).alias("name")), "doc_id")
    alive = living.select("generation", "doc_id")
    found = term_postings(spark, path, words, few_terms).select("generation", "doc_id", "term", "places").join(
        F.broadcast(alive) if is_small(alive) else alive, ["generation", "doc_id"], "left_semi")
    marked = living.select("doc_id", F.lit(textsearch.ANY_DOCUMENT).alias("term"), F.array("n_words").alias("places"), "name")
    posted = found.drop("generation").withColumn("name", F.lit(None).cast("string")).unionByName(marked)
    if few_terms:  # a document's postings meet once, and the queries come to them
        together = posted.groupBy("doc_id").agg(F.collect_list(F.struct("term", "places", "name")).alias("_posted"))
        posted = together.select("doc_id", F.inline("_posted"))
    hits = posted.join(F.broadcast(plain) if few_terms else plain, "term").withColumn("pos", F.explode("places")).drop("places")
    hits = textsearch.with_rank_flag(hits).withColumnRenamed("doc_id", doc_id)
    documents = known.select(F.col("doc_id").alias(doc_id), F.when(F.col("embedded"), F.lit(1)).alias("embedding"))
    return textsearch.best_documents(hits, few_terms, anywhere, activities, documents, asked, few, doc_id, name, category,
                                     query_id, query, results)
