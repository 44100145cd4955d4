"""Embedding and cosine search: many queries against all documents in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tripweave.functions.numbers import clamp, text_bucket
from tripweave.functions.text import is_stop_word, tokens
from tripweave.operators.keyed import is_small, settle, top_per_key
from tripweave.schemas import EMBEDDING_DIM
from tripweave.session import bound_batches

DEFAULT_LIMIT = 5
MAX_LIMIT = 10
QUERY_BLOCK = 1024
#: Texts that are embedded, and queries that are scored against a block, at once.
EMBED_ROWS, SCORED_QUERIES = 1024, 128
TIE_DECIMALS = 9
CELLS, COPIES, ROUNDS, CELL_DECIMALS = 16, 2, 4, 6
#: Vectors that cells are learned from; every vector is then put into cells.
SAMPLE_ROWS = 4096
CELL_FILES = 8
LEAST_RECALL = 0.9


# --- embedding ---------------------------------------------------------------------

def feature_buckets(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Hashed bag of words: the bucket of every token that is no stop word."""
    words = F.filter(tokens(text), lambda t: ~is_stop_word(t))
    return F.transform(words, lambda t: text_bucket(t, dim))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def embed(rows: DataFrame, text: str, keep: list[str], out: str = "embedding",
          encode: Callable[[list[str]], np.ndarray] | None = None, dim: int = EMBEDDING_DIM) -> DataFrame:
    """The kept columns and a unit vector per row, computed in bounded parts of an Arrow batch.

    `encode` is the model: a list of texts to a (texts, dim) array. Without one, the
    whole text is hashed into term counts. A text without any word gives a zero vector.
    """
    bound_batches(rows.sparkSession)
    vector = T.StructField(out, T.ArrayType(T.FloatType()))
    schema = T.StructType([*rows.select(*keep).schema.fields, vector])
    whole = F.coalesce(F.col(text), F.lit(""))
    source = feature_buckets(whole, dim) if encode is None else whole

    def count_words(buckets: pd.Series) -> np.ndarray:
        sizes = np.array([len(b) for b in buckets], dtype=np.int64)
        if not sizes.sum():
            return np.zeros((len(buckets), dim))
        flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in buckets])
        cells = np.repeat(np.arange(len(buckets)) * dim, sizes) + flat
        return np.bincount(cells, minlength=len(buckets) * dim).reshape(-1, dim).astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[at:at + EMBED_ROWS] for whole in batches for at in range(0, len(whole), EMBED_ROWS)):
            batch, raw = batch.drop(columns="_source"), batch["_source"]
            matrix = count_words(raw) if encode is None else np.asarray(encode(raw.tolist()), dtype=np.float64)
            if matrix.shape != (len(batch), dim):
                raise ValueError(f"the model gave {matrix.shape} for {len(batch)} texts; vectors need {dim} dimensions")
            yield batch.assign(**{out: list(_unit_rows(matrix).astype(np.float32))})

    return rows.select(*keep, source.alias("_source")).mapInPandas(run, schema)


# --- exact search ------------------------------------------------------------------

def _pack(rows: DataFrame, keys: list[str], row_id: str, vector: str, prefix: str,
          block: int | None = None) -> DataFrame:
    """Rows of one key and one Arrow batch as one row: ids and vectors as byte blocks.

    Works inside the batch, so nothing is shuffled and a block never exceeds a batch,
    however many rows a key has. Vectors without length are left out.
    """
    bound_batches(rows.sparkSession)
    schema = T.StructType([
        *rows.select(*keys).schema.fields,
        T.StructField(f"{prefix}_ids", T.BinaryType()), T.StructField(f"{prefix}_vectors", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                ids = part[row_id].to_numpy(np.int64)
                unit = _unit_rows(np.stack(part[vector].to_numpy()).astype(np.float64))
                real = unit.any(axis=1)
                ids, unit = ids[real], unit[real]
                step = block or max(len(ids), 1)
                for start in range(0, len(ids), step):
                    packed.append((*key, ids[start:start + step].tobytes(), unit[start:start + step].tobytes()))
            yield pd.DataFrame(packed, columns=schema.fieldNames())

    return rows.select(*keys, row_id, vector).mapInPandas(run, schema)


def _score_blocks(pairs: DataFrame, doc_id: str, query_id: str, k: int) -> DataFrame:
    """Best k documents per query inside each pair of blocks, by matrix products of few queries at once."""
    bound_batches(pairs.sparkSession)
    schema = f"`{query_id}` bigint, `{doc_id}` bigint, _score double"

    def best(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) > k:
            floor = np.partition(scores, len(ids) - k)[len(ids) - k]
            near = scores >= floor
            scores, ids = scores[near], ids[near]
        order = np.lexsort((ids, -scores))[:k]
        return scores[order], ids[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                d_ids, d_raw, q_ids, q_raw = (batch.column(i)[row].as_buffer() for i in range(4))
                ids, queries = np.frombuffer(d_ids, np.int64), np.frombuffer(q_ids, np.int64)
                docs = np.frombuffer(d_raw, np.float64).reshape(len(ids), -1)
                asked = np.frombuffer(q_raw, np.float64).reshape(len(queries), -1)
                for start in range(0, len(queries), SCORED_QUERIES):
                    some = queries[start:start + SCORED_QUERIES]
                    scores = np.round(docs @ asked[start:start + SCORED_QUERIES].T, TIE_DECIMALS) + 0.0
                    found = [best(scores[:, j], ids) for j in range(len(some))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(some, [len(f[1]) for f in found])), pa.array(np.concatenate([f[1] for f in found])),
                        pa.array(np.concatenate([f[0] for f in found]))], names=[query_id, doc_id, "_score"])

    return pairs.select("d_ids", "d_vectors", "q_ids", "q_vectors").mapInArrow(run, schema)


def cosine_top_k(documents: DataFrame, queries: DataFrame, keys: list[str], doc_id: str = "doc_id",
                 query_id: str = "query_id", doc_vector: str = "embedding",
                 query_vector: str = "embedding", limit: str | None = None, once: bool = False) -> DataFrame:
    """The nearest documents of every query among those with the same keys.

    Documents are packed into blocks where they lie; query blocks are broadcast when their
    size allows it, else both sides are shuffled by key. Only the best rows of each block
    pair go on, and again only the best per task are shuffled to the final rank. Scores
    that agree to nine decimals count as equal and are ordered by id. `limit` names a
    column of the queries, clamped to 1..10; without it, five documents are given. With `once` a
    document that lies under several keys counts once per query.
    """
    present = documents.filter(F.col(doc_vector).isNotNull())
    doc_blocks = _pack(present, keys, doc_id, doc_vector, "d")
    asked = queries.filter(F.col(query_vector).isNotNull())
    query_blocks = settle(_pack(asked, keys, query_id, query_vector, "q", QUERY_BLOCK))
    if is_small(query_blocks):
        query_blocks = F.broadcast(query_blocks)
    candidates = _score_blocks(doc_blocks.join(query_blocks, keys), doc_id, query_id, MAX_LIMIT)
    if once:
        candidates = candidates.distinct()
    ranked = top_per_key(
        candidates, [query_id], [F.col("_score").desc(), F.col(doc_id).asc()], MAX_LIMIT, "rank")
    if limit is None:
        kept = ranked.filter(F.col("rank") <= DEFAULT_LIMIT)
    else:
        wanted = queries.select(query_id, clamp(F.coalesce(limit, F.lit(DEFAULT_LIMIT)), 1, MAX_LIMIT)
                                .alias("_limit")).distinct()
        kept = ranked.join(wanted, query_id).filter(F.col("rank") <= F.col("_limit"))
    return kept.select(query_id, "rank", doc_id, F.round("_score", 4).alias("similarity"))


def semantic_search(documents: DataFrame, activities: DataFrame, queries: DataFrame,
                    limit: str | None = None) -> DataFrame:
    """Nearest activities of each query at the query's destination (letter case counts).

    documents: activity_id, embedding and, to save a join, destination_name; queries: query_id,
    destination_name, embedding. Vectors stay where they lie if they carry their destination or
    the destinations of all activities can be broadcast.
    """
    placed = documents
    if "destination_name" not in documents.columns:
        places = activities.select("activity_id", "destination_name")
        placed = documents.join(F.broadcast(places) if is_small(places) else places, "activity_id")
    top = cosine_top_k(placed, queries, ["destination_name"], doc_id="activity_id", limit=limit)
    about = activities.select("activity_id", "name", "category", "indoor", "description")
    return top.join(about, "activity_id").select(
        "query_id", "rank", "activity_id", "name", "category", "indoor", "description", "similarity")


# --- approximate search ------------------------------------------------------------

def train_cells(rows: DataFrame, row_id: str, vector: str, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS,
                rounds: int = ROUNDS) -> np.ndarray:
    """Directions of the cells: spherical k-means on at most `sample_rows` vectors, those whose ids
    have the lowest digests.

    Cells begin as the first vectors by id; a vector goes to the cell of the highest cosine (ties:
    the lower number), and a cell without vectors stays. Directions have `CELL_DECIMALS` decimals, so
    a sum in another order gives the same cells.
    """
    present = rows.filter(F.col(vector).isNotNull()).select(F.col(row_id).alias("id"), F.col(vector).alias("v"))
    some = present.orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample_rows).collect()  # bounded
    some = sorted((row for row in some if any(row.v)), key=lambda row: row.id)
    if not some:
        return np.zeros((0, 0))
    unit = _unit_rows(np.array([row.v for row in some], np.float64))
    middle = np.round(unit[:cells], CELL_DECIMALS)
    for _ in range(rounds):
        own = nearest_cells(unit, middle, 1)[:, 0]
        for cell in range(len(middle)):
            if (own == cell).any():
                middle[cell] = np.round(_unit_rows(unit[own == cell].mean(0, keepdims=True))[0], CELL_DECIMALS)
    return middle


def nearest_cells(unit: np.ndarray, middle: np.ndarray, n: int) -> np.ndarray:
    """The n cells of the highest cosine of each row, best first."""
    return np.argsort(-np.round(unit @ middle.T, TIE_DECIMALS), axis=1, kind="stable")[:, :n]


def with_cells(rows: DataFrame, vector: str, middle: np.ndarray, n: int, cell: str = "cell") -> DataFrame:
    """Each row once per cell among its n nearest. Null vectors are left out."""
    @F.pandas_udf("array<int>")
    def cells_of(vectors: pd.Series) -> pd.Series:
        unit = _unit_rows(np.stack(vectors.to_numpy()).astype(np.float64))
        return pd.Series(list(nearest_cells(unit, middle, n).astype(np.int32)))

    return rows.filter(F.col(vector).isNotNull()).withColumn(cell, F.explode(cells_of(vector)))


def write_by_cell(documents: DataFrame, path: str, vector: str, middle: np.ndarray, copies: int = COPIES) -> None:
    """A table of the documents in folders by cell, each document in its `copies` nearest ones. A
    large cell is dealt to several tasks."""
    spread = F.pmod(F.xxhash64(*documents.columns), F.lit(CELL_FILES))
    with_cells(documents, vector, middle, copies).repartition("cell", spread).write.mode("overwrite").partitionBy("cell").parquet(path)


def tuned_probes(sample: DataFrame, queries: DataFrame, keys: list[str], middle: np.ndarray, doc_id: str,
                 query_id: str = "query_id", least: float = LEAST_RECALL, copies: int = COPIES) -> int:
    """The fewest probed cells with which the queries find at least that share of what the exact search finds."""
    exact = settle(cosine_top_k(sample, queries, keys, doc_id, query_id))
    celled = settle(with_cells(sample, "embedding", middle, copies))
    for probes in range(1, len(middle)):
        found = recall(exact, approximate_top_k(celled, queries, keys, middle, probes, doc_id, query_id), doc_id, query_id)
        hits, wanted = found.agg(F.sum("found"), F.sum("expected")).first()
        if not wanted or hits >= least * wanted:
            return probes
    return len(middle)


def probed(queries: DataFrame, middle: np.ndarray, probes: int) -> DataFrame:
    """Queries with a vector, once per cell to be searched."""
    return with_cells(queries, "embedding", middle, probes)


def read_cells(celled: DataFrame, asked: DataFrame) -> DataFrame:
    """The part of a table in folders by cell that queries ask for; other folders are not listed."""
    cells = [row.cell for row in asked.select("cell").distinct().collect()]  # no more than there are cells
    return celled.filter(F.col("cell").isin(cells))


def approximate_top_k(celled: DataFrame, queries: DataFrame, keys: list[str], middle: np.ndarray, probes: int,
                      doc_id: str = "doc_id", query_id: str = "query_id", limit: str | None = None) -> DataFrame:
    """Cosine search in the cells nearest to each query, of documents with their cells (see
    `with_cells`, `write_by_cell`). A query may get other rows than the exact search gives."""
    asked = settle(probed(queries, middle, probes))
    return cosine_top_k(read_cells(celled, asked), asked, [*keys, "cell"], doc_id, query_id, limit=limit, once=True)


def rows_read(celled: DataFrame, queries: DataFrame, keys: list[str], middle: np.ndarray, probes: int,
              query_id: str = "query_id") -> DataFrame:
    """How many rows each query's search compares, of all rows with its keys (copies counted)."""
    sizes = celled.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    totals = sizes.groupBy(*keys).agg(F.sum("n").alias("rows_all"))
    asked = probed(queries, middle, probes).select(query_id, *keys, "cell")
    return asked.join(sizes, [*keys, "cell"], "left").groupBy(query_id, *keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read")).join(totals, keys, "left").select(query_id, "rows_read", "rows_all")


def recall(exact: DataFrame, approximate: DataFrame, doc_id: str = "doc_id",
           query_id: str = "query_id") -> DataFrame:
    """Share of the exact results that the approximate search found, per query."""
    found = approximate.select(query_id, doc_id, F.lit(1).alias("_found"))
    return exact.join(found, [query_id, doc_id], "left").groupBy(query_id).agg(
        F.count("*").alias("expected"), F.count("_found").alias("found"))
