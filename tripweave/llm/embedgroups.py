"""Groups of near embeddings of one label, by graph search in every shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripweave.llm import hnsw
from tripweave.llm.common import written
from tripweave.llm.components import connected_components, union
from tripweave.operators.keyed import is_small

LEAST_COSINE = 0.98
SHARD_ROWS = 8192
SHARD_SCHEMA = "label int, dims int, shard int, ids binary, copies binary, graph binary"


def usable(embedding: str, label: str):
    """A vector that can link: labelled, every component a finite number, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares must neither vanish nor overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _classes(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Equal vectors of a label as one row: its number, the lowest id, how many there are, and
    its shard among those of its label, as many as its vectors need."""
    classes = written(rows.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("copies")).withColumns({
            "class_id": F.monotonically_increasing_id(), "dims": F.size("embedding")}), "classes")
    shards = classes.groupBy("label", "dims").agg(
        F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    joined = classes.join(F.broadcast(shards) if is_small(shards) else shards, ["label", "dims"])
    return joined.withColumn("shard", F.pmod(F.xxhash64("embedding"), "shards").cast("int"))


def _graphs(classes: DataFrame) -> DataFrame:
    """One row per shard: class ids, copies, and the graph of its unit vectors.

    A shard's vectors come sorted to one task, about `SHARD_ROWS` of them.
    """
    dealt = classes.select("label", "dims", "shard", "class_id", "copies", "embedding").repartition(
        "label", "dims", "shard").sortWithinPartitions("label", "dims", "shard", F.xxhash64("embedding"), "class_id")

    def built(key: tuple, parts: list) -> pa.RecordBatch:
        ids, copies, vectors = (np.concatenate(x) for x in zip(*parts))
        graph = hnsw.build(_unit(vectors))
        return pa.RecordBatch.from_arrays(
            [*(pa.array([k], pa.int32()) for k in key), pa.array([ids.tobytes()]), pa.array([copies.tobytes()]),
             pa.array([graph.to_bytes()])], names=["label", "dims", "shard", "ids", "copies", "graph"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for start, end in zip(starts, np.append(starts[1:], len(keys))):
                key, piece = tuple(keys[start].tolist()), batch.slice(start, end - start)
                if parts and key != current:
                    yield built(current, parts)
                    parts = []
                current = key
                vectors = piece.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                parts.append((piece.column(3).to_numpy(), piece.column(4).to_numpy(), vectors.reshape(len(piece), key[1])))
        if parts:
            yield built(current, parts)

    return dealt.mapInArrow(run, SHARD_SCHEMA)


def _pair_links(left: dict, right: dict | None, least: float) -> Iterator[tuple]:
    """Per class of two shards (or of one with itself): linked vectors, and the class that
    stands for its group in these shards. Each shard is searched for all vectors of the other,
    and a link found from either side counts for both."""
    one = hnsw.Graph.from_bytes(left["graph"])
    two = None if right is None else hnsw.Graph.from_bytes(right["graph"])
    near = hnsw.near_matrix(one, two, least)[0]
    if right is None:
        np.fill_diagonal(near, False)
    ids = [np.frombuffer(side["ids"], np.int64) for side in (left, right or left)]
    copies = [np.frombuffer(side["copies"], np.int64) for side in (left, right or left)]
    shift = 0 if right is None else len(ids[0])
    every = ids[0] if right is None else np.concatenate(ids)
    labels, counts = np.arange(len(every)), np.zeros(len(every), np.int64)
    for start in range(0, len(near), 512):
        block = near[start:start + 512]
        counts[start:start + len(block)] += block @ copies[1]
        if right is not None:
            counts[shift:] += copies[0][start:start + len(block)] @ block
        a, b = np.nonzero(block)
        labels = union(labels, a + start, b + shift)
    hit = np.flatnonzero(counts)
    return every[hit], counts[hit], every[labels[hit]]


def _links(graphs: DataFrame, least: float) -> DataFrame:
    """class_id, links and root for every class and pair of shards in which it has links."""
    shards = graphs.select("label", "dims", "shard")
    left = shards.withColumnRenamed("shard", "i")
    pairs = left.join(shards.withColumnRenamed("shard", "j"), ["label", "dims"]).filter("i <= j")
    one = graphs.select("label", "dims", F.col("shard").alias("i"), F.struct("ids", "copies", "graph").alias("a"))
    two = graphs.select("label", "dims", F.col("shard").alias("j"), F.struct("ids", "copies", "graph").alias("b"))
    own = one.withColumn("b", F.lit(None).cast(one.schema["a"].dataType)).select("a", "b")
    crossed = pairs.filter("i < j").join(one, ["label", "dims", "i"]).join(two, ["label", "dims", "j"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pair = batch.slice(row, 1).to_pylist()[0]
                ids, counts, roots = _pair_links(pair["a"], pair["b"], least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(counts), pa.array(roots)], names=["class_id", "links", "root"])

    return own.unionByName(crossed).repartition(F.xxhash64("a.ids", "b.ids")).mapInArrow(
        run, "class_id bigint, links bigint, root bigint")


def near_vectors(embeddings: DataFrame, least: float = LEAST_COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors of one label and size link at a cosine of `least` or more; a vector that is null,
    zero, unlabelled or has a null, NaN or infinite component links with nothing and is its own
    component. Equal vectors meet as one class, so copies cost one search: they link with
    each other and share links and component. component_id is the lowest vec_id reachable (null
    ids don't count), kept is whether it is the row's own; rows without an id have their class's
    component. Repeated rows count as vectors of their own, an empty table gives no rows, and
    further columns are not read.
    """
    rows = embeddings.select(
        embeddings["vec_id"].cast("bigint").alias("vec_id"), embeddings["label"].cast("int").alias("label"),
        embeddings["embedding"].cast("array<double>").alias("embedding"))
    rows = rows.withColumn("_usable", usable("embedding", "label"))
    able, rest = rows.filter("_usable"), rows.filter("NOT _usable")
    classes = written(_classes(able, shard_rows), "vectors")
    found = written(_links(written(_graphs(classes), "graphs"), least), "found")
    members = connected_components(found, "class_id", "root").withColumnRenamed("node", "class_id")
    linked = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    named = written(classes.select("class_id", "label", "embedding", "first_id", "copies").join(
        linked, "class_id", "left").join(members, "class_id", "left").select(
            "label", "embedding", "first_id", F.coalesce("component", "class_id").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    result = able.select("vec_id", "label", "embedding").join(
        named.join(lowest, "root").select("label", "embedding", "n_links", "component_id"), ["label", "embedding"])
    alone = rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = result.select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
