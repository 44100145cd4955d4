"""Passes over whole texts in bounded slices, and tables in the shared folder."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tripweave.session import bound_batches, ensure_checkpoint_dir

SLICE_BYTES = 2 * 1024 * 1024
Work = Callable[[list], list]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `limit` bytes of text; one row may be longer than that."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, size in enumerate(sizes):
        if held and held + int(size) > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def text_columns(rows: DataFrame, make: Callable[[], Work], outputs: list[T.StructField],
                 keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` of each row and what the work of a task makes of its texts.

    `make` runs once per task; what it returns takes a list of texts (null: None) and gives
    one sequence per output. Only the named columns are read, whatever else the rows hold.
    """
    bound_batches(rows.sparkSession)
    schema = T.StructType([rows.schema[name] for name in keep] + outputs)
    kinds = [to_arrow_type(field.dataType) for field in outputs]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for piece in slices(batch, "_text"):
                work = work or make()
                made = work(piece.column("_text").to_pylist())
                columns = [piece.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(values, kind) for values, kind in zip(made, kinds)], names=names)

    picked = rows.select(*[rows[name].alias(f"_{i}") for i, name in enumerate(keep)],
                         rows[text].cast("string").alias("_text"))
    return picked.mapInArrow(run, schema)


def filter_texts(rows: DataFrame, make: Callable[[], Work], text: str = "text") -> DataFrame:
    """The rows whose text the work of a task keeps, with all their columns."""
    bound_batches(rows.sparkSession)
    names = rows.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])
            for piece in slices(batch, f"c{at}"):
                work = work or make()
                kept = work(piece.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    piece.filter(pa.array(kept, pa.bool_())).columns, names=names)

    return rows.mapInArrow(run, rows.schema)


def once_per_worker(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, made once per Python worker and key, for helpers with tables that take long
    to build and memos worth keeping from task to task.

    The package travels with the job and is built anew in every task, so its own globals don't last;
    this module of one dictionary does. Whatever is kept must bound its own size.
    """
    name = "_kept_by_worker"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def shared_path(rows: DataFrame, kind: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(rows.sparkSession)}/{kind}-{uuid.uuid4().hex}"


def written(rows: DataFrame, kind: str = "table", rows_held: int | None = None) -> DataFrame:
    """Rows as a Parquet table in the shared folder, for results that are read more than once.

    Lineage ends at files that every executor can read, so a lost executor costs one task. Rows of megabytes need
    `rows_held`, as many as a task may hold: else Parquet looks at their size after a hundred, and a reader takes thousands at once.
    """
    path = shared_path(rows, kind)
    writer = rows.write.option("compression", "zstd")
    if rows_held:
        writer = writer.option("parquet.block.row.count.limit", rows_held)
    writer.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
