"""Tables on Parquet: read, create when absent, overwrite, rewrite touched partitions."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tripweave.operators.keyed import settle
from tripweave.session import ensure_checkpoint_dir

FEW_PARTITIONS = 1000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def typed_rows(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A small literal relation with a declared schema."""
    return spark.createDataFrame(rows, schema)


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """Rows with the declared defaults in place of missing columns and missing values."""
    return rows.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value)
        for name, value in defaults.items()})


def new_path(spark: SparkSession, kind: str) -> str:
    """A folder that no table uses yet, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def create_if_absent(spark: SparkSession, path: str, schema: StructType,
                     partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The table at the path; an empty typed one is written first when there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing.getCondition()):
            raise
    overwrite_table(spark.createDataFrame([], schema), path, partition_by)
    return spark.read.schema(schema).parquet(path)


def overwrite_table(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace the table. The rows must not be read from the same path."""
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def touched_partitions(table: DataFrame, changes: DataFrame, partition_by: tuple[str, ...]) -> DataFrame:
    """The part of the table that the changes fall into. A key has to stay in its partition.

    Up to `FEW_PARTITIONS` values are named in a filter, which Spark uses to list only those
    folders; changes to more partitions than that are joined.
    """
    values = changes.select(*partition_by).distinct()
    named = values.limit(FEW_PARTITIONS + 1).collect()
    if len(named) > FEW_PARTITIONS:
        return table.join(values, list(partition_by), "left_semi").select(*table.columns)
    chosen = [reduce(and_, [F.col(c) == F.lit(row[c]) for c in partition_by]) for row in named]
    return table.filter(reduce(or_, chosen) if chosen else F.lit(False))


def overwrite_touched(rows: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Replace only the partitions the rows fall into.

    The rows may come from the same table: they are checkpointed to the shared folder
    first, so no file is read after it has been replaced.
    """
    (settle(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))
