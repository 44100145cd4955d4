"""Per-key building blocks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tripweave import schemas
from tripweave.session import ensure_checkpoint_dir

BROADCAST_BYTES = 64 * 1024 * 1024


def _width(field: T.StructField) -> Column:
    """Bytes of a value, roughly: the length of texts and arrays, a flat size for the rest."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 8
    return F.lit(16)


def is_small(rows: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether all rows together are small enough to broadcast. One distributed sum; columns
    of fixed size are not read for it."""
    width = reduce(lambda a, b: a + b, [_width(f) for f in rows.schema.fields])
    return (rows.agg(F.sum(width.cast("bigint"))).first()[0] or 0) <= max_bytes


def settle(rows: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder, for results that are read more than once."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def stored(rows: DataFrame, kind: str = "rows") -> DataFrame:
    """Rows as a Parquet table in the shared folder, for results of which later steps read a few columns."""
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def top_per_key(rows: DataFrame, keys: list, order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each key with their rank.

    The constant cut lets Spark drop all but k rows per key in every task before the
    shuffle, so a hot key sends k rows per task, not all of its rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_key(rows: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order. For narrow rows."""
    return top_per_key(rows, keys, order, 1, "_rn").drop("_rn")


def first_per_text(rows: DataFrame, text: Column, row_id: str) -> DataFrame:
    """One row per distinct text, the one with the lowest id. For wide rows.

    The first pass reads the text but shuffles only its digest and an id, already reduced per
    task. Digests seen more than once are few; the second pass takes out the rows that have
    one and are not its lowest id, so rows stay where they lie while those digests are small
    enough to broadcast. Rows without a text form one group.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.concat(F.lit("v"), text), F.lit("")), 256)).alias("_digest")
    repeated = settle(rows.groupBy(digest).agg(F.min(row_id).alias("_first"), F.count("*").alias("_n")).filter(
        "_n > 1").select("_digest", "_first"))
    side = F.broadcast(repeated) if is_small(repeated) else repeated
    known = rows.withColumn("_digest", F.unhex(F.sha2(F.coalesce(F.concat(F.lit("v"), text), F.lit("")), 256)))
    return known.join(side, "_digest", "left").filter(
        F.col("_first").isNull() | (F.col("_first") == F.col(row_id))).select(*rows.columns)


def last_change(changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The change that wins per key: the one with the highest sequence number."""
    return first_per_key(changes, keys, [F.col(seq).desc()])


def unknown_keys(changes: DataFrame, target: DataFrame, keys: list[str],
                 small: bool | None = None) -> DataFrame:
    """Change rows whose key is not in the target.

    With few changes the target is only filtered by a broadcast key set, then the few keys
    found are taken away; with many changes it is an ordinary anti join.
    """
    wanted = changes.select(*keys).distinct()
    if is_small(wanted) if small is None else small:
        found = target.select(*keys).join(F.broadcast(wanted), keys, "left_semi").distinct()
    else:
        found = target.select(*keys)
    return changes.join(found, keys, "left_anti").select(*changes.columns)


def _numbered(rows: DataFrame, keys: list, order: list[Column], index: str) -> DataFrame:
    """Position (1-based) of each row among the rows of its keys, or among all.

    Rows are dealt by ranges of (keys, order), stored, counted per part, and numbered inside
    their part; the counts of the parts before are added. No task sees more than a part,
    whatever the size of a key or the spread of its values.
    """
    ordered = [*[F.col(k) for k in keys], *order]
    dealt = settle(rows.repartitionByRange(*ordered).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    if keys:
        ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    else:  # one number per part
        sizes = sorted(tuple(r) for r in counts.collect())
        before = [0, *accumulate(n for _, n in sizes)]
        offsets = rows.sparkSession.createDataFrame(
            [(part, n) for (part, _), n in zip(sizes, before)], "_part int, _before bigint")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    side = F.broadcast(offsets) if is_small(offsets) else offsets
    return (dealt.withColumn("_inside", F.row_number().over(inside)).join(side, [*keys, "_part"])
            .withColumn(index, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_part", "_before", "_inside"))


def with_new_ids(rows: DataFrame, existing: DataFrame, id_col: str, natural_key: list[str],
                 highest: int | None = None) -> DataFrame:
    """Ids above the highest existing one, the same in every run of the same input. A stored
    `highest` saves looking for it.

    Rows are numbered in order of their natural key. Rows with equal natural keys are not
    told apart: the key has to include a request id where such rows are allowed.
    """
    if highest is None:
        highest = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return _numbered(rows, [], [F.col(k) for k in natural_key], "_number").withColumn(
        id_col, F.lit(highest) + F.col("_number")).drop("_number")


def running_index(rows: DataFrame, keys: list[str], order: str, index: str) -> DataFrame:
    """Position (1-based) of each row among the rows of its keys, in order of a column."""
    return _numbered(rows, keys, [F.col(order)], index)


def integer_columns(requests: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests with the columns as whole numbers, and rejects naming the first that is none."""
    parsed = {c: F.col(c).try_cast("bigint") for c in columns}
    reason = F.coalesce(*[
        F.when(number.isNull(), F.lit(schemas.NOT_A_NUMBER % c)) for c, number in parsed.items()])
    checked = requests.withColumn("reject_reason", reason)
    valid = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid.withColumns(parsed), checked.filter(F.col("reject_reason").isNotNull())


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), parts)
