"""Keyed changes to tables: upsert, append if absent, update, delete.

Parquet has no MERGE, so each operator joins and returns the new table. A `change` column
says what happened to each row (kept, updated, inserted); `settled` drops it and
`change_report` counts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripweave.operators.keyed import (
    first_per_key, is_small, last_change, settle, stored, unknown_keys, with_new_ids)

CHANGE = "change"


def _prefixed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))


def apply_updates(target: DataFrame, changes: DataFrame, keys: list[str],
                  set_columns: dict[str, Column | str], small: bool) -> DataFrame:
    """Target rows with the listed columns taken from their change row, if they have one.

    set_columns maps a target column to a change column name or to an expression for
    touched rows. A NULL in the change overwrites. Keys must be unique in the changes; with
    few of them they are broadcast and the target is not shuffled.
    """
    used = sorted({c for c in set_columns.values() if isinstance(c, str)})
    new = _prefixed(changes, keys, used)
    joined = target.join(F.broadcast(new) if small else new, keys, "left")
    hit = F.col("_hit").isNotNull()
    columns = []
    for name in target.columns:
        if name in set_columns:
            source = set_columns[name]
            value = F.col(f"_new_{source}") if isinstance(source, str) else source
            value = value.cast(target.schema[name].dataType)
            columns.append(F.when(hit, value).otherwise(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return joined.select(*columns, F.when(hit, "updated").otherwise("kept").alias(CHANGE))


def _as_target(rows: DataFrame, target: DataFrame, values: dict[str, Column | str]) -> DataFrame:
    """Rows in the target's layout; columns with no value are NULL."""
    columns = []
    for field in target.schema.fields:
        source = values.get(field.name, field.name if field.name in rows.columns else F.lit(None))
        value = F.col(source) if isinstance(source, str) else source
        columns.append(value.cast(field.dataType).alias(field.name))
    return rows.select(*columns, F.lit("inserted").alias(CHANGE))


def _merged(target: DataFrame, latest: DataFrame, keys: list[str], set_columns: dict[str, Column | str],
            small: bool) -> tuple[DataFrame, DataFrame]:
    """The target with its updates, stored, and the changes that met no row of it.

    The target is read once: which keys were met, and which id is the highest, come from the
    columns of the stored result.
    """
    known = stored(apply_updates(target, latest, keys, set_columns, small), "merged")
    met = known.filter(F.col(CHANGE) == "updated").select(*keys)
    return known, latest.join(F.broadcast(met) if small else met, keys, "left_anti").select(*latest.columns)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], seq: str,
           set_columns: dict[str, Column | str], insert_values: dict[str, Column | str],
           id_col: str | None = None, whole_table: DataFrame | None = None, highest: int | None = None) -> DataFrame:
    """Insert new keys, update the listed columns of known ones.

    The last change per key (highest seq) wins; it is found once and stored. Columns that are not in set_columns keep
    their stored value; insert_values gives the columns of new rows that the changes do
    not carry. New ids follow the highest stored one: `highest`, if the table keeps it; else it is
    looked up in whole_table when the target is only the touched part of a table. A target that
    holds a key more than once has all of its rows updated.
    """
    latest = settle(last_change(changes, keys, seq))
    known, fresh = _merged(target, latest, keys, set_columns, is_small(latest))
    if id_col:
        fresh = with_new_ids(fresh, known if whole_table is None else whole_table, id_col, keys, highest)
    return known.unionByName(_as_target(fresh, target, insert_values))


def append_absent(target: DataFrame, rows: DataFrame, keys: list[str], seq: str,
                  insert_values: dict[str, Column | str] | None = None,
                  id_col: str | None = None) -> DataFrame:
    """Append rows whose key is new; stored rows stay untouched. The first row of a key wins."""
    first = settle(first_per_key(rows, keys, [F.col(seq).asc()]))
    fresh = unknown_keys(first, target, keys)
    if id_col:
        fresh = with_new_ids(fresh, target, id_col, keys)
    kept = target.withColumn(CHANGE, F.lit("kept"))
    return kept.unionByName(_as_target(fresh, target, insert_values or {}))


def update_rows(target: DataFrame, changes: DataFrame, key: str, seq: str,
                set_columns: dict[str, Column | str]) -> tuple[DataFrame, DataFrame]:
    """Change rows by id. Returns the new table and the changes whose id is not stored."""
    latest = settle(last_change(changes, [key], seq))
    return _merged(target, latest, [key], set_columns, is_small(latest))


def delete_rows(target: DataFrame, doomed: DataFrame, key: str,
                small: bool | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hard delete by id. Returns the new table, the removed rows and the unknown ids."""
    ids = settle(doomed.select(key).distinct())
    small = is_small(ids) if small is None else small
    side = F.broadcast(ids) if small else ids
    remaining = target.join(side, key, "left_anti").select(*target.columns)
    removed = target.join(side, key, "left_semi").select(*target.columns)
    return remaining, removed, unknown_keys(ids, target, [key], small)


def delete_children(children: DataFrame, removed_parents: DataFrame, key: str,
                    small: bool = False) -> DataFrame:
    """Rows left after their parents are gone. `small` says the parents' number was checked."""
    gone = removed_parents.select(key)
    return children.join(F.broadcast(gone) if small else gone, key, "left_anti").select(*children.columns)


def settled(rows: DataFrame) -> DataFrame:
    return rows.drop(CHANGE)


def change_report(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(CHANGE) != "kept").groupBy(CHANGE).agg(F.count("*").alias("rows"))
