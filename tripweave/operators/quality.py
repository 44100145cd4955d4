"""Constraints as one report: table, rule, number of bad rows, a sample key."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tripweave import schemas
from tripweave.operators.keyed import union_all


def _key_text(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


def not_null(columns: list[str]) -> dict[str, Column]:
    return {f"not_null({c})": F.col(c).isNull() for c in columns}


def fits_decimal(columns: list[str], precision: int = 5, scale: int = 2) -> dict[str, Column]:
    """Values too large for the NUMERIC column they go to."""
    target = f"decimal({precision},{scale})"
    return {f"numeric({c})": F.col(c).isNotNull() & F.col(c).try_cast(target).isNull() for c in columns}


def vector_size(column: str, dim: int = schemas.EMBEDDING_DIM) -> dict[str, Column]:
    return {f"dimension({column})": F.col(column).isNotNull() & (F.size(column) != dim)}


class Checks(NamedTuple):
    """What is declared of a table: rules of single rows (true where bad) with the key that names a row,
    sets of columns that are unique, and columns with the table and key they refer to."""

    table: str
    rows: DataFrame
    key: str = ""
    bad: dict[str, Column] = {}
    unique: list[list[str]] = []
    foreign: list[tuple[str, str, str]] = []


INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def _entry(place: int, slot: int, rows: DataFrame, keys: list[str], when: Column | None = None) -> Column:
    """A value of a key set, or nothing: whole numbers as such, all else as text."""
    kinds = dict(rows.dtypes)
    number = F.col(keys[0]).cast("bigint") if len(keys) == 1 and kinds[keys[0]] in INTEGERS else None
    text = F.lit(None).cast("string") if number is not None else _key_text(keys)
    present = reduce(and_, [F.col(k).isNotNull() for k in keys]) if when is None else when
    if when is not None and number is None:
        text = F.col(keys[0]).cast("string")
    return F.when(present, F.struct(
        F.lit(place).alias("place"), F.lit(slot).alias("slot"),
        (F.lit(None).cast("bigint") if number is None else number).alias("num"), text.alias("text")))


def report(checks: list[Checks]) -> DataFrame:
    """table_name, rule, bad_rows and sample_key of every declared rule.

    Each table is read once. A row gives one entry for every key set it has a value of, for every
    reference and for every rule it breaks; equal entries are counted in each task and meet in one
    shuffle of all tables. A place is a key set with the references to it: slot 0 counts the
    rows that have the value, which are repeated if there are two; the others count rows that refer to
    it, which are orphans if slot 0 has none. A rule of single rows is a reference to nothing. NULLs are
    neither equal nor orphans. A hot key is one entry of each task.
    """
    rules: list[tuple] = []  # table, rule, place, slot, whether it is a key
    places: dict[tuple, int] = {}
    slots: dict[int, int] = {}
    entries: dict[str, list[Column]] = {c.table: [] for c in checks}
    own = {c.table: c for c in checks}

    def place_of(table: str, keys: list[str]) -> int:
        if (table, *keys) not in places:
            places[(table, *keys)] = place = len(places)
            slots[place] = 0
            entries[table].append(_entry(place, 0, own[table].rows, keys))
        return places[(table, *keys)]

    def referring(place: int) -> int:
        slots[place] += 1
        return slots[place]

    for c in checks:
        for name, rule in c.bad.items():
            place = places[(c.table, "rule", name)] = len(places)
            slots[place] = 0
            entries[c.table].append(_entry(place, referring(place), c.rows, [c.key], F.coalesce(rule, F.lit(False))))
            rules.append((c.table, name, place, 1, False))
        for keys in c.unique:
            rules.append((c.table, f"unique({', '.join(keys)})", place_of(c.table, keys), 0, True))
        for column, parent, parent_key in c.foreign:
            place = place_of(parent, [parent_key])
            slot = referring(place)
            entries[c.table].append(_entry(place, slot, c.rows, [column]))
            rules.append((c.table, f"foreign_key({column})", place, slot, False))

    every = union_all([c.rows.select(F.inline(F.filter(F.array(*entries[c.table]), lambda e: e.isNotNull())))
                       for c in checks if entries[c.table]])
    width = max(slots.values()) + 1
    counted = every.groupBy("place", "num", "text").agg(*[F.count_if(F.col("slot") == n).alias(f"n{n}") for n in range(width)])
    found = counted.select("place", "num", "text", "n0", F.inline(F.array(*[
        F.struct(F.lit(n).alias("slot"), F.col(f"n{n}").alias("n")) for n in range(width)])))
    bad = found.filter(F.when(F.col("slot") == 0, F.col("n") > 1).otherwise((F.col("n") > 0) & (F.col("n0") == 0)))
    sums = bad.groupBy("place", "slot").agg(
        F.sum("n").alias("bad_rows"), F.min("num").alias("low"), F.min(F.col("num").cast("string")).alias("first"),
        F.min("text").alias("text"))
    listed = every.sparkSession.createDataFrame(rules, "table_name string, rule string, place int, slot int, is_key boolean")
    sample = F.coalesce(F.when(F.col("is_key"), F.col("first")).otherwise(F.col("low").cast("string")), "text")
    return listed.join(sums, ["place", "slot"], "left").select(
        "table_name", "rule", F.coalesce("bad_rows", F.lit(0)).alias("bad_rows"), sample.alias("sample_key"))


def travel_report(tables: dict[str, DataFrame], dim: int = schemas.EMBEDDING_DIM) -> DataFrame:
    """All declared constraints of the travel tables."""
    # The constraints of the schema.
    checks = {
        "trips": {"end_date >= start_date": F.col("end_date") < F.col("start_date")},
        "activities": {"max_precipitation_probability in 0..100":
                       ~F.col("max_precipitation_probability").between(0, 100),
                       **fits_decimal(["min_temperature_c"])},
        "weather_snapshots": fits_decimal(["temperature_c"]),
        "itinerary_items": {"duration_minutes > 0": F.col("duration_minutes") <= 0,
                            "status": ~F.col("status").isin(*schemas.STATUSES)},
        "activity_documents": vector_size("embedding", dim),
    }
    uniques = {
        "users": ["email"], "activities": ["destination_name", "name"], "weather_snapshots": ["trip_id", "forecast_time"],
        "packing_items": ["trip_id", "item_name"], "activity_documents": ["activity_id"],
    }
    parents = {
        "trips": ["users"], "weather_snapshots": ["trips"], "itinerary_items": ["trips", "activities"],
        "packing_items": ["trips"], "activity_documents": ["activities"],
    }
    keys = {name: schema.fieldNames()[0] for name, schema in schemas.TABLES.items()}
    return report([Checks(
        name, tables[name], keys[name],
        {**not_null([f.name for f in schema.fields if not f.nullable]), **checks.get(name, {})},
        [[keys[name]], *([uniques[name]] if name in uniques else [])],
        [(keys[parent], parent, keys[parent]) for parent in parents.get(name, [])],
    ) for name, schema in schemas.TABLES.items()])


def load_counts(snapshots: DataFrame, documents: DataFrame, vector: str = "embedding") -> DataFrame:
    """Stored snapshots per trip, next to the number of documents with a vector, which is
    one number for the whole table."""
    embedded = documents.agg(F.count(vector)).scalar()
    return snapshots.groupBy("trip_id").agg(F.count("*").alias("weather_rows")).withColumn(
        "embedded_documents", embedded)


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """One row with the count. Reading it fails when there are no rows."""
    counted = rows.agg(F.count("*").alias("rows"))
    return counted.select(F.when(F.col("rows") > 0, F.col("rows")).otherwise(
        F.raise_error(F.lit(schemas.NOTHING_STORED % what)).cast("bigint")).alias("rows"))
