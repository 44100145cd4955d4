"""The travel tables' own changes, on top of the generic merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripweave import schemas
from tripweave.functions.times import iso_time
from tripweave.operators import merge
from tripweave.operators.keyed import is_small


def upsert_weather(snapshots: DataFrame, forecast: DataFrame, seq: str, now: Column,
                   source: str = schemas.WEATHER_SOURCE, whole_table: DataFrame | None = None,
                   highest: int | None = None) -> DataFrame:
    """Forecast rows by (trip, time): measures, source and fetch time are replaced."""
    measures = ["temperature_c", "precipitation_probability", "weather_code"]
    return merge.upsert(
        snapshots, forecast, ["trip_id", "forecast_time"], seq,
        set_columns={**{m: m for m in measures}, "source": F.lit(source), "fetched_at": now},
        insert_values={"source": F.lit(source), "fetched_at": now},
        id_col="weather_snapshot_id", whole_table=whole_table, highest=highest,
    )


def upsert_documents(documents: DataFrame, embedded: DataFrame, seq: str, now: Column,
                     model: str, whole_table: DataFrame | None = None, highest: int | None = None) -> DataFrame:
    """Documents by activity: text, vector and time are replaced, the model name is not."""
    return merge.upsert(
        documents, embedded, ["activity_id"], seq,
        set_columns={"document_text": "document_text", "embedding": "embedding", "updated_at": now},
        insert_values={"embedding_model": F.lit(model), "updated_at": now},
        id_col="document_id", whole_table=whole_table, highest=highest,
    )


def upsert_packing(packing: DataFrame, suggestions: DataFrame, seq: str, now: Column) -> DataFrame:
    """Packing items by (trip, item): only the reason is replaced, so ticks survive a rerun."""
    return merge.upsert(
        packing, suggestions, ["trip_id", "item_name"], seq,
        set_columns={"reason": "reason"},
        insert_values={"packed": F.lit(False), "created_at": now},
        id_col="packing_item_id",
    )


def seed_users(users: DataFrame, rows: DataFrame, seq: str, now: Column) -> DataFrame:
    return merge.append_absent(users, rows, ["email"], seq, {"created_at": now}, "user_id")


def seed_activities(activities: DataFrame, rows: DataFrame, seq: str, now: Column) -> DataFrame:
    limit = F.coalesce(F.col("max_precipitation_probability"), F.lit(100))
    return merge.append_absent(
        activities, rows, ["destination_name", "name"], seq,
        {"created_at": now, "max_precipitation_probability": limit,
         "indoor": F.coalesce(F.col("indoor"), F.lit(False))},
        "activity_id",
    )


def seed_trips(trips: DataFrame, rows: DataFrame, users: DataFrame, seq: str,
               run_date: Column, now: Column) -> DataFrame:
    """Trips of known users, by e-mail, whose name is not taken. The trip starts the day
    after the run date and lasts three days."""
    owned = rows.join(users.select("user_id", "email"), "email")
    return merge.append_absent(
        trips, owned, ["name"], seq,
        {"start_date": F.date_add(run_date, 1), "end_date": F.date_add(run_date, 3),
         "interests": F.coalesce(F.col("interests"), F.array().cast("array<string>")),
         "created_at": now},
        "trip_id",
    )


def move_items(items: DataFrame, requests: DataFrame, key: str, seq: str, raw_time: str,
               reason: str) -> tuple[DataFrame, DataFrame]:
    """Reschedule items: time and rationale change, the status stays.
    Rejects: requests whose time is no ISO time, and unknown items."""
    parsed = requests.withColumn("_time", iso_time(F.col(raw_time)))
    moved, unknown = merge.update_rows(
        items, parsed.filter(F.col("_time").isNotNull()), key, seq,
        {"scheduled_at": "_time", "rationale": reason})
    bad_time = parsed.filter(F.col("_time").isNull()).select(
        key, seq, F.lit(schemas.INVALID_TIME).alias("reject_reason"))
    missing = unknown.select(key, seq, _missing("Itinerary item", key))
    return moved, bad_time.unionByName(missing)


def cancel_items(items: DataFrame, requests: DataFrame, key: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """Soft delete: the row stays with status cancelled."""
    done, unknown = merge.update_rows(items, requests, key, seq, {"status": F.lit("cancelled")})
    return done, unknown.select(key, seq, F.lit(schemas.NO_ITINERARY_ITEM).alias("reject_reason"))


def remove_items(items: DataFrame, requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hard delete. Returns the new table, the removed rows and the requests for unknown items."""
    remaining, removed, unknown = merge.delete_rows(items, requests, key)
    return remaining, removed, unknown.select(key, _missing("Itinerary item", key))


def set_packed(packing: DataFrame, requests: DataFrame, key: str, seq: str,
               packed: str = "packed") -> tuple[DataFrame, DataFrame]:
    """Tick or untick items. The value is a boolean, or JSON text; text that is not the JSON
    value true or false (a quoted word included) and NULL are rejected."""
    value = F.col(packed).cast("string")
    parsed = requests.withColumn("_flag", F.when(value.isin("true", "false"), value == "true"))
    done, unknown = merge.update_rows(
        packing, parsed.filter(F.col("_flag").isNotNull()), key, seq, {"packed": "_flag"})
    invalid = parsed.filter(F.col("_flag").isNull()).select(
        key, seq, F.lit(schemas.INVALID_TICK).alias("reject_reason"))
    missing = unknown.select(key, seq, F.lit(schemas.NO_PACKING_ITEM).alias("reject_reason"))
    return done, invalid.unionByName(missing)


def _missing(what: str, key: str) -> Column:
    return F.format_string(schemas.NO_SUCH_ROW, F.lit(what), F.col(key).cast("string")).alias("reject_reason")


def delete_users(users: DataFrame, trips: DataFrame, trip_children: dict[str, DataFrame],
                 doomed: DataFrame) -> dict[str, DataFrame]:
    """Users with everything that hangs on them: trips, and the trips' own rows."""
    small = is_small(doomed)
    remaining, removed, _ = merge.delete_rows(users, doomed, "user_id", small)
    owners = removed.select("user_id")
    gone_trips = trips.join(F.broadcast(owners) if small else owners, "user_id", "left_semi")
    left = {"users": remaining, "trips": merge.delete_children(trips, owners, "user_id", small)}
    for name, rows in trip_children.items():
        left[name] = merge.delete_children(rows, gone_trips, "trip_id")
    return left


def delete_activities(activities: DataFrame, documents: DataFrame, items: DataFrame,
                      doomed: DataFrame) -> dict[str, DataFrame]:
    """Activities with their documents. One that an itinerary still uses is not deleted."""
    wanted = doomed.select("activity_id").distinct()
    small = is_small(doomed)
    side = F.broadcast(wanted) if small else wanted
    blocked = items.select("activity_id").join(side, "activity_id", "left_semi").distinct()
    free = wanted.join(blocked, "activity_id", "left_anti")
    remaining, removed, _ = merge.delete_rows(activities, free, "activity_id", small)
    return {
        "activities": remaining,
        "documents": merge.delete_children(documents, removed, "activity_id", small),
        "blocked": blocked,
    }
