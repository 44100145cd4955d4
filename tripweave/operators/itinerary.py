"""Itinerary: rank activities into slots for all trips, add items by request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripweave import schemas
from tripweave.functions.labels import preference_order
from tripweave.functions.times import SLOT_HOURS, at_hour, hours, iso_time, slot_time
from tripweave.operators.keyed import first_per_key, running_index, top_per_key, with_new_ids

SLOTS_PER_TRIP = 6
GAP_HOURS = 3
ITEM_COLUMNS = ["trip_id", "activity_id", "scheduled_at", "duration_minutes", "rationale", "status"]


def active_pairs(items: DataFrame) -> DataFrame:
    """Distinct (trip, activity) pairs that are not cancelled. Reduced per task first, as
    the same activity may be on a trip many times."""
    return items.filter(F.col("status") != "cancelled").select("trip_id", "activity_id").distinct()


def ranked_activities(activities: DataFrame, slots: int = SLOTS_PER_TRIP,
                      preferred: tuple[str, ...] = schemas.PREFERRED_CATEGORIES) -> DataFrame:
    """The first activities of each destination: outdoor first, then preferred categories.

    The order does not depend on the trip, so it is found once per destination and only
    `slots` rows per destination meet the trips.
    """
    keyed = activities.select(
        F.lower("destination_name").alias("_place"), "activity_id", "indoor", "category")
    order = [*preference_order(F.col("indoor"), F.col("category"), preferred), F.col("activity_id").asc()]
    return top_per_key(keyed, ["_place"], order, slots)


def generate(trips: DataFrame, activities: DataFrame, items: DataFrame,
             preferred: tuple[str, ...] = schemas.PREFERRED_CATEGORIES,
             slots: int = SLOTS_PER_TRIP, slot_hours: tuple[int, ...] = SLOT_HOURS) -> DataFrame:
    """New planned items of every trip. Activities that are already on the trip are taken
    out after the slots are given, so their slots stay empty."""
    best = ranked_activities(activities, slots, preferred)
    placed = trips.select("trip_id", "start_date", F.lower("destination_name").alias("_place")).join(
        best, "_place")
    return placed.join(active_pairs(items), ["trip_id", "activity_id"], "left_anti").select(
        "trip_id", "activity_id",
        slot_time(F.col("start_date"), F.col("rn"), slot_hours).alias("scheduled_at"),
        F.lit(schemas.DEFAULT_DURATION_MINUTES).alias("duration_minutes"),
        F.when(F.col("indoor"), schemas.INDOOR_RATIONALE).otherwise(
            schemas.OUTDOOR_RATIONALE).alias("rationale"),
        F.lit("planned").alias("status"),
    )


def add_auto(requests: DataFrame, trips: DataFrame, activities: DataFrame, items: DataFrame,
             request_id: str = "request_id",
             rationale: str = schemas.DISCOVERY_RATIONALE) -> DataFrame:
    """Items for requests without a time. The activity has to be at the trip's destination
    and not be on the trip already. The first one goes three hours after the trip's last
    item (cancelled ones count), or at 10:00 of the first day; each further one of the same
    batch three hours later."""
    first = first_per_key(
        requests.select(request_id, "trip_id", "activity_id"), ["trip_id", "activity_id"],
        [F.col(request_id).asc()])
    place = trips.select("trip_id", "start_date", F.lower("destination_name").alias("_trip_place"))
    offer = activities.select("activity_id", F.lower("destination_name").alias("_place"))
    fitting = (
        first.join(place, "trip_id").join(offer, "activity_id")
        .filter(F.col("_trip_place") == F.col("_place"))
        .join(active_pairs(items), ["trip_id", "activity_id"], "left_anti")
        .select(request_id, "trip_id", "activity_id", "start_date")
    )
    last = items.groupBy("trip_id").agg(F.max("scheduled_at").alias("_last"))
    start = F.coalesce(F.col("_last") + hours(GAP_HOURS), at_hour(F.col("start_date"), SLOT_HOURS[0]))
    return running_index(fitting, ["trip_id"], request_id, "_n").join(last, "trip_id", "left").select(
        request_id, "trip_id", "activity_id",
        (start + hours(((F.col("_n") - 1) * GAP_HOURS).cast("int"))).alias("scheduled_at"),
        F.lit(schemas.DEFAULT_DURATION_MINUTES).alias("duration_minutes"),
        F.lit(rationale).alias("rationale"), F.lit("planned").alias("status"),
    )


def not_added(requests: DataFrame, added: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Requests that gave no item."""
    return requests.join(added.select(request_id), request_id, "left_anti").select(
        request_id, F.lit(schemas.NOT_ADDED).alias("reject_reason"))


def add_checked(requests: DataFrame, trips: DataFrame, activities: DataFrame,
                request_id: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Items for requests with their own time (ISO text) and duration. Repeated activities
    and other destinations are allowed. Rejects carry the first rule that failed."""
    known_trips = trips.select("trip_id", F.lit(True).alias("_trip"))
    known_activities = activities.select("activity_id", F.lit(True).alias("_activity"))
    duration = F.coalesce(F.col("duration_minutes"), F.lit(schemas.DEFAULT_DURATION_MINUTES))
    checked = (
        requests.withColumns({"_time": iso_time(F.col("scheduled_at")), "duration_minutes": duration})
        .join(known_trips, "trip_id", "left").join(known_activities, "activity_id", "left")
        .withColumn(
            "reject_reason",
            F.when(F.col("_time").isNull(), schemas.INVALID_TIME)
            .when(~F.col("duration_minutes").between(1, schemas.MAX_DURATION_MINUTES),
                  schemas.INVALID_DURATION)
            .when(F.col("_trip").isNull(), schemas.UNKNOWN_TRIP)
            .when(F.col("_activity").isNull(), schemas.UNKNOWN_ACTIVITY))
    )
    rationale = F.coalesce(F.col("rationale"), F.lit(schemas.AGENT_RATIONALE)) \
        if "rationale" in requests.columns else F.lit(schemas.AGENT_RATIONALE)
    added = checked.filter(F.col("reject_reason").isNull()).select(
        request_id, "trip_id", "activity_id", F.col("_time").alias("scheduled_at"),
        "duration_minutes", rationale.alias("rationale"), F.lit("planned").alias("status"))
    rejects = checked.filter(F.col("reject_reason").isNotNull()).select(request_id, "reject_reason")
    return added, rejects


def append_items(items: DataFrame, new: DataFrame, natural_key: list[str], now: Column) -> DataFrame:
    """The itinerary table with the new items, which get ids above the stored ones."""
    numbered = with_new_ids(new, items, "itinerary_item_id", natural_key).withColumn("created_at", now)
    same_layout = numbered.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in items.schema.fields])
    return items.unionByName(same_layout)
