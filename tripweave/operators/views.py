"""Read models: itinerary, activities, weather, packing and the dashboard, for all trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripweave.functions.numbers import percent_half_even
from tripweave.operators.keyed import top_per_key

PREVIEW_ROWS = 6


def first_trips(trips: DataFrame) -> DataFrame:
    """The lowest trip id of each destination, letter case ignored."""
    return trips.groupBy(F.lower("destination_name").alias("place")).agg(F.min("trip_id").alias("trip_id"))


def itinerary(items: DataFrame, activities: DataFrame, active_only: bool) -> DataFrame:
    """Items with their activity; the dashboard leaves cancelled ones out."""
    chosen = items.filter(F.col("status") != "cancelled") if active_only else items
    about = activities.select("activity_id", F.col("name").alias("activity_name"), "category", "indoor")
    return chosen.join(about, "activity_id").select(
        "trip_id", "itinerary_item_id", "scheduled_at", "duration_minutes", "rationale", "status",
        "activity_id", "activity_name", "category", "indoor",
    ).orderBy("trip_id", "scheduled_at", "itinerary_item_id")


def _embedded(documents: DataFrame) -> DataFrame:
    return documents.select("activity_id", F.col("embedding").isNotNull().alias("_embedded"))


def activities_with_flag(activities: DataFrame, documents: DataFrame) -> DataFrame:
    """All activities and whether their document has a vector; none without a document."""
    return activities.join(_embedded(documents), "activity_id", "left").select(
        *activities.columns, F.coalesce("_embedded", F.lit(False)).alias("embedded"))


def weather_range(snapshots: DataFrame) -> DataFrame:
    """Highest rain and lowest temperature per trip: once over known values only, once with
    missing rain as 0."""
    return snapshots.groupBy("trip_id").agg(
        F.max("precipitation_probability").alias("max_rain"),
        F.min("temperature_c").alias("min_temperature"),
        F.max(F.coalesce("precipitation_probability", F.lit(0))).alias("max_rain_or_zero"),
    )


def weather_preview(snapshots: DataFrame, tie: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first forecast rows of each trip by time."""
    return top_per_key(
        snapshots, ["trip_id"], [F.col("forecast_time").asc(), F.col(tie).asc()], rows, "preview_no")


def packing_list(packing: DataFrame) -> DataFrame:
    """Unpacked items first, then by name."""
    return packing.orderBy("trip_id", "packed", "item_name")


def packing_progress(packing: DataFrame) -> DataFrame:
    return packing.groupBy("trip_id").agg(
        F.count("*").alias("items"), F.count_if("packed").alias("packed_items"),
    ).withColumn("packing_progress", percent_half_even(F.col("packed_items"), F.col("items")))


def dashboard_summary(trips: DataFrame, snapshots: DataFrame, items: DataFrame,
                      activities: DataFrame, documents: DataFrame, packing: DataFrame) -> DataFrame:
    """Eight measures per trip. Each source is reduced to one row per key before it meets
    the trips, so hot trips and destinations add no rows to a join."""
    weather = snapshots.groupBy("trip_id").agg(
        F.count("*").alias("_hours"),
        F.min("temperature_c").alias("min_temperature_c"),
        F.max("temperature_c").alias("max_temperature_c"),
        F.max(F.coalesce("precipitation_probability", F.lit(0))).alias("max_rain_probability"),
    )
    offers = activities.select("activity_id", "indoor", F.lower("destination_name").alias("_place")).join(
        _embedded(documents), "activity_id", "left"
    ).groupBy("_place").agg(
        F.count_if(F.coalesce("_embedded", F.lit(False))).alias("_embedded"),
        F.count_if("indoor").alias("_indoor"))
    planned = items.filter(F.col("status") != "cancelled").groupBy("activity_id", "trip_id").agg(
        F.count("*").alias("_n")
    ).join(activities.select("activity_id"), "activity_id").groupBy("trip_id").agg(
        F.sum("_n").alias("_planned"))
    packed = packing_progress(packing).select("trip_id", F.col("packing_progress").alias("_progress"))

    def or_zero(name: str, alias: str):
        return F.coalesce(F.col(name), F.lit(0)).alias(alias)

    return (
        trips.select("trip_id", F.lower("destination_name").alias("_place"))
        .join(offers, "_place", "left")
        .join(weather, "trip_id", "left").join(planned, "trip_id", "left").join(packed, "trip_id", "left")
        .select(
            "trip_id", or_zero("_hours", "forecast_hours"),
            "min_temperature_c", "max_temperature_c", "max_rain_probability",
            or_zero("_embedded", "embedded_activities"), or_zero("_indoor", "indoor_activities"),
            or_zero("_planned", "planned_items"), or_zero("_progress", "packing_progress"))
    )


def dashboard(trips: DataFrame, snapshots: DataFrame, items: DataFrame, activities: DataFrame,
              documents: DataFrame, packing: DataFrame) -> dict[str, DataFrame]:
    """The parts of the dashboard, each for all trips; `current` is the trip shown first."""
    return {
        "current": trips.orderBy("trip_id").limit(1),
        "trips": trips.select("*"),
        "weather": snapshots.select(
            "trip_id", "forecast_time", "temperature_c", "precipitation_probability",
            "weather_code", "source").orderBy("trip_id", "forecast_time"),
        "itinerary": itinerary(items, activities, active_only=True),
        "activities": activities_with_flag(activities, documents).orderBy("destination_name", "name"),
        "packing": packing_list(packing),
        "summary": dashboard_summary(trips, snapshots, items, activities, documents, packing),
    }
