"""Read models: itinerary, activities, packing, dashboard, JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave.operators import views
from tripweave.plans.mapping import Tables, portable, with_tables
from tripweave.sources.export import rows_to_json


def itinerary_active(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return views.itinerary(t.items(), t.activities(), active_only=True)


def itinerary_all(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return views.itinerary(t.items(), t.activities(), active_only=False)


def activity_flags(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return views.activities_with_flag(t.activities(), t.documents())


def packing_view(spark: SparkSession, folder: str) -> DataFrame:
    return views.packing_list(Tables(spark, folder).packing().drop("item_no"))


def packing_progress(spark: SparkSession, folder: str) -> DataFrame:
    return views.packing_progress(Tables(spark, folder).packing())


def dashboard_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    summary = views.dashboard_summary(
        t.trips(), t.snapshots(), t.items(), t.activities(), t.documents(), t.packing())
    return portable(summary, ("max_rain_probability",))


def dashboard_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The trip the dashboard opens with: whole row, lowest id."""
    t = Tables(spark, folder)
    return views.dashboard(t.trips(), t.snapshots(), t.items(), t.activities(),
                           t.documents(), t.packing())["current"]


def rows_json(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as JSON rows, read back so that values and not number formats are compared."""
    rows = Tables(spark, folder).raw("orders").withColumn(
        "o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    fields = "o_orderkey bigint, o_totalprice double, o_orderdate string, o_orderstatus string"
    return rows_to_json(rows).select(F.from_json("json", fields).alias("r")).select("r.*")


QUERIES = {f.__name__: f for f in (
    itinerary_active, itinerary_all, activity_flags, packing_view, packing_progress,
    dashboard_summary, dashboard_trip, rows_json)}

_ITINERARY = """
    SELECT i.trip_id, i.itinerary_item_id, i.scheduled_at, i.duration_minutes, i.rationale, i.status,
           a.activity_id, a.name AS activity_name, a.category, a.indoor
    FROM items i JOIN activities a ON a.activity_id = i.activity_id"""

ORACLE = {
    "itinerary_active": with_tables(
        "items activities", _ITINERARY + " WHERE i.status <> 'cancelled' ORDER BY 1, 3, 2"),
    "itinerary_all": with_tables("items activities", _ITINERARY + " ORDER BY 1, 3, 2"),
    "activity_flags": with_tables("activities docs", """
        SELECT a.*, d.embedding IS NOT NULL AS embedded
        FROM activities a LEFT JOIN docs d ON d.activity_id = a.activity_id"""),
    "packing_view": with_tables("packing", """
        SELECT packing_item_id, trip_id, item_name, reason, packed FROM packing
        ORDER BY trip_id, packed, item_name"""),
    "packing_progress": with_tables("packing", """
        SELECT trip_id, count(*) AS items, count(*) FILTER (WHERE packed) AS packed_items,
               CAST(round_even(100.0 * count(*) FILTER (WHERE packed) / count(*), 0) AS INTEGER)
                   AS packing_progress
        FROM packing GROUP BY trip_id"""),
    "dashboard_summary": with_tables("trips snapshots items activities docs packing", """,
        w AS (SELECT trip_id, count(*) AS n, min(temperature_c) AS low, max(temperature_c) AS high,
                     max(coalesce(precipitation_probability, 0)) AS rain FROM snapshots GROUP BY 1),
        a AS (SELECT lower(v.destination_name) AS place,
                     count(*) FILTER (WHERE d.embedding IS NOT NULL) AS embedded,
                     count(*) FILTER (WHERE v.indoor) AS indoor
              FROM activities v LEFT JOIN docs d ON d.activity_id = v.activity_id GROUP BY 1),
        i AS (SELECT trip_id, count(*) AS n FROM items JOIN activities USING (activity_id)
              WHERE status <> 'cancelled' GROUP BY 1),
        p AS (SELECT trip_id, CAST(round_even(100.0 * count(*) FILTER (WHERE packed) / count(*), 0)
                                   AS INTEGER) AS progress
              FROM packing GROUP BY 1)
        SELECT t.trip_id, coalesce(w.n, 0) AS forecast_hours, w.low AS min_temperature_c,
               w.high AS max_temperature_c, CAST(w.rain AS DOUBLE) AS max_rain_probability,
               coalesce(a.embedded, 0) AS embedded_activities, coalesce(a.indoor, 0) AS indoor_activities,
               coalesce(i.n, 0) AS planned_items, coalesce(p.progress, 0) AS packing_progress
        FROM trips t LEFT JOIN w ON w.trip_id = t.trip_id
        LEFT JOIN a ON a.place = lower(t.destination_name)
        LEFT JOIN i ON i.trip_id = t.trip_id LEFT JOIN p ON p.trip_id = t.trip_id"""),
    "dashboard_trip": with_tables("trips", "SELECT * FROM trips ORDER BY trip_id LIMIT 1"),
    "rows_json": """
        SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS o_totalprice,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderstatus
        FROM orders""",
}
