"""The driver tables seen as travel tables, once as DataFrames and once as SQL.

trip = customer, snapshot = event, activity = part, itinerary item = order,
activity document = document. `SQL` holds the same mapping as named subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave import schemas
from tripweave.functions.times import hours, truncated_hour
from tripweave.sources.tables import read_table

PREFERRED = ("PROMO", "SMALL", "LARGE")
RUN_TIME = "2024-02-01 00:00:00"


def run_time():
    return F.to_timestamp_ntz(F.lit(RUN_TIME))


def portable(rows: DataFrame, doubles: tuple[str, ...] = ()) -> DataFrame:
    """Columns in types that both engines print alike: zone-free timestamps, and doubles
    for numbers that may be missing."""
    changed = {name: F.col(name).cast("double") for name in doubles}
    for name, kind in rows.dtypes:
        if kind == "timestamp":
            changed[name] = F.col(name).cast("timestamp_ntz")
        elif kind.startswith("decimal"):
            changed[name] = F.col(name).cast("double")
    return rows.withColumns(changed) if changed else rows


class Tables:
    """Driver tables of one folder and the travel tables made of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def snapshots(self) -> DataFrame:
        measured = F.col("event_type") != "error"
        reading = F.when(measured, F.get_json_object("props", "$.k").cast("int"))
        return self.raw("events").select(
            F.col("event_id").alias("weather_snapshot_id"), F.col("user_id").alias("trip_id"),
            truncated_hour(F.col("ts")).alias("forecast_time"),
            F.when(measured, F.col("value")).alias("temperature_c"),
            reading.alias("precipitation_probability"), reading.alias("weather_code"),
            F.col("event_type").alias("source"))

    def trips(self) -> DataFrame:
        start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int"))
        nations = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return self.raw("customer").join(F.broadcast(nations), "c_nationkey").select(
            F.col("c_custkey").alias("trip_id"), F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("name"), F.col("n_name").alias("destination_name"),
            (F.col("c_custkey") % 180 - 90).cast("double").alias("latitude"),
            (F.col("c_custkey") % 360 - 180).cast("double").alias("longitude"),
            start.alias("start_date"), F.date_add(start, 2).alias("end_date"))

    def activities(self) -> DataFrame:
        nations = self.raw("nation").select(F.col("n_nationkey").alias("_nation"), "n_name")
        return self.raw("part").withColumn("_nation", (F.col("p_partkey") % 25).cast("int")).join(
            F.broadcast(nations), "_nation").select(
            F.col("p_partkey").alias("activity_id"), F.lower("n_name").alias("destination_name"),
            F.col("p_name").alias("name"), F.col("p_type").alias("category"),
            (F.col("p_size") % 2 == 0).alias("indoor"), F.col("p_brand").alias("description"))

    def items(self) -> DataFrame:
        part = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.min("l_partkey").alias("activity_id"))
        status = F.when(F.col("o_orderstatus") == "O", "planned").when(
            F.col("o_orderstatus") == "P", "completed").otherwise("cancelled")
        return self.raw("orders").join(part, "o_orderkey").select(
            F.col("o_orderkey").alias("itinerary_item_id"), F.col("o_custkey").alias("trip_id"),
            "activity_id", (F.col("o_orderdate") + hours(10)).alias("scheduled_at"),
            F.lit(120).alias("duration_minutes"), F.col("o_orderpriority").alias("rationale"),
            status.alias("status"))

    def packing(self) -> DataFrame:
        listed = F.array(*[F.struct(F.lit(n).alias("item_no"), F.lit(item).alias("item_name"))
                           for n, (item, _) in enumerate(schemas.PACKING_CATALOGUE, 1)])
        return self.raw("customer").select(
            F.col("c_custkey").alias("trip_id"), F.inline(listed)
        ).select(
            (F.col("trip_id") * 5 + F.col("item_no")).alias("packing_item_id"), "trip_id", "item_name",
            F.lit("stored").alias("reason"),
            ((F.col("trip_id") + F.col("item_no")) % 3 == 0).alias("packed"), "item_no")

    def documents(self) -> DataFrame:
        """Documents of activities; the label stands for the vector that some have."""
        labels = self.raw("labels").select("doc_id", F.col("quality").alias("embedding"))
        return self.raw("documents").join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("activity_id"), F.col("text").alias("document_text"), "embedding")


CATALOGUE_VALUES = ", ".join(
    f"({n}, '{item}', '{why}')" for n, (item, why) in enumerate(schemas.PACKING_CATALOGUE, 1))

SQL = {
    "snapshots": """
        SELECT event_id AS weather_snapshot_id, user_id AS trip_id,
               date_trunc('hour', ts) AS forecast_time,
               CASE WHEN event_type <> 'error' THEN value END AS temperature_c,
               CASE WHEN event_type <> 'error'
                    THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) END
                    AS precipitation_probability,
               CASE WHEN event_type <> 'error'
                    THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) END
                    AS weather_code,
               event_type AS source
        FROM events""",
    "trips": """
        SELECT c_custkey AS trip_id, c_custkey AS user_id, c_name AS name,
               n_name AS destination_name,
               CAST(c_custkey % 180 - 90 AS DOUBLE) AS latitude,
               CAST(c_custkey % 360 - 180 AS DOUBLE) AS longitude,
               DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS start_date,
               DATE '2024-01-01' + CAST(c_custkey % 28 + 2 AS INTEGER) AS end_date
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "activities": """
        SELECT p_partkey AS activity_id, lower(n_name) AS destination_name, p_name AS name,
               p_type AS category, p_size % 2 = 0 AS indoor, p_brand AS description
        FROM part JOIN nation ON n_nationkey = p_partkey % 25""",
    "items": """
        SELECT o_orderkey AS itinerary_item_id, o_custkey AS trip_id, activity_id,
               o_orderdate + INTERVAL 10 HOUR AS scheduled_at, 120 AS duration_minutes,
               o_orderpriority AS rationale,
               CASE o_orderstatus WHEN 'O' THEN 'planned' WHEN 'P' THEN 'completed'
                    ELSE 'cancelled' END AS status
        FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS activity_id
                          FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "catalogue": f"SELECT * FROM (VALUES {CATALOGUE_VALUES}) v(item_no, item_name, reason)",
    "packing": f"""
        SELECT c_custkey * 5 + item_no AS packing_item_id, c_custkey AS trip_id, item_name,
               'stored' AS reason, (c_custkey + item_no) % 3 = 0 AS packed, item_no
        FROM customer, (VALUES {CATALOGUE_VALUES}) v(item_no, item_name, why)""",
    "docs": """
        SELECT d.doc_id AS activity_id, text AS document_text, quality AS embedding
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
}


def with_tables(names: str, query: str) -> str:
    """The query with the named mapping subqueries in front."""
    parts = ", ".join(f"{name} AS ({SQL[name]})" for name in names.split())
    return f"WITH {parts} {query}"
