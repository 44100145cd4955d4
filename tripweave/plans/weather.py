"""Weather: payload rows, Silver table, label summary, per-trip ranges and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave import schemas
from tripweave.operators import silver as silver_ops, views
from tripweave.plans.mapping import RUN_TIME, Tables, portable, run_time, with_tables
from tripweave.sources import payloads

PAYLOAD_ROWS = 24


def _bronze_rows(t: Tables) -> DataFrame:
    """Events as raw forecast rows; sign-ups carry a time text that is no time."""
    measured = F.col("event_type") != "error"
    reading = F.when(measured, F.get_json_object("props", "$.k").cast("int"))
    rows = t.raw("events").select(
        F.col("event_id"),
        F.when(F.col("event_type") == "signup", "not a time").otherwise(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("forecast_time_raw"),
        F.when(measured, F.col("value")).alias("temperature_c"),
        reading.alias("precipitation_probability"), reading.alias("weather_code"))
    return silver_ops.bronze(rows, run_time())


def weather_silver(spark: SparkSession, folder: str) -> DataFrame:
    rows = silver_ops.silver(_bronze_rows(Tables(spark, folder)), F.lit("Lisbon"))
    return portable(rows, ("precipitation_probability", "weather_code"))


def weather_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return silver_ops.unreadable_times(_bronze_rows(Tables(spark, folder))).select(
        "event_id", "forecast_time_raw")


def weather_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = silver_ops.silver(_bronze_rows(Tables(spark, folder)), F.lit("Lisbon"))
    return silver_ops.label_summary(rows)


def _hourly(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events packed into payloads of 24 readings and read back. Every fifth payload has one
    probability too few, every seventh is cut off, every ninth has no weather codes."""
    rows = _bronze_rows(t).withColumn("payload_id", F.floor(F.col("event_id") / PAYLOAD_ROWS))
    packed = rows.groupBy("payload_id").agg(F.sort_array(F.collect_list(F.struct(
        "event_id", "forecast_time_raw", "temperature_c", "precipitation_probability",
        "weather_code"))).alias("r"))
    key, rain = F.col("payload_id"), F.col("r.precipitation_probability")
    short = F.when(key % 5 == 0, F.slice(rain, F.lit(1), F.size(rain) - 1)).otherwise(rain)
    text = F.to_json(F.struct(F.struct(
        F.col("r.forecast_time_raw").alias("time"), F.col("r.temperature_c").alias("temperature_2m"),
        short.alias("precipitation_probability"), F.when(key % 9 != 0, F.col("r.weather_code")).alias("weather_code"),
    ).alias("hourly")))
    landed = packed.select("payload_id", F.when(key % 7 == 0, F.substring(text, 1, 20)).otherwise(text).alias("payload"))
    return payloads.hourly_rows(landed, "payload")


def hourly_explode(spark: SparkSession, folder: str) -> DataFrame:
    return portable(_hourly(Tables(spark, folder))[0], ("precipitation_probability", "weather_code"))


def hourly_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _hourly(Tables(spark, folder))[1]


def _daily(t: Tables) -> tuple[DataFrame, DataFrame]:
    """One daily payload per trip, its days reduced first. Every eleventh payload misses the
    last minimum, every thirteenth did not land; every trip id is also asked for a second time
    as an unknown one."""
    days = t.snapshots().withColumn("day", F.date_format("forecast_time", "yyyy-MM-dd")).groupBy(
        "trip_id", "day").agg(
        F.max("weather_code").alias("code"), F.max("temperature_c").alias("high"),
        F.min("temperature_c").alias("low"), F.max("precipitation_probability").alias("rain"))
    per_trip = days.groupBy("trip_id").agg(
        F.sort_array(F.collect_list(F.struct("day", "code", "high", "low", "rain"))).alias("r"))
    low = F.col("r.low")
    lows = F.when(F.col("trip_id") % 11 == 0, F.slice(low, F.lit(1), F.size(low) - 1)).otherwise(low)
    landed = per_trip.filter(F.col("trip_id") % 13 != 0).select("trip_id", F.to_json(F.struct(F.struct(
        F.col("r.day").alias("time"), F.col("r.code").alias("weather_code"),
        F.col("r.high").alias("temperature_2m_max"), lows.alias("temperature_2m_min"),
        F.col("r.rain").alias("precipitation_probability_max")).alias("daily"))).alias("payload"))
    users = t.raw("events").select("user_id").distinct()
    requests = users.select(F.explode(F.array("user_id", -F.col("user_id") - 1)).alias("trip_id"))
    return payloads.trip_forecast(requests, t.trips(), landed, "payload")


def daily_explode(spark: SparkSession, folder: str) -> DataFrame:
    return portable(_daily(Tables(spark, folder))[0], ("precipitation_probability", "weather_code"))


def daily_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(Tables(spark, folder))[1]


def trip_weather_agg(spark: SparkSession, folder: str) -> DataFrame:
    return portable(views.weather_range(Tables(spark, folder).snapshots()), ("max_rain",))


def weather_preview(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.weather_preview(Tables(spark, folder).snapshots(), "weather_snapshot_id")
    return portable(rows, ("precipitation_probability", "weather_code"))


_LABEL = """CASE WHEN weather_code = 0 THEN 'clear' WHEN weather_code BETWEEN 1 AND 3 THEN 'cloudy'
            WHEN weather_code BETWEEN 51 AND 67 THEN 'rain' ELSE 'other' END"""

QUERIES = {f.__name__: f for f in (
    weather_silver, weather_rejects, weather_summary, hourly_explode, hourly_rejects, daily_explode, daily_rejects,
    trip_weather_agg, weather_preview)}

ORACLE = {
    "weather_silver": with_tables("snapshots", f"""
        SELECT event_id, temperature_c, CAST(precipitation_probability AS DOUBLE) AS precipitation_probability,
               CAST(weather_code AS DOUBLE) AS weather_code, TIMESTAMP '{RUN_TIME}' AS ingested_at,
               CASE WHEN event_type <> 'signup' THEN date_trunc('minute', ts) END AS forecast_time,
               'Lisbon' AS destination_name, {_LABEL} AS weather_label
        FROM events JOIN snapshots ON weather_snapshot_id = event_id"""),
    "weather_rejects": "SELECT event_id, 'not a time' AS forecast_time_raw FROM events WHERE event_type = 'signup'",
    "weather_summary": with_tables("snapshots", f"""
        SELECT {_LABEL} AS weather_label, count(*) AS hours, round(avg(temperature_c), 1) AS avg_temperature_c
        FROM snapshots GROUP BY 1"""),
    "hourly_explode": with_tables("snapshots", """
        SELECT payload_id, forecast_time_raw, temperature_c,
               CAST(precipitation_probability AS DOUBLE) AS precipitation_probability,
               CAST(weather_code AS DOUBLE) AS weather_code
        FROM (SELECT event_id // 24 AS payload_id, temperature_c, precipitation_probability, weather_code,
                     CASE WHEN event_type = 'signup' THEN 'not a time'
                          ELSE strftime(ts, '%Y-%m-%dT%H:%M') END AS forecast_time_raw,
                     row_number() OVER (PARTITION BY event_id // 24 ORDER BY event_id) AS place,
                     count(*) OVER (PARTITION BY event_id // 24) AS n
              FROM events JOIN snapshots ON weather_snapshot_id = event_id)
        WHERE place <= CASE WHEN payload_id % 5 = 0 THEN n - 1 ELSE n END
              AND payload_id % 7 <> 0 AND payload_id % 9 <> 0"""),
    "hourly_rejects": f"""
        SELECT DISTINCT event_id // 24 AS payload_id, '{schemas.INCOMPLETE_HOURLY}' AS reject_reason FROM events
        WHERE (event_id // 24) % 7 = 0 OR (event_id // 24) % 9 = 0""",
    "daily_explode": with_tables("snapshots trips", """
        SELECT s.trip_id, latitude, longitude, start_date, end_date,
               strftime(forecast_time, '%Y-%m-%d') AS date,
               CAST(max(weather_code) AS DOUBLE) AS weather_code,
               max(temperature_c) AS temperature_max_c, min(temperature_c) AS temperature_min_c,
               CAST(max(precipitation_probability) AS DOUBLE) AS precipitation_probability
        FROM snapshots s JOIN trips t ON t.trip_id = s.trip_id
        WHERE s.trip_id % 11 <> 0 AND s.trip_id % 13 <> 0 GROUP BY 1, 2, 3, 4, 5, 6"""),
    "daily_rejects": """
        SELECT -user_id - 1 AS trip_id,
               'Trip ' || CAST(-user_id - 1 AS VARCHAR) || ' does not exist' AS reject_reason
        FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL
        SELECT user_id, CASE WHEN user_id % 13 = 0 THEN 'Trip ' || user_id || ' has no forecast payload'
                             ELSE 'Incomplete daily forecast' END
        FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 11 = 0 OR user_id % 13 = 0""",
    "trip_weather_agg": with_tables("snapshots", """
        SELECT trip_id, CAST(max(precipitation_probability) AS DOUBLE) AS max_rain,
               min(temperature_c) AS min_temperature,
               max(coalesce(precipitation_probability, 0)) AS max_rain_or_zero
        FROM snapshots GROUP BY trip_id"""),
    "weather_preview": with_tables("snapshots", """
        SELECT weather_snapshot_id, trip_id, forecast_time, temperature_c,
               CAST(precipitation_probability AS DOUBLE) AS precipitation_probability,
               CAST(weather_code AS DOUBLE) AS weather_code, source, preview_no
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY trip_id
                        ORDER BY forecast_time, weather_snapshot_id) AS INTEGER) AS preview_no
              FROM snapshots)
        WHERE preview_no <= 6"""),
}
