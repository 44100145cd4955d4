"""Table and payload schemas, column defaults and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    """Fields are (name, type) for NOT NULL columns, (name, type, True) for nullable ones."""
    return T.StructType([T.StructField(f[0], f[1], len(f) > 2 and f[2]) for f in fields])


_long, _int, _text, _bool = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
_double, _date, _time, _temp = T.DoubleType(), T.DateType(), T.TimestampType(), T.DecimalType(5, 2)

USERS = _struct(
    ("user_id", _long), ("email", _text), ("display_name", _text), ("created_at", _time),
)
TRIPS = _struct(
    ("trip_id", _long), ("user_id", _long), ("name", _text), ("destination_name", _text),
    ("latitude", _double), ("longitude", _double), ("start_date", _date), ("end_date", _date),
    ("interests", T.ArrayType(_text)), ("created_at", _time),
)
ACTIVITIES = _struct(
    ("activity_id", _long), ("destination_name", _text), ("name", _text), ("category", _text),
    ("indoor", _bool), ("description", _text), ("source_url", _text, True),
    ("min_temperature_c", _temp, True), ("max_precipitation_probability", _int), ("created_at", _time),
)
WEATHER_SNAPSHOTS = _struct(
    ("weather_snapshot_id", _long), ("trip_id", _long), ("forecast_time", _time),
    ("temperature_c", _temp, True), ("precipitation_probability", _int, True),
    ("weather_code", _int, True), ("source", _text), ("fetched_at", _time),
)
ITINERARY_ITEMS = _struct(
    ("itinerary_item_id", _long), ("trip_id", _long), ("activity_id", _long), ("scheduled_at", _time),
    ("duration_minutes", _int), ("rationale", _text, True), ("status", _text), ("created_at", _time),
)
PACKING_ITEMS = _struct(
    ("packing_item_id", _long), ("trip_id", _long), ("item_name", _text), ("reason", _text),
    ("packed", _bool), ("created_at", _time),
)
ACTIVITY_DOCUMENTS = _struct(
    ("document_id", _long), ("activity_id", _long), ("document_text", _text),
    ("embedding", T.ArrayType(T.FloatType()), True), ("embedding_model", _text), ("updated_at", _time),
)
BRONZE_WEATHER = _struct(
    ("forecast_time_raw", _text), ("temperature_c", _double, True),
    ("precipitation_probability", _int, True), ("weather_code", _int, True), ("ingested_at", _time),
)
SILVER_WEATHER = _struct(
    ("temperature_c", _double, True), ("precipitation_probability", _int, True),
    ("weather_code", _int, True), ("ingested_at", _time), ("forecast_time", _time, True),
    ("destination_name", _text), ("weather_label", _text),
)
ARTICLES = _struct(
    ("title", _text), ("text", _text), ("source_url", _text, True), ("activity_name", _text),
)
TITLE_LOOKUP = _struct(("title", _text), ("activity_name", _text))

TABLES = {
    "users": USERS,
    "trips": TRIPS,
    "activities": ACTIVITIES,
    "weather_snapshots": WEATHER_SNAPSHOTS,
    "itinerary_items": ITINERARY_ITEMS,
    "packing_items": PACKING_ITEMS,
    "activity_documents": ACTIVITY_DOCUMENTS,
}

HOURLY_PAYLOAD = T.StructType([T.StructField("hourly", T.StructType([
    T.StructField("time", T.ArrayType(_text)),
    T.StructField("temperature_2m", T.ArrayType(_double)),
    T.StructField("precipitation_probability", T.ArrayType(_int)),
    T.StructField("weather_code", T.ArrayType(_int)),
]))])
DAILY_PAYLOAD = T.StructType([T.StructField("daily", T.StructType([
    T.StructField("time", T.ArrayType(_text)),
    T.StructField("weather_code", T.ArrayType(_int)),
    T.StructField("temperature_2m_max", T.ArrayType(_double)),
    T.StructField("temperature_2m_min", T.ArrayType(_double)),
    T.StructField("precipitation_probability_max", T.ArrayType(_int)),
]))])
GEOCODING_PAYLOAD = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("name", _text),
    T.StructField("country", _text),
    T.StructField("latitude", _double),
    T.StructField("longitude", _double),
    T.StructField("timezone", _text),
])))])
ARTICLE_PAYLOAD = T.StructType([T.StructField("query", T.StructType([
    T.StructField("pages", T.MapType(_text, T.StructType([
        T.StructField("title", _text),
        T.StructField("extract", _text),
        T.StructField("fullurl", _text),
    ]))),
]))])

# Limits and defaults that results depend on.
EMBEDDING_DIM = 384
#: Name stored with vectors that are hashed word counts, for want of a model.
HASHED_MODEL = "hashed-384"
WEATHER_SOURCE = "Open-Meteo"
DEFAULT_DURATION_MINUTES = 120
MAX_DURATION_MINUTES = 1440
MIN_ARTICLE_LENGTH = 100
STATUSES = ("planned", "completed", "cancelled")
PREFERRED_CATEGORIES = ("history", "food", "culture")
INDOOR_RATIONALE = "AI-selected indoor option resilient to rain."
OUTDOOR_RATIONALE = "AI-selected outdoor experience aligned with the forecast."
AGENT_RATIONALE = "Added by the travel agent"
DISCOVERY_RATIONALE = "Added from semantic activity discovery."

# Messages that callers see.
PLACE_NOT_FOUND = "Destination not found: "
INCOMPLETE_PLACE = "Incomplete result"
INCOMPLETE_HOURLY = "Incomplete hourly forecast"
INCOMPLETE_DAILY = "Incomplete daily forecast"
INCOMPLETE_ARTICLE = "No page in the article payload"
TRIP_NOT_FOUND = "Trip %s does not exist"
NO_FORECAST = "Trip %s has no forecast payload"
NOT_ADDED = "Trip or activity not found"
INVALID_TIME = "Invalid time"
INVALID_DURATION = "duration_minutes must be between 1 and 1440"
UNKNOWN_TRIP = "Unknown trip"
UNKNOWN_ACTIVITY = "Unknown activity"
NOT_A_NUMBER = "%s must be an integer"
INVALID_TICK = "packed must be true or false"
NO_PACKING_ITEM = "Packing item not found"
NO_ITINERARY_ITEM = "Itinerary item not found"
UNKNOWN_OPERATION = "Unknown operation"
NO_SUCH_ROW = "%s %s does not exist"
NOTHING_STORED = "No %s were stored."

# The catalogue packing list, as (item, reason).
PACKING_CATALOGUE = (
    ("Comfortable walking shoes", "Recommended for city walks and sightseeing"),
    ("Reusable water bottle", "Useful throughout the three-day itinerary"),
    ("Light jacket", "Prepared for cooler mornings and evenings"),
    ("Compact umbrella", "Weather-aware protection when rain risk increases"),
    ("Phone charger", "Keeps maps and travel information available"),
)
RAIN_RISK_ITEM = "Compact umbrella"

# The rule packing list, as (item, reason, least rain, temperature below).
RAIN_LIMIT = 40
COLD_LIMIT = 15
PACKING_RULES = (
    ("Comfortable walking shoes", "Useful for city walking and outdoor activities", None, None),
    ("Compact umbrella", "Rain probability is at least 40%", RAIN_LIMIT, None),
    ("Light jacket", "Forecast temperature falls below 15°C", None, COLD_LIMIT),
)
