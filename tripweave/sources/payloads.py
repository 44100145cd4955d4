"""Landed API payloads (JSON text) to rows, with rejects for what cannot be used.

Each reader takes a DataFrame with the payload text in one column and returns either
one DataFrame or a (rows, rejects) pair. Every step is a projection: no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tripweave import schemas


def resolve_places(requests: DataFrame, name: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """First geocoding hit per requested name. Name, latitude and longitude are required."""
    parsed = requests.withColumn("_hits", F.from_json(payload, schemas.GEOCODING_PAYLOAD)["results"])
    hit = F.try_element_at("_hits", F.lit(1))
    parsed = parsed.withColumn("_hit", hit).withColumn(
        "reject_reason",
        F.when(F.col("_hit").isNull(), F.concat(F.lit(schemas.PLACE_NOT_FOUND), F.col(name)))
        .when(F.col("_hit.name").isNull() | F.col("_hit.latitude").isNull()
              | F.col("_hit.longitude").isNull(), F.lit(schemas.INCOMPLETE_PLACE)),
    )
    kept = [c for c in requests.columns if c != payload]
    found = parsed.filter(F.col("reject_reason").isNull()).select(
        *kept,
        F.col("_hit.name").alias("name"), F.col("_hit.country").alias("country"),
        F.col("_hit.latitude").alias("latitude"), F.col("_hit.longitude").alias("longitude"),
        F.col("_hit.timezone").alias("timezone"),
    )
    rejects = parsed.filter(F.col("reject_reason").isNotNull()).select(*kept, "reject_reason")
    return found, rejects


def _zip_to_shortest(arrays: dict[str, Column]) -> Column:
    """Arrays zipped into structs up to the shortest of them; a missing array gives none."""
    shortest = F.array_min(F.array(*[F.coalesce(F.size(a), F.lit(0)) for a in arrays.values()]))
    length = F.greatest(shortest, F.lit(0))
    return F.arrays_zip(*[F.slice(a, F.lit(1), length).alias(n) for n, a in arrays.items()])


def hourly_rows(payloads: DataFrame, payload: str,
                position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Bronze rows of hourly payloads: the four parallel arrays, cut to the shortest.

    `position` names a column for a row's place in its payload. Rejects: payloads that are no
    JSON, have no hourly part, or lack one of the four arrays.
    """
    kept = [c for c in payloads.columns if c != payload]
    parsed = payloads.select(*kept, F.from_json(payload, schemas.HOURLY_PAYLOAD)["hourly"].alias("_hourly"))
    arrays = {
        "forecast_time_raw": F.col("_hourly.time"),
        "temperature_c": F.col("_hourly.temperature_2m"),
        "precipitation_probability": F.col("_hourly.precipitation_probability"),
        "weather_code": F.col("_hourly.weather_code"),
    }
    complete = reduce(lambda x, y: x & y, [array.isNotNull() for array in arrays.values()])
    rows = parsed.filter(complete).select(*kept, F.posexplode(_zip_to_shortest(arrays)).alias("_place", "_row")).select(
        *kept, *([F.col("_place").alias(position)] if position else []),
        *[F.col("_row")[name].alias(name) for name in arrays])
    return rows, parsed.filter(~complete).select(*kept, F.lit(schemas.INCOMPLETE_HOURLY).alias("reject_reason"))


def daily_rows(payloads: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Forecast days of daily payloads. The time array leads: a payload where another
    array is shorter is rejected as a whole; extra elements are not used."""
    kept = [c for c in payloads.columns if c != payload]
    parsed = payloads.select(*kept, F.from_json(payload, schemas.DAILY_PAYLOAD)["daily"].alias("_daily"))
    source = {
        "date": "time", "weather_code": "weather_code", "temperature_max_c": "temperature_2m_max",
        "temperature_min_c": "temperature_2m_min",
        "precipitation_probability": "precipitation_probability_max",
    }
    arrays = {name: F.col("_daily")[field] for name, field in source.items()}
    days = F.size(arrays["date"])
    complete = F.coalesce(days >= 0, F.lit(False))
    for array in arrays.values():
        complete = complete & F.coalesce(F.size(array) >= days, F.lit(False))
    parsed = parsed.withColumn("_complete", complete)
    rows = parsed.filter("_complete").withColumn(
        "_row", F.explode(_zip_to_shortest(arrays))
    ).select(*kept, *[F.col("_row")[name].alias(name) for name in source])
    rejects = parsed.filter(~F.col("_complete")).select(
        *kept, F.lit(schemas.INCOMPLETE_DAILY).alias("reject_reason"))
    return rows, rejects


def trip_forecast(requests: DataFrame, trips: DataFrame, payloads: DataFrame,
                  payload: str, trip_id: str = "trip_id") -> tuple[DataFrame, DataFrame]:
    """Daily forecast for each requested trip, with the trip's coordinates and dates.
    Rejects: unknown trips, trips without a payload and incomplete payloads."""
    place = trips.select(trip_id, "latitude", "longitude", "start_date", "end_date")
    asked = requests.select(trip_id).join(place.withColumn("_known", F.lit(True)), trip_id, "left").join(
        payloads.withColumn("_landed", F.lit(True)), trip_id, "left")
    name = F.col(trip_id).cast("string")
    reason = F.when(F.col("_known").isNull(), F.format_string(schemas.TRIP_NOT_FOUND, name)).when(
        F.col("_landed").isNull(), F.format_string(schemas.NO_FORECAST, name))
    unusable = asked.withColumn("reject_reason", reason).filter(F.col("reject_reason").isNotNull()).select(
        trip_id, "reject_reason")
    rows, incomplete = daily_rows(asked.filter("_known AND _landed").drop("_known", "_landed"), payload)
    return rows, unusable.unionByName(incomplete.select(trip_id, "reject_reason"))


def article_rows(payloads: DataFrame, requested_title: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """First page of each article payload: title (or the requested one), text (or ''), url.
    Rejects: payloads that are no JSON or have no page."""
    kept = [c for c in payloads.columns if c != payload]
    page = F.try_element_at(F.map_values(
        F.from_json(payload, schemas.ARTICLE_PAYLOAD)["query"]["pages"]), F.lit(1))
    parsed = payloads.select(*kept, page.alias("_page"))
    rows = parsed.filter(F.col("_page").isNotNull()).select(
        *kept,
        F.coalesce(F.col("_page.title"), F.col(requested_title)).alias("title"),
        F.coalesce(F.col("_page.extract"), F.lit("")).alias("text"),
        F.col("_page.fullurl").alias("source_url"),
    )
    return rows, parsed.filter(F.col("_page").isNull()).select(
        *kept, F.lit(schemas.INCOMPLETE_ARTICLE).alias("reject_reason"))


def html_articles(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """Article rows from landed web pages: page title, whole article text without tags, url."""
    body = F.regexp_extract(html, r"(?s)<article>(.*)</article>", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " "))
    return pages.select(
        F.col(page_id),
        F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        plain.alias("text"), F.col(url).alias("source_url"),
    )
