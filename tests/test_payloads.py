"""Payload parsing: golden rows (fixed values), unequal arrays, missing parts."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tripweave import schemas
from tripweave.sources import payloads


def landed(spark, **by_key):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in by_key.items()], "key string, payload string")


def test_geocoding_takes_first_hit(spark, rows):
    hit = {"name": "Lisbon", "country": "Portugal", "latitude": 38.72, "longitude": -9.14, "timezone": "Europe/Lisbon"}
    frame = landed(spark, Lisbon={"results": [hit, {"name": "Other", "latitude": 0.0, "longitude": 0.0}]},
                   Bare={"results": [{"name": "Bare", "latitude": 1.0, "longitude": 2.0}]},
                   Empty={"results": []}, Missing={}, Half={"results": [{"name": "Half", "latitude": 1.0}]})
    found, rejects = payloads.resolve_places(frame, "key", "payload")
    assert rows(found) == [("Bare", "Bare", None, 1.0, 2.0, None),
                           ("Lisbon", "Lisbon", "Portugal", 38.72, -9.14, "Europe/Lisbon")]
    assert rows(rejects) == [("Empty", "Destination not found: Empty"), ("Half", "Incomplete result"),
                             ("Missing", "Destination not found: Missing")]


def test_daily_payload_golden_row(spark, rows):
    daily = {"time": ["2026-08-10"], "weather_code": [61], "temperature_2m_max": [23.0],
             "temperature_2m_min": [17.0], "precipitation_probability_max": [70]}
    got, rejects = payloads.daily_rows(landed(spark, a={"daily": daily}), "payload")
    assert got.columns == ["key", "date", "weather_code", "temperature_max_c", "temperature_min_c",
                           "precipitation_probability"]
    assert rows(got) == [("a", "2026-08-10", 61, 23.0, 17.0, 70)]
    assert rows(rejects) == []


def test_daily_payload_is_led_by_time(spark, rows):
    full = {"time": ["d1", "d2"], "weather_code": [1, 2], "temperature_2m_max": [1.0, 2.0],
            "temperature_2m_min": [0.0, 1.0], "precipitation_probability_max": [5, None]}
    frame = landed(spark, full={"daily": full}, long={"daily": {**full, "weather_code": [1, 2, 3]}},
                   short={"daily": {**full, "temperature_2m_min": [0.0]}}, none={},
                   empty={"daily": {k: [] for k in full}})
    got, rejects = payloads.daily_rows(frame, "payload")
    assert rows(got, "key", "date", "precipitation_probability") == [
        ("full", "d1", 5), ("full", "d2", None), ("long", "d1", 5), ("long", "d2", None)]
    assert rows(rejects, "key") == [("none",), ("short",)]


def test_hourly_arrays_stop_at_the_shortest(spark, rows):
    hourly = {"time": ["t1", "t2", "t3"], "temperature_2m": [1.5, None, 3.5],
              "precipitation_probability": [10, 20], "weather_code": [0, 1, 2]}
    got, rejects = payloads.hourly_rows(landed(spark, a={"hourly": hourly}), "payload")
    assert rows(got) == [("a", "t1", 1.5, 10, 0), ("a", "t2", None, 20, 1)]
    assert rows(rejects) == []


def test_unusable_hourly_payloads_are_rejected(spark, rows):
    full = {"time": [], "temperature_2m": [], "precipitation_probability": [], "weather_code": []}
    frame = landed(spark, missing={}, short={"hourly": {"time": ["x"]}}, none={"hourly": full}).union(
        spark.createDataFrame([("broken", '{"hourly": {"time": ['), ("null", None)], "key string, payload string"))
    got, rejects = payloads.hourly_rows(frame, "payload")
    assert rows(got) == []
    assert rows(rejects) == [(k, schemas.INCOMPLETE_HOURLY) for k in ("broken", "missing", "null", "short")]


def test_trip_forecast_uses_stored_place_and_dates(spark, rows):
    trips = spark.createDataFrame(
        [(1, 38.72, -9.14, dt.date(2026, 8, 10), dt.date(2026, 8, 12))],
        "trip_id long, latitude double, longitude double, start_date date, end_date date")
    daily = {"time": ["2026-08-10"], "weather_code": [0], "temperature_2m_max": [1.0],
             "temperature_2m_min": [0.0], "precipitation_probability_max": [0]}
    frame = spark.createDataFrame([(1, json.dumps({"daily": daily}))], "trip_id long, payload string")
    trips = trips.union(trips.withColumn("trip_id", F.lit(2)))
    requests = spark.createDataFrame([(1,), (2,), (9,)], "trip_id long")
    got, rejects = payloads.trip_forecast(requests, trips, frame, "payload")
    assert rows(got, "trip_id", "latitude", "longitude", "start_date", "end_date", "date") == [
        (1, 38.72, -9.14, dt.date(2026, 8, 10), dt.date(2026, 8, 12), "2026-08-10")]
    assert rows(rejects) == [(2, "Trip 2 has no forecast payload"), (9, "Trip 9 does not exist")]


def test_article_payload_fallbacks(spark, rows):
    pages = lambda p: {"query": {"pages": {"17": p, "18": {"title": "second"}}}}
    frame = landed(spark, asked=pages({}), other=pages({"title": "T", "extract": "text", "fullurl": "u"}))
    frame = frame.union(spark.createDataFrame([("broken", "{"), ("null", None), ("bare", '{"query": {"pages": {}}}')], frame.schema))
    got, rejects = payloads.article_rows(frame, "key", "payload")
    assert rows(rejects) == [(k, schemas.INCOMPLETE_ARTICLE) for k in ("bare", "broken", "null")]
    assert rows(got, "key", "title", "text", "source_url") == [
        ("asked", "asked", "", None), ("other", "T", "text", "u")]


def test_html_pages(spark, rows):
    html = "<html><title>A &amp; B</title><body><nav>x</nav><article><h1>Hi</h1>\n<p>there</p></article></body>"
    frame = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert rows(payloads.html_articles(frame, "page_id", "url", "html")) == [(1, "A &amp; B", "Hi there", "u")]
