"""The daily load from payloads to checked tables, run twice."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tripweave import jobs, schemas
from tripweave.operators import views

RUN = "2026-08-09 06:00:00"


def hourly(day, *values):
    return json.dumps({"hourly": {
        "time": [f"2026-{day}T{h:02d}:00" for h in range(len(values))], "temperature_2m": [float(v) for v in values],
        "precipitation_probability": list(values), "weather_code": list(values)}})


def article(title, text):
    return json.dumps({"query": {"pages": {"1": {"title": title, "extract": text, "fullurl": "u"}}}})


@pytest.fixture
def warehouse(spark, tmp_path):
    w = jobs.Warehouse(spark, str(tmp_path / "w"))
    w.create()
    ts, day = dt.datetime(2026, 1, 1), dt.date(2026, 8, 10)
    trip = lambda i, place: (i, 1, f"t{i}", place, 0.0, 0.0, day, day, [], ts)
    w.replace("trips", spark.createDataFrame([trip(1, "Lisbon"), trip(2, "LISBON"), trip(3, "Porto")], schemas.TRIPS))
    w.replace("activities", spark.createDataFrame(
        [(1, "Lisbon", "Old Town", "history", False, "walk", None, None, 100, ts),
         (2, "Lisbon", "Museum", "culture", True, "art", None, None, 100, ts)], schemas.ACTIVITIES))
    return w


def load(spark, warehouse, *weather):
    now = F.lit(RUN).cast("timestamp")
    got = jobs.load_weather(warehouse, spark.createDataFrame(
        [(n, *w) for n, w in enumerate(weather)], "payload_id int, destination_name string, payload string"), now)
    landed = spark.createDataFrame(
        [(1, "lisbon", "A", article("Alfama", "long " * 30)), (2, "Lisbon", "B", article("Alfama", "long " * 40)),
         (3, "Lisbon", "C", article("Short", "x")), (4, "Lisbon", "D", article("Gone", "words " * 30)),
         (5, "Lisbon", "E", article("Unasked", "words " * 30)), (6, "Lisbon", "A", "{")],
        "article_id long, destination_name string, requested_title string, payload string")
    titles = spark.createDataFrame(
        [("A", "OLD TOWN"), ("B", "Old Town"), ("C", "Museum"), ("D", "Nowhere")], schemas.TITLE_LOOKUP)
    return got | jobs.load_articles(warehouse, landed, titles, now)


def test_daily_load(spark, warehouse, rows):
    got = load(spark, warehouse, ("Lisbon", hourly("08-10", 0, 2, 60)), ("Atlantis", hourly("08-10", 1)), ("Lisbon", "{"))
    assert rows(got["unusable_payloads"], "payload_id") == [(2,)]
    assert rows(got["unusable_articles"], "article_id") == [(6,)]
    assert rows(got["unmapped"]) == [(5, "E")]
    assert rows(got["summary"], "weather_label", "hours") == [("clear", 1), ("cloudy", 2), ("rain", 1)]
    assert rows(got["without_trip"]) == [("Atlantis",)]
    assert rows(got["unmatched"], "article_id") == [(4,)]
    snapshots = warehouse.read("weather_snapshots")
    assert rows(snapshots, "trip_id", "precipitation_probability", "source") == [
        (1, 0, "Open-Meteo"), (1, 2, "Open-Meteo"), (1, 60, "Open-Meteo")]
    document = warehouse.read("activity_documents").collect()
    assert [(d["activity_id"], len(d["embedding"])) for d in document] == [(1, 384)]
    assert document[0]["document_text"].startswith("Old Town. Category: history. walk\n\nlong")
    assert rows(jobs.check_load(warehouse)) == [(1, "activity_documents"), (3, "weather_snapshots")]


def test_second_load_changes_values_and_keeps_ids(spark, warehouse, rows):
    load(spark, warehouse, ("Lisbon", hourly("08-10", 0, 2, 60)), ("Porto", hourly("09-01", 5)))
    before = {r["forecast_time"]: r["weather_snapshot_id"] for r in warehouse.read("weather_snapshots").collect()}
    documents = rows(warehouse.read("activity_documents"))
    load(spark, warehouse, ("Lisbon", hourly("08-10", 1, 1, 1)), ("Lisbon", hourly("08-10", 9, 2, 60, 4)))
    after = warehouse.read("weather_snapshots").collect()
    assert len(after) == 5 and len({r["weather_snapshot_id"] for r in after}) == 5
    assert all(before.get(r["forecast_time"], r["weather_snapshot_id"]) == r["weather_snapshot_id"] for r in after)
    assert {(r["trip_id"], r["precipitation_probability"]) for r in after} == {(1, 9), (1, 2), (1, 60), (1, 4), (3, 5)}
    assert rows(warehouse.read("activity_documents")) == documents


def test_dashboard_opens_on_an_empty_warehouse(spark, warehouse):
    summary = views.dashboard_summary(*[warehouse.read(n) for n in (
        "trips", "weather_snapshots", "itinerary_items", "activities", "activity_documents", "packing_items")])
    assert summary.count() == 3 and summary.agg(F.sum("planned_items")).first()[0] == 0


def test_requests_change_the_stored_items(spark, rows, tmp_path):
    warehouse = jobs.Warehouse(spark, str(tmp_path / "w"))
    warehouse.create()
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    day = "TIMESTAMP '2024-01-05 10:00:00'"
    warehouse.replace("trips", spark.sql(
        f"SELECT 1L trip_id, 1L user_id, 'a' name, 'Rome' destination_name, 1D latitude, 1D longitude, DATE '2024-01-01' start_date, "
        f"DATE '2024-01-03' end_date, array('x') interests, {day} created_at"))
    warehouse.replace("activities", spark.sql(
        f"SELECT 5L activity_id, 'Rome' destination_name, 'n' name, 'c' category, true indoor, 'd' description, null source_url, "
        f"cast(null as decimal(5,2)) min_temperature_c, 100 max_precipitation_probability, {day} created_at"))
    requests = spark.createDataFrame(
        [(1, "add", None, None, 1, 5, "2024-01-05T09:00:00", 60, "why"), (2, "move", None, 1, None, None, "2024-01-06T11:00:00", None, "later"),
         (3, "add", None, None, 2, 5, "2024-01-05T09:00:00", 60, "no trip"), (4, "cancel", 77, None, None, None, None, None, None)],
        "seq bigint, op string, itinerary_item_id bigint, ref bigint, trip_id bigint, activity_id bigint, raw_time string, duration_minutes int, reason string")
    out = jobs.apply_requests(warehouse, requests, now)
    assert rows(out["added"]) == [(1, 1)]
    assert rows(out["rejects"]) == [(3, "Unknown trip"), (4, "Itinerary item not found")]
    stored = warehouse.read("itinerary_items").first()
    assert (stored.itinerary_item_id, stored.rationale, stored.status, str(stored.scheduled_at)) == (1, "later", "planned", "2024-01-06 11:00:00")
    again = jobs.apply_requests(warehouse, requests.filter("seq = 4").withColumn("itinerary_item_id", F.lit(1).cast("bigint")), now)
    assert again["rejects"].count() == 0 and warehouse.read("itinerary_items").first().status == "cancelled"
