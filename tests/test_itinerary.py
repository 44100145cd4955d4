"""Slots, requests, packing lists, read models, constraints."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripweave import schemas
from tripweave.operators import itinerary, keyed, matching, packing, quality, views

D = dt.date(2026, 8, 10)
ITEMS = "itinerary_item_id long, trip_id long, activity_id long, scheduled_at timestamp_ntz, " \
        "duration_minutes int, rationale string, status string, created_at timestamp_ntz"


def at(day, hour):
    return dt.datetime(2026, 8, day, hour)


def trips(spark, *more):
    return spark.createDataFrame([(1, "Lisbon", D), (2, "LISBON", D), (3, "Porto", D), *more],
                                 "trip_id long, destination_name string, start_date date")


def activities(spark):
    return spark.createDataFrame([
        (1, "Lisbon", "River Walk", "outdoors", False, "d1"), (2, "Lisbon", "Monastery", "history", True, "d2"),
        (3, "lisbon", "Museum", "culture", True, "d3"), (4, "Lisbon", "Old Town", "history", False, "d4"),
        (5, "Lisbon", "Market", "food", True, "d5"), (6, "Lisbon", "Aquarium", "family", True, "d6"),
        (7, "Lisbon", "Cinema", "family", True, "d7"), (8, "Porto", "Bridge", "outdoors", False, "d8")],
        "activity_id long, destination_name string, name string, category string, indoor boolean, description string")


def items(spark, *given):
    return spark.createDataFrame(
        [(i, t, a, s, 120, "r", status, None) for i, (t, a, s, status) in enumerate(given, 1)], ITEMS)


def test_generate_ranks_first_and_excludes_after(spark, rows):
    stored = items(spark, (1, 2, at(1, 9), "planned"), (1, 5, at(1, 9), "cancelled"))
    got = itinerary.generate(trips(spark), activities(spark), stored)
    # outdoor: 4 (preferred), 1; indoor: 2, 3, 5 (preferred), 6; 7 is seventh and falls away
    slots = {4: at(10, 10), 1: at(10, 15), 2: at(11, 10), 3: at(11, 15), 5: at(12, 10), 6: at(12, 15)}
    assert rows(got.filter("trip_id = 1"), "activity_id", "scheduled_at") == sorted(
        (a, t) for a, t in slots.items() if a != 2)
    assert rows(got.filter("trip_id = 2"), "activity_id", "scheduled_at") == sorted(slots.items())
    assert rows(got.filter("trip_id = 3"), "activity_id", "scheduled_at", "duration_minutes", "rationale", "status") == [
        (8, at(10, 10), 120, schemas.OUTDOOR_RATIONALE, "planned")]
    assert rows(got.filter("activity_id = 3 and trip_id = 1"), "rationale") == [(schemas.INDOOR_RATIONALE,)]


def test_generate_again_adds_nothing(spark, rows):
    first = itinerary.generate(trips(spark), activities(spark), items(spark))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    stored = itinerary.append_items(items(spark), first, ["trip_id", "activity_id"], now)
    assert stored.count() == 13 and stored.select("itinerary_item_id").distinct().count() == 13
    assert itinerary.generate(trips(spark), activities(spark), stored).count() == 0


def test_add_auto(spark, rows):
    stored = items(spark, (1, 1, at(10, 9), "planned"), (1, 2, at(12, 20), "cancelled"))
    asked = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 3), (3, 1, 3), (4, 1, 2), (5, 1, 8), (6, 3, 8), (7, 99, 8), (8, 1, 99), (9, 3, 8)],
        "request_id long, trip_id long, activity_id long")
    got = itinerary.add_auto(asked, trips(spark), activities(spark), stored)
    # the cancelled item still sets the time; 1 is active, 8 is elsewhere, repeats are dropped
    assert rows(got, "request_id", "trip_id", "activity_id", "scheduled_at") == [
        (2, 1, 3, at(12, 23)), (4, 1, 2, dt.datetime(2026, 8, 13, 2)), (6, 3, 8, at(10, 10))]
    assert rows(itinerary.not_added(asked, got), "request_id") == [(1,), (3,), (5,), (7,), (8,), (9,)]


def test_ids_have_to_be_integers(spark, rows):
    asked = spark.createDataFrame([(1, "7", "8"), (2, "x", "8"), (3, "7", None), (4, " 7 ", "8")],
                                  "request_id long, trip_id string, activity_id string")
    valid, rejects = keyed.integer_columns(asked, ["trip_id", "activity_id"])
    assert rows(valid) == [(1, 7, 8), (4, 7, 8)]
    assert rows(rejects, "request_id", "reject_reason") == [
        (2, "trip_id must be an integer"), (3, "activity_id must be an integer")]


@pytest.mark.parametrize("duration,reason", [
    (0, "duration_minutes must be between 1 and 1440"), (1, None), (1440, None),
    (1441, "duration_minutes must be between 1 and 1440"), (None, None)])
def test_add_checked_duration(spark, rows, duration, reason):
    asked = spark.createDataFrame([(1, 1, 2, "2026-08-10T14:00:00", duration)],
                                  "request_id long, trip_id long, activity_id long, scheduled_at string, duration_minutes int")
    added, rejects = itinerary.add_checked(asked, trips(spark), activities(spark))
    assert rows(rejects, "reject_reason") == ([(reason,)] if reason else [])
    assert rows(added, "duration_minutes", "rationale") == (
        [] if reason else [(duration or 120, schemas.AGENT_RATIONALE)])


def test_add_checked_allows_repeats_and_other_places(spark, rows):
    asked = spark.createDataFrame(
        [(1, 1, 8, "2026-08-10T14:00:00Z", 60, "mine"), (2, 1, 8, "2026-08-10", 60, None),
         (3, 1, 8, "soon", 0, None), (4, 77, 8, "2026-08-10", 60, None), (5, 1, 88, "2026-08-10", 60, None)],
        "request_id long, trip_id long, activity_id long, scheduled_at string, duration_minutes int, rationale string")
    added, rejects = itinerary.add_checked(asked, trips(spark), activities(spark))
    assert rows(added, "request_id", "rationale", "status") == [
        (1, "mine", "planned"), (2, schemas.AGENT_RATIONALE, "planned")]
    assert rows(rejects) == [(3, "Invalid time"), (4, "Unknown trip"), (5, "Unknown activity")]


def snapshots(spark, *given):
    return spark.createDataFrame(given, "trip_id long, temperature_c double, precipitation_probability int")


@pytest.mark.parametrize("rain,cold,expected", [
    (70, 11.0, ["Comfortable walking shoes", "Compact umbrella", "Light jacket"]),
    (39, 15.0, ["Comfortable walking shoes"]), (40, 14.99, ["Comfortable walking shoes", "Compact umbrella", "Light jacket"]),
    (None, None, ["Comfortable walking shoes"])])
def test_packing_rules(spark, rain, cold, expected):
    got = packing.rules(trips(spark).filter("trip_id = 1"), snapshots(spark, (1, cold, rain)))
    assert [r["item_name"] for r in got.orderBy("item_no").collect()] == expected


def test_packing_without_forecast(spark, rows):
    none = snapshots(spark, (99, 1.0, 90))
    assert rows(packing.rules(trips(spark), none), "trip_id", "item_name") == [
        (t, "Comfortable walking shoes") for t in (1, 2, 3)]
    got = packing.catalogue(trips(spark), none.union(snapshots(spark, (2, None, None), (2, 1.0, 55))))
    assert got.count() == 15
    assert rows(got.filter("item_name = 'Compact umbrella'"), "trip_id", "reason") == [
        (t, f"Weather-aware protection when rain risk increases (maximum forecast risk: {p}%)")
        for t, p in ((1, 0), (2, 55), (3, 0))]


def test_dashboard(spark, rows):
    docs = spark.createDataFrame([(1, [1.0]), (2, None), (8, [1.0])], "activity_id long, embedding array<float>")
    weather = spark.createDataFrame(
        [(1, 1, at(10, 1), 12.5, None), (2, 1, at(10, 2), None, 30), (3, 2, at(10, 1), None, None)],
        "weather_snapshot_id long, trip_id long, forecast_time timestamp_ntz, temperature_c double, "
        "precipitation_probability int").withColumns({"weather_code": F.lit(0), "source": F.lit("s")})
    packed = spark.createDataFrame([(1, "a", True)] + [(1, c, False) for c in "bcdefgh"],
                                   "trip_id long, item_name string, packed boolean")
    stored = items(spark, (1, 1, at(10, 9), "planned"), (1, 1, at(10, 9), "completed"), (1, 2, at(10, 9), "cancelled"))
    parts = views.dashboard(trips(spark), weather, stored, activities(spark), docs, packed)
    assert rows(parts["summary"]) == [
        (1, 2, 12.5, 12.5, 30, 1, 5, 2, 12), (2, 1, None, None, 0, 1, 5, 0, 0), (3, 0, None, None, None, 1, 0, 0, 0)]
    assert rows(parts["current"], "trip_id") == [(1,)]
    assert [r["item_name"] for r in parts["packing"].collect()] == list("bcdefgh") + ["a"]
    assert rows(parts["activities"].filter("embedded"), "activity_id") == [(1,), (8,)]
    assert [r["status"] for r in parts["itinerary"].collect()] == ["planned", "completed"]
    assert parts["weather"].count() == 3 and parts["trips"].count() == 3


def test_preview_takes_six(spark):
    frame = spark.range(20).select(
        (F.col("id") % 2).alias("trip_id"), F.col("id"), (-F.col("id")).alias("forecast_time"))
    got = views.weather_preview(frame, "id")
    assert [r["id"] for r in got.filter("trip_id = 1").orderBy("preview_no").collect()] == [19, 17, 15, 13, 11, 9]


def test_articles_match_without_letter_case(spark, rows):
    articles = spark.createDataFrame(
        [(1, "LISBON", "old town", "text"), (2, "Lisbon", "nowhere", "text"), (3, "Porto", "Old Town", "text")],
        "id long, destination_name string, activity_name string, text string")
    offers = activities(spark).unionByName(spark.createDataFrame(
        [(40, "lisbon", "OLD TOWN", "x", True, None)], activities(spark).schema))
    assert rows(matching.match_articles(articles, offers), "id", "activity_id", "document_text") == [
        (1, 4, "Old Town. Category: history. d4\n\ntext")]
    assert rows(matching.unmatched_articles(articles, offers), "id") == [(2,), (3,)]


def test_constraint_report(spark):
    ts = dt.datetime(2024, 1, 1)
    made = {
        "users": [(1, "a", "A", ts), (2, "a", "B", ts)],
        "trips": [(1, 9, "n", "Lisbon", 0.0, 0.0, D, dt.date(2026, 8, 9), [], ts)],
        "activities": [(1, "Lisbon", "n", "c", True, "d", None, None, 101, ts)],
        "weather_snapshots": [(1, 1, ts, None, None, None, "s", ts), (2, 1, ts, None, None, None, "s", ts)],
        "itinerary_items": [(1, 1, 5, ts, 0, None, "lost", ts)],
        "packing_items": [(1, 1, "x", "r", False, ts)],
        "activity_documents": [(1, 1, "t", [1.0, 2.0], "m", ts)],
    }
    tables = {n: spark.createDataFrame(v, schemas.TABLES[n]) for n, v in made.items()}
    bad = {(r["table_name"], r["rule"]): (r["bad_rows"], r["sample_key"])
           for r in quality.travel_report(tables).collect() if r["bad_rows"]}
    assert bad == {
        ("users", "unique(email)"): (2, "a"), ("trips", "end_date >= start_date"): (1, "1"),
        ("trips", "foreign_key(user_id)"): (1, "9"),
        ("activities", "max_precipitation_probability in 0..100"): (1, "1"),
        ("weather_snapshots", "unique(trip_id, forecast_time)"): (2, "1|2024-01-01 00:00:00"),
        ("itinerary_items", "foreign_key(activity_id)"): (1, "5"), ("itinerary_items", "duration_minutes > 0"): (1, "1"),
        ("itinerary_items", "status"): (1, "1"), ("activity_documents", "dimension(embedding)"): (1, "1")}


def test_numeric_overflow(spark):
    frame = spark.createDataFrame([(1, 999.99), (2, 1000.0), (3, None)], "id long, t double")
    assert quality.report([quality.Checks("t", frame, "id", quality.fits_decimal(["t"]))]).first()["bad_rows"] == 1


def test_load_check_fails_on_empty(spark, rows):
    assert rows(quality.require_rows(spark.range(3), "rows")) == [(3,)]
    with pytest.raises(Exception, match="No rows were stored"):
        quality.require_rows(spark.range(0), "rows").collect()
