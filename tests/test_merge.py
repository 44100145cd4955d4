"""Upserts, updates, deletes: column lists, NULLs, repeated keys, ids, reruns."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tripweave import schemas
from tripweave.operators import changes, keyed, merge

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 1)
OLD, RUN = dt.datetime(2023, 1, 1), dt.datetime(2024, 2, 1)
WEATHER = "weather_snapshot_id long, trip_id long, forecast_time timestamp, temperature_c decimal(5,2), " \
          "precipitation_probability int, weather_code int, source string, fetched_at timestamp"


def now():
    return F.lit(str(RUN)).cast("timestamp")


@pytest.fixture(params=[True, False], ids=["few", "many"])
def size(request, monkeypatch):
    """Both join shapes: few changes (broadcast) and many (shuffled)."""
    for module in (keyed, merge, changes):
        monkeypatch.setattr(module, "is_small", lambda *_: request.param)


def weather(spark, *given):
    return spark.createDataFrame(
        [(i, t, f, Decimal(c), p, w, "old", OLD)
         for i, t, f, c, p, w in given], WEATHER)


def forecast(spark, *given):
    return spark.createDataFrame(given, "seq int, trip_id long, forecast_time timestamp, temperature_c double, "
                                        "precipitation_probability int, weather_code int")


def test_weather_upsert(spark, rows, size):
    target = weather(spark, (5, 1, T0, 1, 1, 1), (9, 1, T1, 2, 2, 2))
    merged = changes.upsert_weather(target, forecast(
        spark, (1, 1, T0, 8.0, 8, 8), (2, 1, T0, None, None, 7), (3, 2, T0, 3.456, 3, 3)), "seq", now())
    got = {(r["trip_id"], r["forecast_time"]): r for r in merged.collect()}
    changed = got[1, T0]
    assert (changed["weather_snapshot_id"], changed["temperature_c"], changed["precipitation_probability"],
            changed["weather_code"], changed["source"], changed["fetched_at"], changed["change"]) == (
        5, None, None, 7, schemas.WEATHER_SOURCE, RUN, "updated")
    assert (got[1, T1]["source"], got[1, T1]["fetched_at"], got[1, T1]["change"]) == ("old", OLD, "kept")
    fresh = got[2, T0]
    assert fresh["weather_snapshot_id"] > 9 and str(fresh["temperature_c"]) == "3.46"
    assert rows(merge.change_report(merged)) == [("inserted", 1), ("updated", 1)]


def test_weather_upsert_twice_is_once(spark, rows, size):
    target = weather(spark, (5, 1, T0, 1, 1, 1))
    batch = forecast(spark, (1, 1, T0, 8.0, 8, 8), (2, 2, T0, 3.0, 3, 3), (3, 2, T1, 4.0, 4, 4))
    once = merge.settled(changes.upsert_weather(target, batch, "seq", now()))
    twice = changes.upsert_weather(once, batch, "seq", now())
    assert rows(merge.settled(twice)) == rows(once)
    assert rows(merge.change_report(twice)) == [("updated", 3)]


def test_document_upsert_keeps_the_model(spark, rows, size):
    target = spark.createDataFrame(
        [(1, 10, "old", [1.0], "stored", OLD)],
        "document_id long, activity_id long, document_text string, embedding array<float>, "
        "embedding_model string, updated_at timestamp")
    batch = spark.createDataFrame([(1, 10, "new", None), (2, 11, "x", [2.0])],
                                  "seq int, activity_id long, document_text string, embedding array<float>")
    got = changes.upsert_documents(target, batch, "seq", now(), "a-model")
    assert rows(got, "activity_id", "document_text", "embedding", "embedding_model", "updated_at") == [
        (10, "new", None, "stored", RUN), (11, "x", [2.0], "a-model", RUN)]


def test_packing_upsert_never_unticks(spark, rows, size):
    target = spark.createDataFrame(
        [(1, 1, "Shoes", "old", True, OLD), (2, 1, "Stale", "kept", False, OLD)],
        "packing_item_id long, trip_id long, item_name string, reason string, packed boolean, created_at timestamp")
    batch = spark.createDataFrame([(1, 1, "Shoes", "new"), (2, 1, "Hat", "sun")],
                                  "seq int, trip_id long, item_name string, reason string")
    got = changes.upsert_packing(target, batch, "seq", now())
    assert rows(got, "item_name", "reason", "packed", "created_at") == [
        ("Hat", "sun", False, RUN), ("Shoes", "new", True, OLD), ("Stale", "kept", False, OLD)]
    assert rows(got, "item_name", "packing_item_id")[1:] == [("Shoes", 1), ("Stale", 2)]


def test_seeds_leave_stored_rows_alone(spark, rows, size):
    users = spark.createDataFrame([(7, "a@x", "A", OLD)], schemas.USERS)
    offered = spark.createDataFrame([(1, "a@x", "other"), (2, "b@x", "B"), (3, "b@x", "B2")],
                                    "seq int, email string, display_name string")
    seeded = merge.settled(changes.seed_users(users, offered, "seq", now()))
    assert rows(seeded, "email", "display_name") == [("a@x", "A"), ("b@x", "B")]
    assert rows(merge.settled(changes.seed_users(seeded, offered, "seq", now()))) == rows(seeded)

    trips = spark.createDataFrame([], schemas.TRIPS)
    wanted = spark.createDataFrame(
        [(1, "b@x", "Adventure", "Lisbon", 38.7, -9.1, None), (2, "none@x", "Lost", "Lisbon", 0.0, 0.0, None)],
        "seq int, email string, name string, destination_name string, latitude double, longitude double, "
        "interests array<string>")
    planned = merge.settled(changes.seed_trips(
        trips, wanted, seeded, "seq", F.lit("2026-08-09").cast("date"), now()))
    assert rows(planned, "name", "start_date", "end_date", "interests") == [
        ("Adventure", dt.date(2026, 8, 10), dt.date(2026, 8, 12), [])]
    again = changes.seed_trips(planned, wanted, seeded, "seq", F.lit("2027-01-01").cast("date"), now())
    assert rows(merge.settled(again)) == rows(planned)


def test_activity_seed_defaults(spark, rows, size):
    stored = spark.createDataFrame([], schemas.ACTIVITIES)
    offered = spark.createDataFrame(
        [(1, "Lisbon", "Walk", "outdoors", None, "d", None, None), (2, "Lisbon", "walk", "outdoors", True, "d", 12.0, 25)],
        "seq int, destination_name string, name string, category string, indoor boolean, description string, "
        "min_temperature_c double, max_precipitation_probability int")
    got = changes.seed_activities(stored, offered, "seq", now())
    assert rows(got, "name", "indoor", "max_precipitation_probability", "source_url") == [
        ("Walk", False, 100, None), ("walk", True, 25, None)]


ITEMS = "itinerary_item_id long, trip_id long, activity_id long, scheduled_at timestamp, rationale string, status string"


def items(spark):
    return spark.createDataFrame(
        [(1, 1, 10, T0, "r", "planned"), (2, 1, 11, T1, "r", "completed")], ITEMS)


def test_move(spark, rows, size):
    asked = spark.createDataFrame(
        [(1, 1, "2026-08-10T16:00:00Z", "rain"), (2, 9, "2026-08-10T16:00:00", "x"), (3, 2, "later", "x")],
        "seq int, itinerary_item_id long, new_time string, reason string")
    moved, rejects = changes.move_items(items(spark), asked, "itinerary_item_id", "seq", "new_time", "reason")
    assert rows(moved, "itinerary_item_id", "scheduled_at", "rationale", "status", "change") == [
        (1, dt.datetime(2026, 8, 10, 16), "rain", "planned", "updated"), (2, T1, "r", "completed", "kept")]
    assert rows(rejects) == [(2, 3, "Invalid time"), (9, 2, "Itinerary item 9 does not exist")]


def test_cancel_keeps_the_row(spark, rows, size):
    asked = spark.createDataFrame([(1, 2), (2, 2), (3, 9)], "seq int, itinerary_item_id long")
    done, rejects = changes.cancel_items(items(spark), asked, "itinerary_item_id", "seq")
    assert rows(done, "itinerary_item_id", "status") == [(1, "planned"), (2, "cancelled")]
    assert rows(rejects, "itinerary_item_id", "reject_reason") == [(9, "Itinerary item not found")]


def test_remove(spark, rows, size):
    asked = spark.createDataFrame([(1,), (999,)], "itinerary_item_id long")
    left, removed, rejects = changes.remove_items(items(spark), asked, "itinerary_item_id")
    assert rows(left, "itinerary_item_id") == [(2,)]
    assert rows(removed, "itinerary_item_id", "trip_id", "activity_id") == [(1, 1, 10)]
    assert rows(rejects) == [(999, "Itinerary item 999 does not exist")]


def test_set_packed_takes_booleans_only(spark, rows, size):
    packing = spark.createDataFrame([(1, False), (2, True)], "packing_item_id long, packed boolean")
    asked = spark.createDataFrame([(1, 1, "true"), (2, 2, "yes"), (3, 2, "false"), (4, 8, "true")],
                                  "seq int, packing_item_id long, packed string")
    done, rejects = changes.set_packed(packing, asked, "packing_item_id", "seq")
    assert rows(done, "packing_item_id", "packed") == [(1, True), (2, False)]
    assert rows(rejects, "packing_item_id", "reject_reason") == [
        (2, "packed must be true or false"), (8, "Packing item not found")]


def test_cascades(spark, rows, size):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    trips = spark.createDataFrame([(10, 1), (20, 2)], "trip_id long, user_id long")
    children = spark.createDataFrame([(1, 10, 100), (2, 20, 200)], "id long, trip_id long, activity_id long")
    left = changes.delete_users(users, trips, {"items": children}, users.filter("user_id = 1"))
    assert rows(left["users"]) == [(2,)] and rows(left["trips"]) == [(20, 2)] and rows(left["items"]) == [(2, 20, 200)]

    activities = spark.createDataFrame([(100,), (200,), (300,)], "activity_id long")
    documents = spark.createDataFrame([(1, 100), (2, 200)], "document_id long, activity_id long")
    after = changes.delete_activities(activities, documents, left["items"], activities.filter("activity_id < 300"))
    assert rows(after["activities"]) == [(200,), (300,)]
    assert rows(after["documents"]) == [(2, 200)]
    assert rows(after["blocked"]) == [(200,)]


def test_new_ids_are_unique_stable_and_above_the_old_ones(spark, rows):
    old = spark.createDataFrame([(41,)], "id long")
    new = spark.range(5000).select(F.col("id").alias("k"))
    first = keyed.with_new_ids(new.repartition(7), old, "id", ["k"])
    second = keyed.with_new_ids(new.repartition(3), old, "id", ["k"])
    assert rows(first) == rows(second)
    ids = [r[0] for r in first.select("id").collect()]
    assert sorted(ids) == list(range(42, 5042))


def test_running_index_of_a_hot_key_with_sparse_numbers(spark):
    frame = spark.range(1000).select(F.xxhash64("id").alias("request"), F.when(F.col("id") < 900, 1).otherwise(
        F.col("id") % 5).alias("key"))
    got = keyed.running_index(frame.repartition(5), ["key"], "request", "n").collect()
    seen = {}
    for row in sorted(got, key=lambda r: r["request"]):
        seen[row["key"]] = seen.get(row["key"], 0) + 1
        assert row["n"] == seen[row["key"]]
    assert len(got) == 1000


def test_size_checks(spark):
    assert keyed.is_small(spark.range(10), 160) and not keyed.is_small(spark.range(10), 159)
    text = spark.createDataFrame([("abc", [1.5]), (None, None), ("é", [])], "q string, v array<double>")
    assert keyed.is_small(text.select("q"), 29) and not keyed.is_small(text.select("q"), 28)
    assert not keyed.is_small(text, 40)
    assert keyed.is_small(text.filter("false"), 0)
    long = spark.createDataFrame([("x" * 1000,)], "q string")
    assert not keyed.is_small(long, 1000)
