"""Mixed requests against applying them one after the other."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tripweave.operators import changelog, keyed, merge

ITEMS = ("itinerary_item_id bigint, trip_id bigint, activity_id bigint, scheduled_at timestamp_ntz, duration_minutes int, "
         "rationale string, status string, created_at timestamp_ntz, note string")
REQUESTS = ("seq bigint, op string, itinerary_item_id bigint, ref bigint, trip_id bigint, activity_id bigint, raw_time string, "
            "duration_minutes int, reason string, item string")
NOW = dt.datetime(2024, 2, 1)


def one_by_one(items, requests, trips, activities):
    table = {row[0]: list(row) for row in items}
    highest, added, rejects, number = max(table, default=0), {}, [], 0
    for seq, op, item, ref, trip, activity, raw, minutes, reason, _ in sorted(requests):
        time = dt.datetime.fromisoformat(raw) if raw and raw != "soon" else None
        if op not in ("add", "move", "cancel", "remove"):
            rejects.append((seq, "Unknown operation"))
        elif op in ("add", "move") and time is None:
            rejects.append((seq, "Invalid time"))
        elif op == "add":
            if minutes is None or not 1 <= minutes <= 1440:
                rejects.append((seq, "duration_minutes must be between 1 and 1440"))
            elif trip not in trips:
                rejects.append((seq, "Unknown trip"))
            elif activity not in activities:
                rejects.append((seq, "Unknown activity"))
            else:
                number += 1
                added[seq] = highest + number
                table[highest + number] = [highest + number, trip, activity, time, minutes, reason, "planned", NOW, None]
        else:
            target = added.get(ref) if ref is not None else item
            if target not in table or target is None:
                rejects.append((seq, "Itinerary item not found"))
            elif op == "move":
                table[target][3], table[target][5] = time, reason
            elif op == "cancel":
                table[target][6] = "cancelled"
            else:
                del table[target]
    return sorted(map(tuple, table.values())), sorted(added.items()), sorted(rejects)


def made(seed, n, hot):
    rng = random.Random(seed)
    items = [(i, i % 3, i % 5, dt.datetime(2024, 1, i, 10), 60, "r", rng.choice(["planned", "completed", "cancelled"]), None, "n")
             for i in range(1, 9)]
    requests = [(seq, rng.choice(["add", "move", "move", "cancel", "remove", "tick", None]),
                 rng.choice([None, 3, 3, 3] if hot else [None, *range(1, 11)]), rng.choice([None, None, rng.randrange(n)]), rng.randrange(4), rng.randrange(6),
                 rng.choice(["2024-03-01T10:00:00", "2024-03-02 11:00:00", "soon", None, "2024-03-03T12:30:00"]),
                 rng.choice([None, 0, 1, 90, 1440, 1441]), rng.choice(["a", "b", None]), "x") for seq in range(n)]
    return items, requests


@pytest.mark.parametrize("seed,n,hot,small", [(1, 60, False, True), (2, 200, True, True), (3, 120, False, False), (4, 0, False, True)])
def test_requests_have_the_effect_of_one_after_the_other(spark, monkeypatch, seed, n, hot, small):
    monkeypatch.setattr(changelog, "is_small", lambda *_: small)
    items, requests = made(seed, n, hot)
    trips, activities = spark.createDataFrame([(0,), (1,), (2,)], "trip_id bigint"), spark.range(5).select(F.col("id").alias("activity_id"))
    left, added, rejects = changelog.apply_requests(
        spark.createDataFrame(items, ITEMS).repartition(3), spark.createDataFrame(requests, REQUESTS).repartition(4),
        trips, activities, F.lit(NOW).cast("timestamp_ntz"))
    want_items, want_added, want_rejects = one_by_one(items, requests, {0, 1, 2}, set(range(5)))
    assert sorted(tuple(r) for r in left.collect()) == want_items
    assert sorted(map(tuple, added.collect())) == want_added and sorted(tuple(r) for r in rejects.collect()) == want_rejects


def test_a_stored_highest_id_is_used(spark):
    items, _ = made(1, 0, False)
    request = [(5, "add", None, None, 1, 1, "2024-03-01T10:00:00", 30, "a", "x")]
    _, added, _ = changelog.apply_requests(
        spark.createDataFrame(items, ITEMS), spark.createDataFrame(request, REQUESTS), spark.createDataFrame([(1,)], "trip_id bigint"),
        spark.createDataFrame([(1,)], "activity_id bigint"), F.lit(NOW).cast("timestamp_ntz"), highest=70)
    assert [tuple(r) for r in added.collect()] == [(5, 71)]


def test_an_upsert_reads_its_target_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "target")
    spark.createDataFrame([(i, f"k{i}", i) for i in range(100)], "id bigint, k string, v int").write.parquet(path)
    plans = []

    def kept(rows, kind="rows"):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return keyed.stored(rows, kind)

    monkeypatch.setattr(merge, "stored", kept)
    changes = spark.createDataFrame([(1, "k5", 50), (2, "new", 7), (3, "k5", 51)], "seq int, k string, v int")
    got = merge.upsert(spark.read.parquet(path), changes, ["k"], "seq", {"v": "v"}, {}, id_col="id")
    assert len(plans) == 1 and plans[0].count("FileScan") == 1 and "/target" in plans[0]
    assert "/target" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.k: (r.id, r.v, r.change) for r in got.collect()}
    assert len(found) == 101 and found["k5"] == (5, 51, "updated") and found["new"] == (100, 7, "inserted")
