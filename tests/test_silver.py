"""Labels, times, deduplication, tables and export."""

import datetime as dt
import decimal
import json

import pytest
from pyspark.sql import functions as F

from tripweave import schemas
from tripweave.functions.labels import weather_label
from tripweave.functions.numbers import clamp, percent_half_even
from tripweave.functions.times import iso_text, iso_time, slot_time
from tripweave.operators import silver
from tripweave.session import shuffle_partitions
from tripweave.sources import export, tables

def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")



@pytest.mark.parametrize("code,label", [
    (None, "other"), (0, "clear"), (1, "cloudy"), (3, "cloudy"), (4, "other"), (50, "other"),
    (51, "rain"), (67, "rain"), (68, "other")])
def test_weather_label(spark, code, label):
    frame = spark.createDataFrame([(code,)], "code int")
    assert frame.select(weather_label(F.col("code"))).first()[0] == label


def test_silver_keeps_rows_with_unreadable_times(spark, rows):
    raw = spark.createDataFrame(
        [("2024-05-01T10:00", 1.0, 10, 0), ("nonsense", 2.0, None, None)], schemas.BRONZE_WEATHER[:4])
    bronze = silver.bronze(raw, now())
    got = silver.silver(bronze, F.lit("Lisbon"))
    assert set(got.columns) == set(schemas.SILVER_WEATHER.fieldNames())
    assert rows(got, "forecast_time", "weather_label", "destination_name") == [
        (None, "other", "Lisbon"), (dt.datetime(2024, 5, 1, 10), "clear", "Lisbon")]
    assert rows(silver.unreadable_times(bronze), "forecast_time_raw") == [("nonsense",)]


def test_bronze_and_silver_share_one_ingest_time(spark, tmp_path):
    raw = spark.createDataFrame([("2024-05-01T10:00", 1.0, 10, 0)], schemas.BRONZE_WEATHER[:4])
    tables.overwrite_table(silver.bronze(raw, now()), str(tmp_path / "bronze"))
    stored = spark.read.parquet(str(tmp_path / "bronze"))
    tables.overwrite_table(silver.silver(stored, F.lit("Lisbon")), str(tmp_path / "silver"))
    again = spark.read.parquet(str(tmp_path / "silver"))
    assert again.first()["ingested_at"] == stored.first()["ingested_at"] == dt.datetime(2024, 1, 1)


def test_summary(spark, rows):
    frame = spark.createDataFrame([("rain", 1.0), ("rain", 1.5), ("rain", None), ("clear", None)],
                                  "weather_label string, temperature_c double")
    assert rows(silver.label_summary(frame)) == [("clear", 1, None), ("rain", 3, 1.3)]


def test_articles_need_more_than_the_limit_and_the_lowest_id_wins(spark, rows):
    long, short = "x" * 101, "x" * 100
    frame = spark.createDataFrame(
        [(3, "a", long), (2, "a", long + "y"), (1, "a", short), (4, "b", short), (5, None, long), (6, None, long),
         (7, "", long)], "id long, title string, text string")
    assert rows(silver.distinct_articles(frame, "id"), "id") == [(2,), (5,), (7,)]


@pytest.mark.parametrize("raw,expected", [
    ("2026-08-10T14:00:00", dt.datetime(2026, 8, 10, 14)), ("2026-08-10T14:00:00Z", dt.datetime(2026, 8, 10, 14)),
    ("2026-08-10T14:00:00+02:00", dt.datetime(2026, 8, 10, 12)), ("2026-08-10T14:00", dt.datetime(2026, 8, 10, 14)),
    ("2026-08-10", dt.datetime(2026, 8, 10)), ("2026-08-10T14", dt.datetime(2026, 8, 10, 14)),
    ("2026", None), ("soon", None), ("2026-13-10T14:00:00", None), (None, None)])
def test_iso_time(spark, raw, expected):
    frame = spark.createDataFrame([(raw,)], "raw string")
    assert frame.select(iso_time(F.col("raw"))).first()[0] == expected


def test_slots_go_two_per_day(spark):
    frame = spark.range(1, 7).withColumn("d", F.lit("2026-08-10").cast("date"))
    got = [r[0] for r in frame.orderBy("id").select(slot_time(F.col("d"), F.col("id"))).collect()]
    assert got == [dt.datetime(2026, 8, 10 + i // 2, (10, 15)[i % 2]) for i in range(6)]


@pytest.mark.parametrize("part,whole,percent", [(1, 8, 12), (3, 8, 38), (2, 5, 40), (0, 0, 0), (5, 5, 100)])
def test_percent_is_half_even(spark, part, whole, percent):
    assert spark.range(1).select(percent_half_even(F.lit(part), F.lit(whole))).first()[0] == percent


@pytest.mark.parametrize("n,limit", [(0, 1), (1, 1), (10, 10), (11, 10), (-3, 1)])
def test_clamp(spark, n, limit):
    assert spark.range(1).select(clamp(F.lit(n), 1, 10)).first()[0] == limit


def test_create_if_absent_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "users")
    assert tables.create_if_absent(spark, path, schemas.USERS).count() == 0
    user = [(1, "a@b", "A", dt.datetime(2024, 1, 1))]
    tables.overwrite_table(tables.typed_rows(spark, user, schemas.USERS), path)
    assert tables.create_if_absent(spark, path, schemas.USERS).count() == 1


def test_only_touched_partitions_are_rewritten(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    start = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id int, part string, v int")
    tables.overwrite_table(start, path, ("part",))
    untouched = sorted(p.name for p in (tmp_path / "t" / "part=a").iterdir())
    table = spark.read.parquet(path)
    changes = spark.createDataFrame([("b",), ("c",)], "part string")
    new = tables.touched_partitions(table, changes, ("part",)).withColumn("v", F.col("v") * 10)
    tables.overwrite_touched(new, path, ("part",))
    assert rows(spark.read.parquet(path), "id", "part", "v") == [(1, "a", 1), (2, "b", 20), (3, "c", 30)]
    assert sorted(p.name for p in (tmp_path / "t" / "part=a").iterdir()) == untouched


def test_shuffle_partitions_follow_the_input():
    assert shuffle_partitions(1, 8) == 16
    assert shuffle_partitions(100 * 2**40, 4000) == 819_200


def test_defaults_fill_missing_values(spark, rows):
    frame = spark.createDataFrame([(1, None), (2, "done")], "id int, status string")
    assert rows(tables.with_defaults(frame, {"status": "planned", "duration": 120})) == [
        (1, "planned", 120), (2, "done", 120)]


def test_json_rows(spark):
    frame = spark.createDataFrame(
        [(1, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 600), decimal.Decimal("1.50"), None)],
        "a int, d date, t timestamp, n decimal(5,2), s string")
    assert json.loads(export.rows_to_json(frame).first()[0]) == {
        "a": 1, "d": "2024-01-02", "t": "2024-01-02T03:04:05.000600", "n": 1.5, "s": None}
    plain = spark.range(1).select(iso_text(F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))).first()[0]
    assert plain == "2024-01-02T03:04:05"
