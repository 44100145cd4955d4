"""The daily load: landed payloads to Bronze, Silver, snapshots and embedded documents.

Nothing passes through the driver between source and table. Tables are Parquet folders under
one warehouse folder; snapshots are partitioned by forecast month, so a load rewrites only
the months it brings; documents in buckets, of which it rewrites those it changes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tripweave import schemas
from tripweave.operators import changelog, changes, matching, quality, silver as silver_ops, vectors, views
from tripweave.operators.keyed import is_small, settle
from tripweave.operators.merge import settled
from tripweave.sources import payloads, tables

MONTH = "forecast_month"
BUCKET = "document_bucket"
BUCKETS = 64
PARTITIONS = {"weather_snapshots": T.StructField(MONTH, T.StringType()),
              "activity_documents": T.StructField(BUCKET, T.IntegerType())}


def _stored_schema(name: str) -> T.StructType:
    extra = [PARTITIONS[name]] if name in PARTITIONS else []
    return T.StructType([*schemas.TABLES[name].fields, *extra])


def _bucket() -> Column:
    return F.pmod(F.hash("activity_id"), F.lit(BUCKETS)).alias(BUCKET)


class Warehouse:
    """Travel tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in schemas.TABLES:
            reader = reader.schema(_stored_schema(name))
        return reader.parquet(self.path(name))

    def create(self) -> None:
        """All tables, empty where there are none yet."""
        for name in schemas.TABLES:
            partition_by = (PARTITIONS[name].name,) if name in PARTITIONS else ()
            tables.create_if_absent(self.spark, self.path(name), _stored_schema(name), partition_by)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Overwrite a table whose new rows come from its old ones."""
        tables.overwrite_table(settle(rows), self.path(name))


def load_weather(warehouse: Warehouse, landed: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Hourly payloads (payload_id, destination_name, payload) to Bronze, Silver and snapshots.

    A destination's forecast goes to its first trip; of two rows for one hour the later one
    counts, by payload id and place in the payload. Returns the label summary, payloads that
    cannot be used, rows with an unreadable time and destinations without a trip.
    """
    raw, unusable = payloads.hourly_rows(landed, "payload", position="position")
    tables.overwrite_table(silver_ops.bronze(raw, now), warehouse.path("bronze_weather"))
    stored = warehouse.read("bronze_weather")
    tables.overwrite_table(
        silver_ops.silver(stored, F.col("destination_name")), warehouse.path("silver_weather"))
    silver = warehouse.read("silver_weather")

    trips = views.first_trips(warehouse.read("trips"))
    place = silver.withColumn("place", F.lower("destination_name"))
    forecast = place.filter(F.col("forecast_time").isNotNull()).join(trips, "place").select(
        "trip_id", "forecast_time", "temperature_c", "precipitation_probability", "weather_code",
        F.struct("payload_id", "position").alias("seq"),
        F.date_format("forecast_time", "yyyy-MM").alias(MONTH))
    forecast = settle(forecast)
    whole = warehouse.read("weather_snapshots")
    touched = tables.touched_partitions(whole, forecast, (MONTH,))
    merged = settled(changes.upsert_weather(touched, forecast, "seq", now, whole_table=whole))
    tables.overwrite_touched(
        merged.withColumn(MONTH, F.date_format("forecast_time", "yyyy-MM")),
        warehouse.path("weather_snapshots"), (MONTH,))
    return {
        "summary": silver_ops.label_summary(silver),
        "unusable_payloads": unusable,
        "unreadable": silver_ops.unreadable_times(stored),
        "without_trip": place.select("place", "destination_name").distinct().join(
            trips, "place", "left_anti").select("destination_name"),
    }


def load_articles(warehouse: Warehouse, landed: DataFrame, titles: DataFrame, now: Column,
                  encode: Callable[[list[str]], np.ndarray] | None = None,
                  model: str | None = None) -> dict[str, DataFrame]:
    """Article payloads (article_id, destination_name, requested_title, payload) to embedded
    documents. `titles` maps requested titles to activity names. Returns payloads that cannot
    be used, articles whose title is not mapped and articles whose activity does not exist.

    `model` names the model that `encode` is; vectors without one are stored as hashed words.
    Documents lie in buckets by activity, and only the buckets of this load are read and written.
    """
    if (encode is None) != (model is None):
        raise ValueError("a model and its name come together")
    articles, unusable = payloads.article_rows(landed, "requested_title", "payload")
    known = titles.select(F.col("title").alias("requested_title"), "activity_name").withColumn("_mapped", F.lit(True))
    asked = articles.join(F.broadcast(known) if is_small(known) else known, "requested_title", "left")
    named = asked.filter("_mapped").drop("_mapped")
    distinct = silver_ops.distinct_articles(named, "article_id")
    activities = warehouse.read("activities")
    matched = matching.match_articles(distinct, activities)
    embedded = settle(vectors.embed(matched, "document_text", ["article_id", "activity_id", "document_text"], encode=encode))
    whole = warehouse.read("activity_documents")
    touched = tables.touched_partitions(whole, embedded.select(_bucket()), (BUCKET,))
    merged = settled(changes.upsert_documents(
        touched, embedded, "article_id", now, model or schemas.HASHED_MODEL, whole_table=whole))
    tables.overwrite_touched(
        merged.withColumn(BUCKET, _bucket()), warehouse.path("activity_documents"), (BUCKET,))
    return {"unusable_articles": unusable, "unmapped": asked.filter("_mapped IS NULL").select("article_id", "requested_title"),
            "unmatched": matching.unmatched_articles(distinct.drop("text"), activities)}


def apply_requests(warehouse: Warehouse, requests: DataFrame, now: Column) -> dict[str, DataFrame]:
    """A batch of mixed itinerary requests (see `changelog.apply_requests`) to the stored items. Returns
    the ids of added items and the rejects; both are settled, so they don't change with the table."""
    items, added, rejects = changelog.apply_requests(
        warehouse.read("itinerary_items"), requests, warehouse.read("trips"), warehouse.read("activities"), now)
    rejects = settle(rejects)
    warehouse.replace("itinerary_items", items)
    return {"added": added, "rejects": rejects}


def check_load(warehouse: Warehouse) -> DataFrame:
    """Stored snapshots and embedded documents; reading the result fails when there are none."""
    snapshots = quality.require_rows(warehouse.read("weather_snapshots"), "weather snapshots")
    documents = quality.require_rows(
        warehouse.read("activity_documents").filter(F.col("embedding").isNotNull()), "activity embeddings")
    return snapshots.withColumn("table_name", F.lit("weather_snapshots")).unionByName(
        documents.withColumn("table_name", F.lit("activity_documents")))
