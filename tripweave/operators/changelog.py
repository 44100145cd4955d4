"""A batch of mixed requests applied in order, later ones seeing what earlier ones did.

A request has a sequence number, an operation (add, move, cancel, remove) and the item it is about:
a stored one by `itinerary_item_id`, or one that the same batch adds, by `ref`, the sequence number
of that add. What a sequence of requests does to an item depends on few of them: the first removal ends
it, the last move before that sets its time, and any cancellation before that its status. So
each item's requests are reduced by an aggregation that begins in the tasks they lie in; neither
a trip nor an item has to pass through one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripweave import schemas
from tripweave.functions.times import iso_time
from tripweave.operators.keyed import is_small, settle, stored, union_all, with_new_ids

ITEM = "itinerary_item_id"
ADDED = ("trip_id", "activity_id", "scheduled_at", "duration_minutes", "rationale")


def _side(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if is_small(rows) else rows


def _rejects(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.select("seq", reason.alias("reject_reason"))


def _unusable(requests: DataFrame) -> Column:
    """Why a request can't be read, or NULL."""
    timed = F.col("op").isin("add", "move")
    minutes = F.col("duration_minutes")
    return F.when(~F.coalesce(F.col("op").isin("add", "move", "cancel", "remove"), F.lit(False)), schemas.UNKNOWN_OPERATION).when(
        timed & F.col("time").isNull(), schemas.INVALID_TIME).when(
        (F.col("op") == "add") & ~F.coalesce(minutes.between(1, schemas.MAX_DURATION_MINUTES), F.lit(False)), schemas.INVALID_DURATION)


def apply_requests(items: DataFrame, requests: DataFrame, trips: DataFrame, activities: DataFrame, now: Column,
                   highest: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new itinerary items, the ids given to added ones (seq, itinerary_item_id) and the rejects
    (seq, reject_reason).

    requests: seq (unique), op, itinerary_item_id, ref, trip_id, activity_id, raw_time, duration_minutes,
    reason. An add names a trip and an activity that exist, a time, and 1 to 1440 minutes. A move keeps
    the status, a cancellation the time. A request about an item that is not there at its turn is
    rejected: unknown, not added yet, or removed before. Ids follow the highest stored one in order of seq.
    """
    asked = settle(requests.withColumn("time", iso_time(F.col("raw_time"))).withColumn("unusable", _unusable(requests)))
    usable = asked.filter("unusable IS NULL")

    wanted = usable.filter("op = 'add'")
    known_trips, known_activities = trips.select("trip_id", F.lit(True).alias("has_trip")), activities.select(
        "activity_id", F.lit(True).alias("has_activity"))
    placed = settle(wanted.join(_side(known_trips), "trip_id", "left").join(_side(known_activities), "activity_id", "left"))
    added = settle(with_new_ids(
        placed.filter("has_trip AND has_activity").select(
            "seq", "trip_id", "activity_id", F.col("time").alias("scheduled_at"), "duration_minutes",
            F.col("reason").alias("rationale")), items, ITEM, ["seq"], highest))

    # Every other request with the item it is about, NULL where that is added later or never.
    named = usable.filter("op <> 'add'").join(
        _side(added.select(F.col("seq").alias("ref"), F.col(ITEM).alias("added_id"))), "ref", "left").withColumn(
        "about", F.when(F.col("ref").isNull(), F.col(ITEM)).otherwise(F.col("added_id")))
    named = named.join(_side(added.select(F.col(ITEM).alias("about"), F.col("seq").alias("born"))), "about", "left").withColumn(
        "item", F.when(F.col("born").isNull() | (F.col("born") < F.col("seq")), F.col("about")))
    ends = named.filter("op = 'remove' AND item IS NOT NULL").groupBy("item").agg(F.min("seq").alias("gone"))
    named = settle(named.join(_side(settle(ends)), "item", "left"))
    timely = named.filter("item IS NOT NULL AND (gone IS NULL OR seq <= gone)")
    outcome = settle(timely.groupBy("item").agg(
        F.max_by(F.struct("time", "reason"), F.when(F.col("op") == "move", F.col("seq"))).alias("moved"),
        F.max(F.col("op") == "cancel").alias("cancelled"), F.max(F.col("op") == "remove").alias("removed"),
        F.max(F.col("op") == "move").alias("has_move")))

    fresh = added.select(ITEM, *ADDED, F.lit(schemas.STATUSES[0]).alias("status"), now.alias("created_at"))
    layout = [F.col(name).cast(kind).alias(name) if name in fresh.columns else F.lit(None).cast(kind).alias(name)
              for name, kind in items.dtypes]
    every = items.unionByName(fresh.select(*layout))
    hit = every.join(_side(outcome.withColumnRenamed("item", ITEM)), ITEM, "left")
    kinds = dict(items.dtypes)
    changed = {
        "scheduled_at": F.when(F.col("has_move"), F.col("moved.time").cast(kinds["scheduled_at"])).otherwise(F.col("scheduled_at")),
        "rationale": F.when(F.col("has_move"), F.col("moved.reason")).otherwise(F.col("rationale")),
        "status": F.when(F.col("cancelled"), F.lit("cancelled")).otherwise(F.col("status"))}
    result = stored(hit.select(*[changed.get(name, F.col(name)).alias(name) for name in items.columns],
                               F.col("removed").alias("_removed")), "items")
    met = result.filter("_removed IS NOT NULL").select(F.col(ITEM).alias("item"), F.lit(True).alias("there"))

    of_known = named.join(_side(met), "item", "left")
    gone_or_unknown = of_known.filter("there IS NULL OR (gone IS NOT NULL AND seq > gone)")
    rejects = union_all([
        _rejects(asked.filter("unusable IS NOT NULL"), F.col("unusable")),
        _rejects(placed.filter("has_trip IS NULL OR has_activity IS NULL"),
                 F.when(F.col("has_trip").isNull(), schemas.UNKNOWN_TRIP).otherwise(schemas.UNKNOWN_ACTIVITY)),
        _rejects(gone_or_unknown, F.lit(schemas.NO_ITINERARY_ITEM)),
    ])
    kept = result.filter("NOT coalesce(_removed, false)").drop("_removed")
    return kept, added.select("seq", ITEM), rejects
