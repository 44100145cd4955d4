"""A log of mixed itinerary requests on the driver tables: every order is a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave import schemas
from tripweave.operators import changelog
from tripweave.plans.mapping import RUN_TIME, Tables, portable, run_time, with_tables


def _requests(t: Tables) -> DataFrame:
    """Adds, moves, cancellations and removals in order of the order key. Eight neighbouring requests are
    about one item; some name the add a few places before, one that comes later, or none that there is."""
    key = F.col("o_orderkey")
    op = F.element_at(F.array(*[F.lit(x) for x in ("add", "move", "cancel", "move", "remove", "move", "skip")]), (key % 7 + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.raw("orders").select(
        key.alias("seq"), op.alias("op"), (key - key % 8 + 1).alias("itinerary_item_id"),
        F.when(key % 5 == 0, key - key % 7 + F.when(key % 35 == 0, 7).otherwise(0)).alias("ref"),
        (F.col("o_custkey") + F.when(key % 21 == 0, 10**9).otherwise(0)).alias("trip_id"),
        (key % 2500 + 1).alias("activity_id"),
        F.when(key % 11 == 0, "soon").otherwise(F.concat(day, F.lit("T09:30:00"))).alias("raw_time"),
        (key % 1501).cast("int").alias("duration_minutes"), F.col("o_orderpriority").alias("reason"))


def _applied(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = Tables(spark, folder)
    items = t.items().withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    return changelog.apply_requests(items, _requests(t), t.trips(), t.activities(), run_time())


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """The itinerary items after all requests."""
    return portable(_applied(spark, folder)[0])


def change_log_added(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of the items that the requests added."""
    return _applied(spark, folder)[1]


def change_log_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _applied(spark, folder)[2]


QUERIES = {f.__name__: f for f in (change_log, change_log_added, change_log_rejects)}

_LOG = f""",
    asked AS (
        SELECT o_orderkey AS seq,
               ['add', 'move', 'cancel', 'move', 'remove', 'move', 'skip'][CAST(o_orderkey % 7 + 1 AS INTEGER)] AS op,
               o_orderkey - o_orderkey % 8 + 1 AS named,
               CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - o_orderkey % 7
                    + CASE WHEN o_orderkey % 35 = 0 THEN 7 ELSE 0 END END AS ref,
               o_custkey + CASE WHEN o_orderkey % 21 = 0 THEN 1000000000 ELSE 0 END AS trip,
               o_orderkey % 2500 + 1 AS activity,
               CASE WHEN o_orderkey % 11 <> 0 THEN CAST(strftime(o_orderdate, '%Y-%m-%d') || ' 09:30:00' AS TIMESTAMP) END AS time,
               CAST(o_orderkey % 1501 AS INTEGER) AS minutes, o_orderpriority AS reason FROM orders),
    judged AS (
        SELECT *, CASE WHEN op = 'skip' THEN '{schemas.UNKNOWN_OPERATION}'
                       WHEN op IN ('add', 'move') AND time IS NULL THEN '{schemas.INVALID_TIME}'
                       WHEN op = 'add' AND minutes NOT BETWEEN 1 AND 1440 THEN '{schemas.INVALID_DURATION}'
                       WHEN op = 'add' AND trip NOT IN (SELECT trip_id FROM trips) THEN '{schemas.UNKNOWN_TRIP}'
                       WHEN op = 'add' AND activity NOT IN (SELECT activity_id FROM activities) THEN '{schemas.UNKNOWN_ACTIVITY}'
                  END AS problem FROM asked),
    added AS (
        SELECT *, (SELECT max(itinerary_item_id) FROM items) + row_number() OVER (ORDER BY seq) AS id
        FROM judged WHERE op = 'add' AND problem IS NULL),
    every AS (
        SELECT itinerary_item_id, trip_id, activity_id, scheduled_at, duration_minutes, rationale, status,
               CAST(NULL AS TIMESTAMP) AS created_at FROM items
        UNION ALL SELECT id, trip, activity, time, minutes, reason, 'planned', TIMESTAMP '{RUN_TIME}' FROM added),
    about AS (
        SELECT j.*, CASE WHEN j.ref IS NULL THEN j.named WHEN j.ref < j.seq THEN a.id END AS item
        FROM judged j LEFT JOIN added a ON a.seq = j.ref WHERE j.op <> 'add' AND j.problem IS NULL),
    timed AS (
        SELECT a.*, min(CASE WHEN op = 'remove' THEN seq END) OVER (PARTITION BY item) AS gone,
               item IS NOT NULL AND item IN (SELECT itinerary_item_id FROM every) AS there FROM about a),
    done AS (
        SELECT item, arg_max(time, seq) FILTER (op = 'move') AS time, arg_max(reason, seq) FILTER (op = 'move') AS reason,
               bool_or(op = 'move') AS moved, bool_or(op = 'cancel') AS cancelled, bool_or(op = 'remove') AS removed
        FROM timed WHERE there AND (gone IS NULL OR seq <= gone) GROUP BY item)"""

ORACLE = {
    "change_log": with_tables("items trips activities", _LOG + """
        SELECT itinerary_item_id, trip_id, activity_id,
               CASE WHEN moved THEN d.time ELSE scheduled_at END AS scheduled_at, duration_minutes,
               CASE WHEN moved THEN d.reason ELSE rationale END AS rationale,
               CASE WHEN cancelled THEN 'cancelled' ELSE status END AS status, created_at
        FROM every LEFT JOIN done d ON d.item = itinerary_item_id WHERE NOT coalesce(removed, false)"""),
    "change_log_added": with_tables("items trips activities", _LOG + " SELECT seq, id AS itinerary_item_id FROM added"),
    "change_log_rejects": with_tables("items trips activities", _LOG + f"""
        SELECT seq, problem AS reject_reason FROM judged WHERE problem IS NOT NULL
        UNION ALL SELECT seq, '{schemas.NO_ITINERARY_ITEM}' FROM timed WHERE NOT there OR seq > gone"""),
}
