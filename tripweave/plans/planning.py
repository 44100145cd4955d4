"""Itinerary and packing: generate, add, move, cancel, remove, tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave import schemas
from tripweave.operators import changes, itinerary, keyed, packing, views
from tripweave.operators.merge import CHANGE
from tripweave.plans.mapping import PREFERRED, RUN_TIME, Tables, portable, run_time, with_tables

# The driver tables' readings lie higher and colder than a real forecast.
RULES = (
    (*schemas.PACKING_RULES[0][:2], None, None),
    (*schemas.PACKING_RULES[1][:2], 99, None),
    (*schemas.PACKING_RULES[2][:2], None, 2),
)


def itinerary_generate(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return itinerary.generate(t.trips(), t.activities(), t.items(), preferred=PREFERRED)


def itinerary_append(spark: SparkSession, folder: str) -> DataFrame:
    """The itinerary table with the generated items, which get ids above the stored ones."""
    t = Tables(spark, folder)
    new = itinerary.generate(t.trips(), t.activities(), t.items(), preferred=PREFERRED)
    return portable(itinerary.append_items(t.items(), new, ["trip_id", "activity_id"], run_time()))


def request_integers(spark: SparkSession, folder: str) -> DataFrame:
    """Ids as callers send them, as text: errors send a word as trip, clicks a fraction as
    activity. One row per request with the ids, or with the reason for which it is rejected."""
    kind = F.col("event_type")
    sent = Tables(spark, folder).raw("events").select(
        F.col("event_id").alias("request_id"),
        F.when(kind == "error", "abc").otherwise(F.col("user_id").cast("string")).alias("trip_id"),
        F.when(kind == "click", "1.5").otherwise(F.col("event_id").cast("string")).alias("activity_id"))
    good, bad = keyed.integer_columns(sent, ["trip_id", "activity_id"])
    return good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(
        bad.withColumns({c: F.lit(None).cast("bigint") for c in ("trip_id", "activity_id")}))


def _auto_requests(t: Tables) -> DataFrame:
    """Every event asks for an activity: odd ones for one at the trip's destination, even
    ones for any, some of which do not exist."""
    nation = t.raw("customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    key = F.col("event_id")
    wanted = F.when(key % 2 == 1, F.col("c_nationkey") + 25 * (key % 7)).otherwise(key)
    return t.raw("events").join(nation, "user_id").select(
        key.alias("request_id"), F.col("user_id").alias("trip_id"),
        wanted.cast("bigint").alias("activity_id"))


def itinerary_add_auto(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return itinerary.add_auto(_auto_requests(t), t.trips(), t.activities(), t.items())


def itinerary_add_auto_rejects(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    requests = _auto_requests(t)
    added = itinerary.add_auto(requests, t.trips(), t.activities(), t.items())
    return itinerary.not_added(requests, added)


def _timed_requests(t: Tables) -> DataFrame:
    """Every event asks for a time slot. Views write the time with Z, clicks with an offset,
    errors write no time; durations run from 0 to over a day; some trips and activities are
    unknown; sign-ups leave the rationale out."""
    kind = F.col("event_type")
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    time = F.when(kind == "view", F.concat(plain, F.lit("Z"))).when(
        kind == "click", F.concat(plain, F.lit("+02:00"))).when(kind == "error", "soon").otherwise(plain)
    k = F.get_json_object("props", "$.k").cast("int")
    return t.raw("events").select(
        F.col("event_id").alias("request_id"),
        F.when(k == 7, -1).otherwise(F.col("user_id")).alias("trip_id"),
        F.when(k == 8, -1).otherwise(F.floor(F.col("event_id") / 8)).cast("bigint").alias("activity_id"),
        time.alias("scheduled_at"), (k * 16).alias("duration_minutes"),
        F.when(kind != "signup", kind).alias("rationale"))


def itinerary_add_checked(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return portable(itinerary.add_checked(_timed_requests(t), t.trips(), t.activities())[0])


def itinerary_add_rejects(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return itinerary.add_checked(_timed_requests(t), t.trips(), t.activities())[1]


def _item_requests(t: Tables) -> DataFrame:
    """Every event names an order: many are stored, some are not, some are named again."""
    return t.raw("events").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") == "click", -F.col("event_id") - 1)
        .otherwise(F.col("user_id") * 7).alias("itinerary_item_id"),
        F.when(F.col("event_type") == "error", "later").otherwise(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("new_time"),
        F.col("event_type").alias("reason"))


def itinerary_move(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    moved, _ = changes.move_items(
        t.items(), _item_requests(t), "itinerary_item_id", "request_id", "new_time", "reason")
    return portable(moved)


def itinerary_move_rejects(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return changes.move_items(
        t.items(), _item_requests(t), "itinerary_item_id", "request_id", "new_time", "reason")[1]


def itinerary_cancel(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return changes.cancel_items(t.items(), _item_requests(t), "itinerary_item_id", "request_id")[0]


def itinerary_remove(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return changes.remove_items(t.items(), _item_requests(t), "itinerary_item_id")[0]


def itinerary_removed(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    removed = changes.remove_items(t.items(), _item_requests(t), "itinerary_item_id")[1]
    return removed.select("itinerary_item_id", "trip_id", "activity_id")


def packing_set(spark: SparkSession, folder: str) -> DataFrame:
    """Events tick (even k) or untick (odd k) packing items; errors send something else."""
    t = Tables(spark, folder)
    k = F.get_json_object("props", "$.k").cast("int")
    requests = t.raw("events").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") * 5 + k % 7).alias("packing_item_id"),
        F.when(F.col("event_type") == "error", "maybe").otherwise((k % 2 == 0).cast("string")).alias("packed"))
    return changes.set_packed(
        t.packing().drop("item_no"), requests, "packing_item_id", "request_id")[0]


def packing_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return packing.catalogue(t.trips(), t.snapshots())


def packing_rules_list(spark: SparkSession, folder: str) -> DataFrame:
    """Rules with their own limits over readings scaled to a real forecast, merged into a table
    that holds two of five catalogue items, and listed."""
    t = Tables(spark, folder)
    forecast = t.snapshots().withColumns({
        "precipitation_probability": F.floor(F.col("precipitation_probability") / 2).cast("int"),
        "temperature_c": F.col("temperature_c") + 13})
    stored = t.packing().filter("item_no IN (2, 4)").drop("item_no").withColumn(
        "created_at", F.lit(None).cast("timestamp_ntz"))
    suggested = packing.rules(t.trips(), forecast)
    merged = changes.upsert_packing(stored, suggested, "item_no", run_time())
    return portable(views.packing_list(merged.drop(CHANGE)))


def packing_rules(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return packing.rules(t.trips(), t.snapshots(), RULES)


QUERIES = {f.__name__: f for f in (
    itinerary_generate, itinerary_append, request_integers, itinerary_add_auto, itinerary_add_auto_rejects, itinerary_add_checked,
    itinerary_add_rejects, itinerary_move, itinerary_move_rejects, itinerary_cancel,
    itinerary_remove, itinerary_removed, packing_set, packing_catalogue, packing_rules,
    packing_rules_list)}

# At most six activities per destination, ranked once; a trip takes those it has not planned yet.
_PLAN = f""",
    best AS (
        SELECT lower(destination_name) AS place, activity_id, indoor,
               row_number() OVER (PARTITION BY lower(destination_name)
                                  ORDER BY indoor, category NOT IN ('PROMO', 'SMALL', 'LARGE'), activity_id) AS slot
        FROM activities QUALIFY slot <= 6),
    hours(slot, after) AS (VALUES (1, 10), (2, 15), (3, 34), (4, 39), (5, 58), (6, 63)),
    planned AS (SELECT DISTINCT trip_id, activity_id FROM items WHERE status IN ('planned', 'completed')),
    generated AS (
        SELECT trip_id, activity_id, CAST(start_date AS TIMESTAMP) + to_hours(after) AS scheduled_at,
               120 AS duration_minutes,
               if(indoor, '{schemas.INDOOR_RATIONALE}', '{schemas.OUTDOOR_RATIONALE}') AS rationale, 'planned' AS status
        FROM trips JOIN best ON place = lower(destination_name) JOIN hours USING (slot)
        ANTI JOIN planned USING (trip_id, activity_id))"""

_AUTO = f""",
    requests AS (
        SELECT event_id AS request_id, user_id AS trip_id,
               CASE WHEN event_id % 2 = 1 THEN c_nationkey + 25 * (event_id % 7)
                    ELSE event_id END AS activity_id
        FROM events JOIN customer ON c_custkey = user_id),
    planned AS (SELECT DISTINCT trip_id, activity_id FROM items WHERE status IN ('planned', 'completed')),
    first_requests AS (
        SELECT trip_id, activity_id, min(request_id) AS request_id
        FROM requests ANTI JOIN planned USING (trip_id, activity_id) GROUP BY ALL),
    fitting AS (
        SELECT f.*, t.start_date, row_number() OVER (PARTITION BY trip_id ORDER BY request_id) - 1 AS place
        FROM first_requests f JOIN trips t USING (trip_id) JOIN activities a USING (activity_id)
        WHERE lower(a.destination_name) = lower(t.destination_name)),
    last_items AS (SELECT trip_id, max(scheduled_at) AS last_time FROM items GROUP BY trip_id),
    added AS (
        SELECT request_id, trip_id, activity_id,
               if(last_time IS NULL, start_date + INTERVAL 10 HOUR, last_time + INTERVAL 3 HOUR) + to_hours(3 * place)
                   AS scheduled_at,
               120 AS duration_minutes, '{schemas.DISCOVERY_RATIONALE}' AS rationale, 'planned' AS status
        FROM fitting LEFT JOIN last_items USING (trip_id))"""

_CHECKED = f""",
    k AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events),
    checked AS (
        SELECT event_id AS request_id, trip_id, activity_id,
               CASE event_type WHEN 'error' THEN NULL
                    WHEN 'click' THEN date_trunc('second', ts) - INTERVAL 2 HOUR
                    ELSE date_trunc('second', ts) END AS scheduled_at,
               k * 16 AS duration_minutes,
               CASE event_type WHEN 'signup' THEN '{schemas.AGENT_RATIONALE}' ELSE event_type END AS rationale,
               CASE WHEN event_type = 'error' THEN 'Invalid time'
                    WHEN k * 16 NOT BETWEEN 1 AND 1440 THEN 'duration_minutes must be between 1 and 1440'
                    WHEN trip_id NOT IN (SELECT trip_id FROM trips) THEN 'Unknown trip'
                    WHEN activity_id NOT IN (SELECT activity_id FROM activities) THEN 'Unknown activity'
               END AS reject_reason
        FROM (SELECT *, CASE WHEN k = 7 THEN -1 ELSE user_id END AS trip_id,
                     CASE WHEN k = 8 THEN -1 ELSE event_id // 8 END AS activity_id FROM k))"""

_ITEM_REQUESTS = """,
    requests AS (
        SELECT event_id AS request_id, event_type,
               CASE WHEN event_type = 'click' THEN -event_id - 1 ELSE user_id * 7 END AS item,
               date_trunc('second', ts) AS new_time
        FROM events),
    latest AS (
        SELECT * FROM requests WHERE event_type <> 'error'
        QUALIFY row_number() OVER (PARTITION BY item ORDER BY request_id DESC) = 1)"""

_ITEM_ROWS = "SELECT itinerary_item_id, trip_id, activity_id, scheduled_at, duration_minutes, rationale, status"

ORACLE = {
    "itinerary_generate": with_tables("trips activities items", _PLAN + " SELECT * FROM generated"),
    "itinerary_append": with_tables("trips activities items", _PLAN + """
        SELECT * FROM items UNION ALL BY NAME
        SELECT (SELECT max(itinerary_item_id) FROM items) + row_number() OVER (ORDER BY trip_id, activity_id)
               AS itinerary_item_id, * FROM generated"""),
    "request_integers": f"""
        SELECT event_id AS request_id,
               CASE WHEN event_type NOT IN ('error', 'click') THEN user_id END AS trip_id,
               CASE WHEN event_type NOT IN ('error', 'click') THEN event_id END AS activity_id,
               CASE event_type WHEN 'error' THEN '{schemas.NOT_A_NUMBER % "trip_id"}'
                               WHEN 'click' THEN '{schemas.NOT_A_NUMBER % "activity_id"}' END AS reject_reason
        FROM events""",
    "itinerary_add_auto": with_tables("trips activities items", _AUTO + " SELECT * FROM added"),
    "itinerary_add_auto_rejects": with_tables("trips activities items", _AUTO + """
        SELECT request_id, 'Trip or activity not found' AS reject_reason FROM requests
        WHERE request_id NOT IN (SELECT request_id FROM added)"""),
    "itinerary_add_checked": with_tables("trips activities", _CHECKED + """
        SELECT request_id, trip_id, activity_id, scheduled_at, duration_minutes, rationale,
               'planned' AS status FROM checked WHERE reject_reason IS NULL"""),
    "itinerary_add_rejects": with_tables("trips activities", _CHECKED + """
        SELECT request_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL"""),
    "itinerary_move": with_tables("items", _ITEM_REQUESTS + f"""
        {_ITEM_ROWS.replace('scheduled_at', 'coalesce(new_time, scheduled_at) AS scheduled_at')
                   .replace('rationale', 'coalesce(event_type, rationale) AS rationale')},
               CASE WHEN request_id IS NULL THEN 'kept' ELSE 'updated' END AS {CHANGE}
        FROM items LEFT JOIN latest ON item = itinerary_item_id"""),
    "itinerary_move_rejects": with_tables("items", _ITEM_REQUESTS + """
        SELECT item AS itinerary_item_id, request_id, 'Invalid time' AS reject_reason
        FROM requests WHERE event_type = 'error'
        UNION ALL
        SELECT item, request_id, 'Itinerary item ' || CAST(item AS VARCHAR) || ' does not exist'
        FROM latest WHERE item NOT IN (SELECT itinerary_item_id FROM items)"""),
    "itinerary_cancel": with_tables("items", _ITEM_REQUESTS + f"""
        SELECT itinerary_item_id, trip_id, activity_id, scheduled_at, duration_minutes, rationale,
               CASE WHEN item IS NULL THEN status ELSE 'cancelled' END AS status,
               CASE WHEN item IS NULL THEN 'kept' ELSE 'updated' END AS {CHANGE}
        FROM items LEFT JOIN (SELECT DISTINCT item FROM requests) ON item = itinerary_item_id"""),
    "itinerary_remove": with_tables("items", _ITEM_REQUESTS + f"""
        {_ITEM_ROWS} FROM items WHERE itinerary_item_id NOT IN (SELECT item FROM requests)"""),
    "itinerary_removed": with_tables("items", _ITEM_REQUESTS + """
        SELECT itinerary_item_id, trip_id, activity_id FROM items
        WHERE itinerary_item_id IN (SELECT item FROM requests)"""),
    "packing_set": with_tables("packing", f""",
        k AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events),
        latest AS (
            SELECT user_id * 5 + k % 7 AS item, k % 2 = 0 AS flag FROM k WHERE event_type <> 'error'
            QUALIFY row_number() OVER (PARTITION BY user_id * 5 + k % 7 ORDER BY event_id DESC) = 1)
        SELECT packing_item_id, trip_id, item_name, reason, coalesce(flag, packed) AS packed,
               CASE WHEN item IS NULL THEN 'kept' ELSE 'updated' END AS {CHANGE}
        FROM packing LEFT JOIN latest ON item = packing_item_id"""),
    "packing_catalogue": with_tables("trips snapshots catalogue", """
        SELECT t.trip_id, item_no, item_name,
               CASE WHEN item_name = 'Compact umbrella' THEN reason || ' (maximum forecast risk: '
                    || CAST(coalesce(rain, 0) AS VARCHAR) || '%)' ELSE reason END AS reason
        FROM trips t CROSS JOIN catalogue LEFT JOIN (
            SELECT trip_id, max(coalesce(precipitation_probability, 0)) AS rain
            FROM snapshots GROUP BY 1) w ON w.trip_id = t.trip_id"""),
    "packing_rules": with_tables("trips snapshots", f""",
        w AS (SELECT trip_id, max(precipitation_probability) AS rain, min(temperature_c) AS cold
              FROM snapshots GROUP BY 1)
        SELECT trip_id, 1 AS item_no, '{RULES[0][0]}' AS item_name, '{RULES[0][1]}' AS reason FROM trips
        UNION ALL SELECT trip_id, 2, '{RULES[1][0]}', '{RULES[1][1]}' FROM w WHERE rain >= 99
        UNION ALL SELECT trip_id, 3, '{RULES[2][0]}', '{RULES[2][1]}' FROM w WHERE cold < 2"""),
    "packing_rules_list": with_tables("trips snapshots packing", f""",
        w AS (SELECT trip_id, max(precipitation_probability // 2) AS rain, min(temperature_c + 13) AS cold
              FROM snapshots GROUP BY 1),
        due AS (
            SELECT trip_id, n, item_name, reason FROM trips LEFT JOIN w USING (trip_id)
            JOIN (VALUES (1, '{schemas.PACKING_RULES[0][0]}', '{schemas.PACKING_RULES[0][1]}'),
                         (2, '{schemas.PACKING_RULES[1][0]}', '{schemas.PACKING_RULES[1][1]}'),
                         (3, '{schemas.PACKING_RULES[2][0]}', '{schemas.PACKING_RULES[2][1]}')) r(n, item_name, reason)
              ON n = 1 OR n = 2 AND rain >= 40 OR n = 3 AND cold < 15),
        stored AS (SELECT * FROM packing WHERE item_no IN (2, 4))
        SELECT packing_item_id, trip_id, item_name, coalesce(d.reason, s.reason) AS reason, packed,
               CAST(NULL AS TIMESTAMP) AS created_at
        FROM stored s LEFT JOIN due d USING (trip_id, item_name)
        UNION ALL
        SELECT (SELECT max(packing_item_id) FROM stored) + row_number() OVER (ORDER BY trip_id, item_name),
               trip_id, item_name, reason, false, TIMESTAMP '{RUN_TIME}'
        FROM due ANTI JOIN stored USING (trip_id, item_name)"""),
}
