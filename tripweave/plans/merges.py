"""Table changes: upserts, seeds, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave.operators import changes, merge, packing
from tripweave.operators.keyed import first_per_key, union_all
from tripweave.plans.mapping import RUN_TIME, Tables, portable, run_time, with_tables


def upsert_weather(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks and errors change the snapshots made of all other events. Errors carry NULL
    measures; several changes may meet one trip and hour."""
    t = Tables(spark, folder)
    stored = F.col("source").isin("click", "error")
    target = first_per_key(
        t.snapshots().filter(~stored), ["trip_id", "forecast_time"], [F.col("weather_snapshot_id").asc()]
    ).withColumn("fetched_at", F.lit(None).cast("timestamp_ntz"))
    forecast = t.snapshots().filter(stored).withColumnRenamed("weather_snapshot_id", "seq")
    merged = changes.upsert_weather(target, forecast, "seq", run_time())
    return portable(merged, ("precipitation_probability", "weather_code"))


def upsert_weather_report(spark: SparkSession, folder: str) -> DataFrame:
    return merge.change_report(upsert_weather(spark, folder))


def upsert_docs(spark: SparkSession, folder: str) -> DataFrame:
    """All documents change the table of labelled ones: text and vector are replaced, the
    stored model name stays. Vectors are those of `embeddings`, by id."""
    t = Tables(spark, folder)
    every = t.documents()
    target = every.filter(F.col("embedding").isNotNull()).select(
        F.col("activity_id").alias("document_id"), "activity_id", F.lit("old").alias("document_text"),
        F.array(F.col("embedding").cast("float")).alias("embedding"), F.lit("stored-model").alias("embedding_model"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    vectors = t.raw("embeddings").select(F.col("vec_id").alias("activity_id"), F.col("embedding").alias("vector"))
    fresh = every.select("activity_id", F.md5("document_text").alias("document_text")).join(
        vectors, "activity_id", "left").select(
        "activity_id", "document_text", F.col("vector").alias("embedding"), F.col("activity_id").alias("seq"))
    merged = changes.upsert_documents(target, fresh, "seq", run_time(), model="new-model")
    return portable(merged.withColumns({
        "dimensions": F.when(F.col("embedding").isNotNull(), F.size("embedding")),
        "first_component": F.try_element_at("embedding", F.lit(1)).cast("double")}).drop("embedding"),
        ("dimensions",))


def upsert_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue list over a table that holds three of its five items per trip."""
    t = Tables(spark, folder)
    target = t.packing().filter("item_no <= 3").drop("item_no").withColumn(
        "created_at", F.lit(None).cast("timestamp_ntz"))
    suggestions = packing.catalogue(t.trips(), t.snapshots())
    return portable(changes.upsert_packing(target, suggestions, "item_no", run_time()))


def seed_absent(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as users; every customer and supplier is offered again, twice."""
    t = Tables(spark, folder)
    users = t.raw("customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"),
        F.col("c_mktsegment").alias("display_name"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    offered = t.raw("supplier").select(F.col("s_name").alias("email"), F.col("s_suppkey").alias("n")).unionByName(
        t.raw("customer").select(F.col("c_name").alias("email"), F.col("c_custkey").alias("n")))
    rows = offered.select(
        "email", F.posexplode(F.array(F.lit("first"), F.lit("second"))).alias("seq", "display_name"))
    return portable(changes.seed_users(users, rows, "seq", run_time()))


def seed_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer offers a trip: even ones under a name that is taken, odd ones under a
    new one, suppliers under e-mails that no user has."""
    t = Tables(spark, folder)
    stored = t.trips().withColumns({
        "interests": F.array(F.lit("food")).cast("array<string>"), "created_at": F.lit(None).cast("timestamp_ntz")})
    users = t.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    key = F.col("c_custkey")
    offered = t.raw("customer").select(
        F.col("c_name").alias("email"), key.alias("seq"),
        F.when(key % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("new "), "c_name")).alias("name")).unionByName(
        t.raw("supplier").select(F.col("s_name").alias("email"), F.col("s_suppkey").alias("seq"),
                                 F.concat(F.lit("other "), "s_name").alias("name")))
    rows = offered.withColumns({
        "destination_name": F.lit("Lisbon"), "latitude": F.lit(38.72), "longitude": F.lit(-9.14),
        "interests": F.when(F.col("seq") % 3 == 0, F.array(F.lit("art"), F.lit("music")))})
    seeded = changes.seed_trips(stored, rows, users, "seq", F.to_date(run_time()), run_time())
    return portable(seeded.withColumn("interests", F.size("interests")))


def seed_activities(spark: SparkSession, folder: str) -> DataFrame:
    """Every part is offered again; each third one in upper case, which is a new name. Rain
    limits and the indoor flag are missing in some."""
    t = Tables(spark, folder)
    stored = t.activities().withColumns({
        "max_precipitation_probability": F.lit(50), "created_at": F.lit(None).cast("timestamp_ntz")})
    key = F.col("activity_id")
    rows = t.activities().select(
        key.alias("seq"), "destination_name", "category", "description",
        F.when(key % 3 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"),
        F.when(key % 5 != 0, F.col("indoor")).alias("indoor"),
        F.when(key % 2 == 0, (key % 100).cast("int")).alias("max_precipitation_probability"))
    return portable(changes.seed_activities(stored, rows, "seq", run_time()))


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of one market segment go, with their orders and lines; then parts of large
    size go with their documents, unless a remaining item uses them."""
    t = Tables(spark, folder)
    users = t.raw("customer").withColumnRenamed("c_custkey", "user_id")
    trips = t.raw("orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("user_id"))
    lines = t.raw("lineitem").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("activity_id"))
    left = changes.delete_users(
        users.select("user_id"), trips, {"items": lines},
        users.filter(F.col("c_mktsegment") == "BUILDING"))
    parts = t.raw("part").select(F.col("p_partkey").alias("activity_id"), "p_size")
    documents = t.raw("documents").select("doc_id", F.col("doc_id").alias("activity_id"))
    left |= changes.delete_activities(
        parts.select("activity_id"), documents, left["items"], parts.filter("p_size > 25"))

    def summary(name: str, key: str) -> DataFrame:
        return left[name].agg(F.count("*").alias("rows"), F.sum(key).alias("key_sum")).select(
            F.lit(name).alias("table_name"), "rows", "key_sum")

    named = {"users": "user_id", "trips": "trip_id", "items": "trip_id", "activities": "activity_id",
             "documents": "doc_id", "blocked": "activity_id"}
    return union_all([summary(name, key) for name, key in named.items()])


QUERIES = {f.__name__: f for f in (
    upsert_weather, upsert_weather_report, upsert_docs, upsert_packing, seed_absent, seed_trips, seed_activities,
    cascade_delete)}


def _new_id(order: str, highest: str) -> str:
    """SQL of ids above the stored ones."""
    return f"{highest} + row_number() OVER (ORDER BY {order})"


_WEATHER = with_tables("snapshots", f""",
    target AS (
        SELECT * FROM snapshots WHERE source NOT IN ('click', 'error')
        QUALIFY row_number() OVER (PARTITION BY trip_id, forecast_time ORDER BY weather_snapshot_id) = 1),
    latest AS (
        SELECT * FROM snapshots WHERE source IN ('click', 'error')
        QUALIFY row_number() OVER (PARTITION BY trip_id, forecast_time ORDER BY weather_snapshot_id DESC) = 1),
    fresh AS (
        SELECT l.* FROM latest l LEFT JOIN target t ON t.trip_id = l.trip_id
               AND t.forecast_time = l.forecast_time WHERE t.trip_id IS NULL),
    merged AS (
        SELECT t.weather_snapshot_id, t.trip_id, t.forecast_time,
               CASE WHEN l.trip_id IS NULL THEN t.temperature_c ELSE l.temperature_c END AS temperature_c,
               CASE WHEN l.trip_id IS NULL THEN t.precipitation_probability
                    ELSE l.precipitation_probability END AS precipitation_probability,
               CASE WHEN l.trip_id IS NULL THEN t.weather_code ELSE l.weather_code END AS weather_code,
               CASE WHEN l.trip_id IS NULL THEN t.source ELSE 'Open-Meteo' END AS source,
               CASE WHEN l.trip_id IS NOT NULL THEN TIMESTAMP '{RUN_TIME}' END AS fetched_at,
               CASE WHEN l.trip_id IS NULL THEN 'kept' ELSE 'updated' END AS change
        FROM target t LEFT JOIN latest l ON t.trip_id = l.trip_id AND t.forecast_time = l.forecast_time
        UNION ALL
        SELECT {_new_id("trip_id, forecast_time", "(SELECT max(weather_snapshot_id) FROM target)")},
               trip_id, forecast_time, temperature_c, precipitation_probability, weather_code,
               'Open-Meteo', TIMESTAMP '{RUN_TIME}', 'inserted' FROM fresh)""")

ORACLE = {
    "upsert_weather": _WEATHER + """
        SELECT weather_snapshot_id, trip_id, forecast_time, temperature_c,
               CAST(precipitation_probability AS DOUBLE) AS precipitation_probability,
               CAST(weather_code AS DOUBLE) AS weather_code, source, fetched_at, change FROM merged""",
    "upsert_weather_report": _WEATHER + """
        SELECT change, count(*) AS rows FROM merged WHERE change <> 'kept' GROUP BY change""",
    "upsert_docs": with_tables("docs", f"""
        SELECT activity_id AS document_id, activity_id, md5(document_text) AS document_text,
               'stored-model' AS embedding_model, TIMESTAMP '{RUN_TIME}' AS updated_at, 'updated' AS change,
               CAST(len(e.embedding) AS DOUBLE) AS dimensions, CAST(e.embedding[1] AS DOUBLE) AS first_component
        FROM docs d LEFT JOIN embeddings e ON vec_id = activity_id WHERE d.embedding IS NOT NULL
        UNION ALL
        SELECT {_new_id("activity_id",
                        "(SELECT max(activity_id) FROM docs WHERE embedding IS NOT NULL)")},
               activity_id, md5(document_text), 'new-model', TIMESTAMP '{RUN_TIME}', 'inserted',
               CAST(len(e.embedding) AS DOUBLE), CAST(e.embedding[1] AS DOUBLE)
        FROM docs d LEFT JOIN embeddings e ON vec_id = activity_id WHERE d.embedding IS NULL"""),
    "upsert_packing": with_tables("packing snapshots catalogue", f""",
        w AS (SELECT trip_id, max(coalesce(precipitation_probability, 0)) AS rain FROM snapshots GROUP BY 1),
        suggested AS (
            SELECT p.*, CASE WHEN p.item_name = 'Compact umbrella' THEN c.reason
                        || ' (maximum forecast risk: ' || CAST(coalesce(rain, 0) AS VARCHAR) || '%)'
                        ELSE c.reason END AS new_reason
            FROM packing p JOIN catalogue c ON c.item_name = p.item_name
            LEFT JOIN w ON w.trip_id = p.trip_id)
        SELECT packing_item_id, trip_id, item_name, new_reason AS reason, packed,
               CAST(NULL AS TIMESTAMP) AS created_at, 'updated' AS change
        FROM suggested WHERE item_no <= 3
        UNION ALL
        SELECT {_new_id("trip_id, item_name",
                        "(SELECT max(packing_item_id) FROM packing WHERE item_no <= 3)")},
               trip_id, item_name, new_reason, false, TIMESTAMP '{RUN_TIME}', 'inserted'
        FROM suggested WHERE item_no > 3"""),
    "seed_absent": f"""
        SELECT c_custkey AS user_id, c_name AS email, c_mktsegment AS display_name,
               CAST(NULL AS TIMESTAMP) AS created_at, 'kept' AS change FROM customer
        UNION ALL
        SELECT {_new_id("s_name", "(SELECT max(c_custkey) FROM customer)")},
               s_name, 'first', TIMESTAMP '{RUN_TIME}', 'inserted' FROM supplier""",
    "seed_trips": with_tables("trips", f"""
        SELECT trip_id, user_id, name, destination_name, latitude, longitude, start_date, end_date,
               1 AS interests, CAST(NULL AS TIMESTAMP) AS created_at, 'kept' AS change FROM trips
        UNION ALL
        SELECT {_new_id("name", "(SELECT max(trip_id) FROM trips)")}, c_custkey, name, 'Lisbon', 38.72, -9.14,
               DATE '2024-02-02', DATE '2024-02-04', CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END,
               TIMESTAMP '{RUN_TIME}', 'inserted'
        FROM (SELECT c_custkey, 'new ' || c_name AS name FROM customer WHERE c_custkey % 2 = 1)"""),
    "seed_activities": with_tables("activities", f""",
        offered AS (
            SELECT activity_id AS seq, destination_name, CASE WHEN activity_id % 3 = 0 THEN upper(name) ELSE name END AS name,
                   category, description, CASE WHEN activity_id % 5 <> 0 THEN indoor ELSE false END AS indoor,
                   CASE WHEN activity_id % 2 = 0 THEN CAST(activity_id % 100 AS INTEGER) ELSE 100 END AS rain
            FROM activities),
        fresh AS (
            SELECT * FROM offered o ANTI JOIN activities a USING (destination_name, name)
            QUALIFY row_number() OVER (PARTITION BY destination_name, name ORDER BY seq) = 1)
        SELECT activity_id, destination_name, name, category, indoor, description, 50 AS max_precipitation_probability,
               CAST(NULL AS TIMESTAMP) AS created_at, 'kept' AS change FROM activities
        UNION ALL
        SELECT {_new_id("destination_name, name", "(SELECT max(activity_id) FROM activities)")}, destination_name, name,
               category, indoor, description, rain, TIMESTAMP '{RUN_TIME}', 'inserted' FROM fresh"""),
    "cascade_delete": """
        WITH kept_orders AS (
            SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
            WHERE c_mktsegment <> 'BUILDING'),
        kept_lines AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM kept_orders)),
        used AS (SELECT DISTINCT l_partkey FROM kept_lines),
        gone AS (SELECT p_partkey FROM part WHERE p_size > 25
                 AND p_partkey NOT IN (SELECT l_partkey FROM used))
        SELECT 'users' AS table_name, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS key_sum
        FROM customer WHERE c_mktsegment <> 'BUILDING'
        UNION ALL SELECT 'trips', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM kept_orders
        UNION ALL SELECT 'items', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM kept_lines
        UNION ALL SELECT 'activities', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part
                  WHERE p_partkey NOT IN (SELECT p_partkey FROM gone)
        UNION ALL SELECT 'documents', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents
                  WHERE doc_id NOT IN (SELECT p_partkey FROM gone)
        UNION ALL SELECT 'blocked', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part
                  WHERE p_size > 25 AND p_partkey IN (SELECT l_partkey FROM used)""",
}
