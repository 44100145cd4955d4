"""Places and articles: geocoding payloads, pages, deduplication, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave import schemas
from tripweave.operators import matching, silver as silver_ops, views
from tripweave.plans.mapping import Tables, with_tables
from tripweave.sources import payloads


def _places(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A geocoding payload per customer: no hit for every tenth, one without coordinates for
    the next, two hits for the others; some without time zone."""
    nations = t.raw("nation").join(
        F.broadcast(t.raw("region").withColumnRenamed("r_regionkey", "n_regionkey")), "n_regionkey")
    people = t.raw("customer").join(
        F.broadcast(nations.withColumnRenamed("n_nationkey", "c_nationkey")), "c_nationkey")
    kind = F.col("c_custkey") % 10
    hit = F.struct(
        F.col("n_name").alias("name"), F.col("r_name").alias("country"),
        F.when(kind != 1, (F.col("c_custkey") % 90).cast("double")).alias("latitude"),
        F.when(kind != 1, (F.col("c_custkey") % 180).cast("double")).alias("longitude"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.lit("UTC")).alias("timezone"))
    second = F.struct(
        F.lit("SECOND").alias("name"), F.lit("NOWHERE").alias("country"), F.lit(0.0).alias("latitude"),
        F.lit(0.0).alias("longitude"), F.lit("UTC").alias("timezone"))
    results = F.when(kind == 0, F.slice(F.array(hit), 1, 0)).otherwise(F.array(hit, second))
    landed = people.select("c_custkey", F.concat("n_name", F.lit(" "), F.col("c_custkey").cast("string")).alias("requested"),
                           F.to_json(F.struct(results.alias("results"))).alias("payload"))
    return payloads.resolve_places(landed, "requested", "payload")


def geocode_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return _places(Tables(spark, folder))[0]


def geocode_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _places(Tables(spark, folder))[1]


def trip_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return views.first_trips(Tables(spark, folder).trips())


def _landed_articles(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pages as article payloads and back; title, text or url is missing in some, every
    seventh payload is cut off and every eleventh has no page."""
    key = F.col("page_id")
    page = F.struct(
        F.when(key % 4 != 0, F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.when(key % 6 != 0, F.col("html")).alias("extract"),
        F.when(key % 5 != 0, F.col("url")).alias("fullurl"))
    pages = F.map_filter(F.create_map(key.cast("string"), page), lambda k, v: key % 11 != 0)
    text = F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query")))
    landed = t.raw("pages").select(
        "page_id", F.concat(F.lit("page "), key.cast("string")).alias("requested_title"),
        F.when(key % 7 == 0, F.substring(text, 1, 15)).otherwise(text).alias("payload"))
    return payloads.article_rows(landed, "requested_title", "payload")


def article_payloads(spark: SparkSession, folder: str) -> DataFrame:
    return _landed_articles(Tables(spark, folder))[0]


def article_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _landed_articles(Tables(spark, folder))[1]


def page_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = payloads.html_articles(Tables(spark, folder).raw("pages"), "page_id", "url", "html").withColumns({
        "text_length": F.length("text"), "text_md5": F.md5("text")})
    return silver_ops.distinct_articles(pages, "page_id").select(
        "page_id", "title", "text_length", "text_md5", "source_url")


def doc_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    documents = Tables(spark, folder).raw("documents").withColumn("text_length", F.length("text"))
    return silver_ops.distinct_articles(documents, "doc_id", title="text").select(
        "doc_id", "lang", "source", "text_length")


def _articles(t: Tables) -> DataFrame:
    """Documents as articles about the part of the same key, in other letter case. Every
    third one names a neighbouring destination, where the activity may not exist, and German
    ones name the brand, which is no activity."""
    nations = F.broadcast(t.raw("nation").select(
        F.col("n_nationkey").alias("_nation"), F.col("n_name").alias("destination_name")))
    names = t.raw("part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand")
    named = F.when(F.col("lang") == "de", F.col("p_brand")).otherwise(F.upper("p_name"))
    shift = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return t.raw("documents").join(names, "doc_id").select(
        "doc_id", "text", named.alias("activity_name"),
        ((F.col("doc_id") + shift) % 25).cast("int").alias("_nation"),
    ).join(nations, "_nation").drop("_nation")


def match_enrich(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return matching.match_articles(_articles(t), t.activities()).select(
        "doc_id", "activity_id", F.length("document_text").alias("text_length"),
        F.md5("document_text").alias("text_md5"))


def match_rejects(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return matching.unmatched_articles(_articles(t), t.activities()).select(
        "doc_id", "destination_name", "activity_name")


QUERIES = {f.__name__: f for f in (
    geocode_resolve, geocode_rejects, trip_resolve, article_payloads, article_rejects, page_extract, doc_dedupe,
    match_enrich, match_rejects)}

_PAGE_TEXT = r"""trim(regexp_replace(regexp_replace(
    regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""

_MATCH = """
    articles AS (
        SELECT d.doc_id, text, CASE WHEN lang = 'de' THEN p_brand ELSE upper(p_name) END AS activity_name,
               n_name AS destination_name
        FROM documents d JOIN part ON p_partkey = d.doc_id
        JOIN nation ON n_nationkey = (d.doc_id + CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END) % 25),
    found AS (
        SELECT a.doc_id, min(v.activity_id) AS activity_id
        FROM articles a JOIN activities v ON lower(v.destination_name) = lower(a.destination_name)
             AND lower(v.name) = lower(a.activity_name)
        GROUP BY a.doc_id)"""

ORACLE = {
    "geocode_resolve": """
        SELECT c_custkey, n_name || ' ' || CAST(c_custkey AS VARCHAR) AS requested, n_name AS name,
               r_name AS country, CAST(c_custkey % 90 AS DOUBLE) AS latitude,
               CAST(c_custkey % 180 AS DOUBLE) AS longitude,
               CASE WHEN c_mktsegment <> 'BUILDING' THEN 'UTC' END AS timezone
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
        WHERE c_custkey % 10 NOT IN (0, 1)""",
    "geocode_rejects": """
        SELECT c_custkey, n_name || ' ' || CAST(c_custkey AS VARCHAR) AS requested,
               CASE WHEN c_custkey % 10 = 1 THEN 'Incomplete result'
                    ELSE 'Destination not found: ' || n_name || ' ' || CAST(c_custkey AS VARCHAR)
               END AS reject_reason
        FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 10 IN (0, 1)""",
    "trip_resolve": with_tables("trips", """
        SELECT lower(destination_name) AS place, min(trip_id) AS trip_id FROM trips GROUP BY 1"""),
    "article_payloads": """
        SELECT page_id, 'page ' || CAST(page_id AS VARCHAR) AS requested_title,
               CASE WHEN page_id % 4 <> 0 THEN regexp_extract(html, '(?s)<title>(.*?)</title>', 1)
                    ELSE 'page ' || CAST(page_id AS VARCHAR) END AS title,
               CASE WHEN page_id % 6 <> 0 THEN html ELSE '' END AS text,
               CASE WHEN page_id % 5 <> 0 THEN url END AS source_url
        FROM pages WHERE page_id % 7 <> 0 AND page_id % 11 <> 0""",
    "article_rejects": f"""
        SELECT page_id, 'page ' || CAST(page_id AS VARCHAR) AS requested_title,
               '{schemas.INCOMPLETE_ARTICLE}' AS reject_reason
        FROM pages WHERE page_id % 7 = 0 OR page_id % 11 = 0""",
    "page_extract": f"""
        WITH rows AS (SELECT page_id, url, {_PAGE_TEXT} AS text,
                             regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)
        SELECT page_id, title, length(text) AS text_length, md5(text) AS text_md5, url AS source_url
        FROM rows WHERE page_id IN (SELECT min(page_id) FROM rows WHERE length(text) > 100 GROUP BY title)""",
    "doc_dedupe": """
        SELECT doc_id, lang, source, length(text) AS text_length FROM documents
        WHERE doc_id IN (SELECT min(doc_id) FROM documents WHERE length(text) > 100 GROUP BY text)""",
    "match_enrich": with_tables("activities", f""", {_MATCH},
        texts AS (
            SELECT a.doc_id, f.activity_id, v.name || '. Category: ' || v.category || '. '
                   || v.description || chr(10) || chr(10) || a.text AS document_text
            FROM articles a JOIN found f ON f.doc_id = a.doc_id
            JOIN activities v ON v.activity_id = f.activity_id)
        SELECT doc_id, activity_id, length(document_text) AS text_length, md5(document_text) AS text_md5
        FROM texts"""),
    "match_rejects": with_tables("activities", f""", {_MATCH}
        SELECT doc_id, destination_name, activity_name FROM articles
        WHERE doc_id NOT IN (SELECT doc_id FROM found)"""),
}
