"""Constraint report and load counts on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripweave.operators import quality
from tripweave.operators.keyed import union_all
from tripweave.plans.mapping import Tables, with_tables

VECTOR_DIM = 64


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    t, checks = Tables(spark, folder), quality.Checks
    return quality.report([
        checks("lineitem", t.raw("lineitem"), "l_orderkey", {
            **quality.not_null(["l_shipdate", "l_quantity"]),
            "l_discount < 0.05": F.col("l_discount") >= 0.05, "l_quantity > 0": F.col("l_quantity") <= 0},
            [["l_orderkey", "l_linenumber"]], [("l_orderkey", "orders", "o_orderkey")]),
        checks("orders", t.raw("orders"), "o_orderkey", {
            **quality.fits_decimal(["o_totalprice"]), "o_orderstatus": ~F.col("o_orderstatus").isin("O", "P")},
            [["o_orderkey"]], [("o_custkey", "customer", "c_custkey")]),
        checks("documents", t.raw("documents"), unique=[["doc_id"]], foreign=[("doc_id", "labels", "doc_id")]),
        checks("labels", t.raw("labels")),
        checks("part", t.raw("part"), unique=[["p_name"]]),
        checks("events", t.raw("events"), "event_id", quality.not_null(["ts", "value"])),
        checks("customer", t.raw("customer"), foreign=[("c_nationkey", "nation", "n_nationkey")]),
        checks("supplier", t.raw("supplier"), foreign=[("s_nationkey", "nation", "n_nationkey")]),
        checks("nation", t.raw("nation"), foreign=[("n_regionkey", "region", "r_regionkey")]),
        checks("region", t.raw("region")),
        checks("pages", t.raw("pages"), unique=[["url"]]),
        checks("conversations", t.raw("conversations"), unique=[["conv_id", "turn"]]),
        checks("benchmark", t.raw("benchmark"), "item_id", quality.not_null(["text"])),
        checks("embeddings", t.raw("embeddings"), "vec_id", quality.vector_size("embedding", VECTOR_DIM)),
    ])


def load_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return quality.load_counts(t.snapshots(), t.documents())


def load_check(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots and documents with a vector; reading the result fails when one has no rows."""
    t = Tables(spark, folder)
    stored = {"weather_snapshots": (t.snapshots(), "weather snapshots"),
              "activity_documents": (t.documents().filter("embedding IS NOT NULL"), "activity embeddings")}
    return union_all([quality.require_rows(rows, what).withColumn("table_name", F.lit(name))
                      for name, (rows, what) in stored.items()])


QUERIES = {f.__name__: f for f in (quality_report, load_counts, load_check)}


def _unique(table: str, keys: list[str], key_text: str) -> str:
    listed = ", ".join(keys)
    return f"""SELECT '{table}' AS table_name, 'unique({listed})' AS rule,
        CAST(coalesce(sum(n), 0) AS BIGINT) AS bad_rows, min({key_text}) AS sample_key
        FROM (SELECT {listed}, count(*) AS n FROM {table} GROUP BY {listed} HAVING count(*) > 1)"""


def _parent(table: str, column: str, parent: str, key: str) -> str:
    return f"""SELECT '{table}', 'foreign_key({column})', count(*), CAST(min(c.{column}) AS VARCHAR)
        FROM {table} c LEFT JOIN {parent} p ON p.{key} = c.{column} WHERE p.{key} IS NULL"""


def _rows(table: str, rule: str, key: str, bad: str) -> str:
    return f"""SELECT '{table}', '{rule}', count(*), CAST(min({key}) AS VARCHAR) FROM {table} WHERE {bad}"""


ORACLE = {
    "quality_report": " UNION ALL ".join([
        _unique("lineitem", ["l_orderkey", "l_linenumber"],
                "CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)"),
        _unique("orders", ["o_orderkey"], "CAST(o_orderkey AS VARCHAR)"),
        _unique("documents", ["doc_id"], "CAST(doc_id AS VARCHAR)"),
        _unique("part", ["p_name"], "p_name"),
        _parent("lineitem", "l_orderkey", "orders", "o_orderkey"),
        _parent("orders", "o_custkey", "customer", "c_custkey"),
        _parent("documents", "doc_id", "labels", "doc_id"),
        _rows("lineitem", "not_null(l_shipdate)", "l_orderkey", "l_shipdate IS NULL"),
        _rows("lineitem", "not_null(l_quantity)", "l_orderkey", "l_quantity IS NULL"),
        _rows("lineitem", "l_discount < 0.05", "l_orderkey", "l_discount >= 0.05"),
        _rows("lineitem", "l_quantity > 0", "l_orderkey", "l_quantity <= 0"),
        _rows("orders", "numeric(o_totalprice)", "o_orderkey", "TRY_CAST(o_totalprice AS DECIMAL(5,2)) IS NULL"),
        _rows("orders", "o_orderstatus", "o_orderkey", "o_orderstatus NOT IN ('O', 'P')"),
        _rows("events", "not_null(ts)", "event_id", "ts IS NULL"),
        _rows("events", "not_null(value)", "event_id", "value IS NULL"),
        _parent("customer", "c_nationkey", "nation", "n_nationkey"),
        _parent("supplier", "s_nationkey", "nation", "n_nationkey"),
        _parent("nation", "n_regionkey", "region", "r_regionkey"),
        _unique("pages", ["url"], "url"),
        _unique("conversations", ["conv_id", "turn"], "CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)"),
        _rows("benchmark", "not_null(text)", "item_id", "text IS NULL"),
        _rows("embeddings", "dimension(embedding)", "vec_id", "len(embedding) <> 64"),
    ]),
    "load_counts": with_tables("snapshots docs", """
        SELECT trip_id, count(*) AS weather_rows,
               (SELECT count(embedding) FROM docs) AS embedded_documents
        FROM snapshots GROUP BY trip_id"""),
    "load_check": """
        SELECT count(*) AS rows, 'weather_snapshots' AS table_name FROM events
        UNION ALL SELECT count(quality), 'activity_documents' FROM documents JOIN labels USING (doc_id)""",
}
