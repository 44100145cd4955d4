"""Shapes of the physical plans, as they would be for tables too large to broadcast."""

import re

import pytest

from tripweave.operators import merge, textsearch
from tripweave.plans.registry import QUERIES
from tripweave.sources import tables

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name, **conf):
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def large(spark, name):
    return plan_of(spark, name, **{"spark.sql.autoBroadcastJoinThreshold": "-1"})


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_and_no_window_over_everything(spark, name):
    plan = large(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.splitlines()
    for n, line in enumerate(lines):
        if "Window [" in line:
            assert "SinglePartition" not in " ".join(lines[n + 1:n + 4]), line


@pytest.mark.parametrize("name", ["weather_preview", "itinerary_generate", "match_enrich", "semantic_topk"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in large(spark, name)


@pytest.mark.parametrize("name", ["weather_silver", "weather_rejects", "geocode_resolve", "article_payloads", "rows_json"])
def test_row_work_does_not_shuffle(spark, name):
    assert not re.search(r"(?<!Broadcast)Exchange ", large(spark, name))


@pytest.mark.parametrize("name,columns", [
    ("weather_summary", "value:double,props:string"), ("activity_flags", "doc_id:bigint"),
    ("doc_dedupe", "doc_id:bigint,text:string")])
def test_only_used_columns_are_read(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", large(spark, name))
    assert any(columns in s for s in schemas), schemas
    assert all("n_chars" not in s for s in schemas)


def test_filters_reach_the_scan(spark):
    plan = large(spark, "doc_dedupe")
    assert "PushedFilters: [IsNotNull(text)" in plan
    assert "DataFilters: [isnotnull(text#" in plan


@pytest.mark.parametrize("name,key", [
    ("itinerary_move", "itinerary_item_id"), ("itinerary_cancel", "itinerary_item_id"),
    ("itinerary_remove", "itinerary_item_id"), ("packing_set", "packing_item_id"),
    ("upsert_weather", "trip_id"), ("upsert_packing", "trip_id")])
def test_few_changes_do_not_shuffle_the_target(spark, monkeypatch, name, key):
    monkeypatch.setattr(merge, "stored", lambda rows, kind: rows)  # the merge itself, not its stored result
    assert f"BroadcastHashJoin [{key}#" in large(spark, name)


def test_texts_are_not_shuffled_by_keyword_search(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    queries = spark.createDataFrame([(1, "castle -tower"), (2, '"old town"')], "query_id long, q string")
    hits = textsearch.word_hits(documents, textsearch.search_terms(queries), "doc_id", "text", few=True)
    scored = textsearch.rank(hits, "doc_id", together=True)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    generate = plan.index("Generate posexplode(concat(")
    assert "Exchange" not in plan[generate:].split("FileScan")[0]
    assert not re.search(r"(?<!Broadcast)Exchange ", plan[:generate].split("BroadcastHashJoin")[0])
    assert "MapInArrow" in plan[:generate] and plan.count("FileScan") == 1


@pytest.mark.parametrize("name,key", [("semantic_topk", "label"), ("semantic_topk_batch", "destination_name")])
def test_vectors_are_not_shuffled_by_cosine_search(spark, name, key):
    plan = large(spark, name)
    assert re.search(rf"BroadcastHashJoin \[{key}", plan)
    assert not re.search(r"(?<!Broadcast)Exchange [^\n]*\n[^\n]*embedding", plan)


def test_only_touched_months_are_listed(spark, tmp_path):
    spark.createDataFrame([(1, "2026-01"), (2, "2026-02")], "id int, m string").write.partitionBy("m").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    part = tables.touched_partitions(table, spark.createDataFrame([("2026-02",)], "m string"), ("m",))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*m#\d+ = 2026-02", plan)
    assert [r.id for r in part.collect()] == [2]


def test_few_repeated_texts_and_names_do_not_move_the_texts(spark):
    for name in ("doc_dedupe", "match_enrich"):
        assert "BroadcastHashJoin" in large(spark, name) and "SortMergeJoin [_" not in large(spark, name)


def test_the_report_reads_every_table_once_and_shuffles_once(spark):
    plan = large(spark, "quality_report")
    scans = re.findall(r"FileScan parquet .*?Location: [^\[]*\[[^\]]*/(\w+)\.parquet", plan)
    assert len(scans) == len(set(scans)) == 14
    assert len(re.findall(r"hashpartitioning\(place#\d+, num", plan)) == 1
