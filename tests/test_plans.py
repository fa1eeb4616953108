"""Physical plans are the ones meant: what reaches the scan, what shuffles, what is broadcast, where Python runs."""

import re

import pytest

from pagemill.plans.driver_queries import QUERIES


def plan(spark, sf, name):
    df = QUERIES[name](spark, sf)
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


PYTHON = {"pipeline_end_to_end", "read_pdf_pages", "batch_read", "recognise_pages"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_python_runs_only_where_pages_are_recognised(name, spark, sf):
    text = plan(spark, sf, name)
    assert bool(re.search("MapInArrow|ArrowEval|BatchEval|Pandas", text)) == (name in PYTHON)
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["pipeline_end_to_end", "page_explode", "page_counts", "read_pdf_pages", "page_select_int", "page_select_list", "recognise_pages", "clean_ocr_text", "task_projection", "export_json", "export_csv", "catalog_lookup", "doctor_rules", "rest_route", "http_route", "sse_frames", "log_increment"])
def test_row_wise_queries_do_not_shuffle(name, spark, sf):
    text = plan(spark, sf, name)
    assert not re.search(r"\bExchange\b", text)


@pytest.mark.parametrize(("name", "read"), [("page_counts", {"doc_id", "text"}), ("output_names", {"doc_id", "lang", "source"}), ("status_counts", {"event_type"}), ("disk_usage", {"source", "text"}), ("doctor_rules", {"p_partkey", "p_size"}), ("latest_status", {"ts", "event_id", "user_id", "event_type"})])
def test_scans_read_only_what_is_used(name, read, spark, sf):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, sf, name))
    assert schemas and all({f.split(":")[0] for f in s.split(",")} <= read for s in schemas)


@pytest.mark.parametrize(("name", "pushed"), [("log_increment", "GreaterThan(event_id,500)"), ("union_sources", "EqualTo(lang,en)")])
def test_filters_reach_the_scan(name, pushed, spark, sf):
    assert pushed in plan(spark, sf, name)


@pytest.mark.parametrize("name", ["log_tail", "latest_tasks", "catalog_default"])
def test_top_k_is_one_operator(name, spark, sf):
    assert "TakeOrderedAndProject" in plan(spark, sf, name)


@pytest.mark.parametrize("name", ["catalog_lookup", "doctor_rules", "prompt_resolution", "dependency_report"])
def test_only_literals_are_broadcast(name, spark, sf):
    text = plan(spark, sf, name)
    assert re.search("Broadcast(Hash|NestedLoop)Join", text) and "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["status_counts", "disk_usage", "manifest_summary", "output_collisions", "latest_status"])
def test_aggregates_combine_before_the_shuffle(name, spark, sf):
    assert "partial_" in plan(spark, sf, name)
