"""What the physical plans must look like: pushdown, pruning, few exchanges, no whole key in one task."""

import re

import pytest

from homestream.operators import frames, match, readings
from homestream.operators.changes import changes_only, device_changes
from homestream.operators.clean import clean_device
from homestream.plans import queries, views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Plans as they are when no side is small enough to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("kind,null_mode", [("led", "sticky"), ("fan", "sticky"), ("door", "sticky"), ("door", "ignore")])
def test_change_detection_reads_and_shuffles_rows_once(spark, kind, null_mode):
    df = device_changes(clean_device(views.DEVICES[kind](spark, SF), kind), kind, null_mode=null_mode)
    df = df.select("seq")         # a narrow consumer doesn't tell the branches apart
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    # rows once, summaries by key, carries back to their chunk; the summaries' rows are the first exchange again
    assert len(re.findall(r"- Exchange hashpartitioning", final)) == 3 and final.count("ReusedExchange") == 1
    assert final.count("FileScan") == 1


def test_one_exchange_without_chunks(spark):
    df = changes_only(clean_device(views.door(spark, SF), "door"), "id_door", ["bbc_servo"], "bbc_password", chunk=None)
    assert len(exchanges(df)) == 1


def test_confirmation_reuses_its_exchange(spark):
    rows = views.table(spark, SF, "events").selectExpr(
        "user_id as session", "event_id as frame_no", "event_type as name", "value / 100 as confidence")
    df = frames.confirm_runs(rows, chunk=100)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_scan_is_pruned_and_filters_reach_it(spark):
    df = queries.latest_per_feed(spark, SF)
    schema = re.search(r"ReadSchema: (\S+)", plan(df)).group(1)
    assert "props" not in schema
    text = plan(clean_device(spark.read.schema("id_led string, bbc_led string").parquet(SF + "/events.parquet"), "led"))
    assert "PushedFilters: [IsNotNull(id_led)]" in text


def test_windows_group_by_time_too(spark):
    df = readings.sliding_average(readings.to_reading(clean_device(views.temperature(spark, SF), "temperature"), "temperature"))
    assert all("window_start" in e or "grouping" in e or "pane" in e for e in exchanges(df))
    assert len(exchanges(df)) == 2 and "partial_sum" in plan(df)


def test_matching_needs_no_cross_join(spark):
    small = match.nearest_match(views.probes(spark, SF), views.gallery(spark, SF))
    assert "Exchange" not in plan(small)
    large = match.nearest_match(views.probes(spark, SF), views.gallery(spark, SF), broadcast_bytes=0)
    for df in (small, large):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_commands_parse_once(spark):
    df = queries.route_commands(spark, SF)
    assert plan(df).count("regexp_extract") == 1


def test_expressions_stay_in_the_jvm(spark):
    for name in ("fan_changes", "door_changes_ignore_nulls", "fan_state", "temp_window_avg", "confirm_runs",
                 "parse_commands", "latest_per_feed", "carry_forward", "event_time_parse"):
        assert not re.search(r"InArrow|InPandas|PythonUDF", plan(queries.QUERIES[name](spark, SF))), name


def test_latest_value_is_hashed(spark):
    """A fixed-width value with a fixed-width order needs no sort before the shuffle."""
    text = plan(queries.latest_per_feed(spark, SF))
    assert "SortAggregate" not in text and " Sort " not in text


def test_document_index_reads_its_input_once(spark):
    df = queries.temperature_docs_last_wins(spark, SF)
    df.collect()
    assert plan(df).split("== Initial Plan ==")[0].count("FileScan") == 1
