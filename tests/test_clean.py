import pytest
from pyspark.sql import functions as F

from homestream.functions.columns import differs, duration_micros, speed_value, status_flag, strict_int, wire_text, wire_time
from homestream.operators import clean


def one(spark, values, dtype, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[1] for r in sorted(df.select("i", expr(F.col("v")).alias("o")).collect())]


def test_strict_int(spark):
    values = [" 3 ", "+7", "3.5", "-0", "", "99999999999", "5\n", "+", None, "12"]
    assert one(spark, values, "string", strict_int) == [None, 7, None, 0, None, None, None, None, None, 12]
    assert one(spark, values, "string", speed_value) == [0, 7, 0, 0, 0, 0, 0, 0, 0, 12]


def test_status_flag(spark):
    assert one(spark, [None, "0", "1", "", "00", "off"], "string", status_flag) == [False, False, True, True, True, True]


def test_differs(spark):
    rows = [("a", "a"), ("a", "b"), (None, "a"), ("a", None), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(differs(F.col("a"), F.col("b"))).collect()] == [False, True, False, False, False]


def test_wire_time(spark):
    values = ["2024-01-02T03:04:05.123456", "2024-01-02T03:04:05.123", "2024-01-02T03:04:05", None, "junk",
              "2024-13-02T03:04:05.123456", "2024-01-02 03:04:05.123456"]
    text = one(spark, values, "string", lambda v: F.date_format(wire_time(v), "HH:mm:ss.SSSSSS"))
    assert text == ["03:04:05.123000"] + [None] * 6
    loose = one(spark, values, "string", lambda v: wire_time(v, lenient=True).isNotNull())
    assert loose == [True, True, True, False, False, False, False]
    assert one(spark, values[:1], "string", lambda v: wire_text(v.cast("timestamp"))) == values[:1]


def test_event_time_modes(spark):
    df = spark.createDataFrame([(1, "2024-01-02T03:04:05.123456"), (2, "junk"), (3, None)], "i int, timestamp string")
    marked = clean.with_event_time(df)
    assert [r.i for r in clean.rejected(marked).collect()] == [2]
    good = {r.i: r.event_ts for r in clean.accepted(marked).collect()}
    assert set(good) == {1, 3} and good[3].year >= 2025
    assert sorted(r.i for r in clean.with_event_time(df, on_error="drop", on_null="null").collect()) == [1, 3]
    with pytest.raises(Exception, match="timestamp"):
        clean.with_event_time(df, on_error="fail").collect()


def test_range(spark):
    values = [0.0, 150.0, 150.1, -0.0, float("nan"), None, -0.1]
    df = spark.createDataFrame([(i, "d", v) for i, v in enumerate(values)], "i int, id_temp string, bbc_temp float")
    assert sorted(r.i for r in clean.clean_sensor(df, "temperature").collect()) == [0, 1, 3]
    marked = clean.clean_sensor(df, "temperature", on_error="quarantine")
    assert [r.i for r in clean.rejected(marked).collect()] == [5]


def test_fan(spark):
    rows = [(1, "f", "3"), (2, None, "3"), (3, "f", None), (4, "f", "-5"), (5, "f", "abc"), (6, "f", "0")]
    df = spark.createDataFrame(rows, "i int, id_fan string, bbc_control_fan string")
    assert sorted(r.i for r in clean.clean_fan(df).collect()) == [1, 6]
    marked = clean.clean_fan(df, "quarantine")
    assert sorted(r.i for r in clean.accepted(marked).collect()) == [1, 6]
    assert [(r.i, r.reject_reason) for r in clean.rejected(marked).collect()] == [(5, "bbc_control_fan")]


def test_durations():
    assert duration_micros("2 minutes") == 120_000_000 and duration_micros("1 second") == 1_000_000
    with pytest.raises(ValueError):
        duration_micros("1 month")
