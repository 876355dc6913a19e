import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from homestream.operators import readings

SCHEMA = "id string, value double, name string, password string, timestamp string, event_ts timestamp, seq long"
START = dt.datetime(2024, 1, 1)


def make(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        at = START + dt.timedelta(seconds=rnd.randrange(1200))
        rows.append((rnd.choice(["hot", "hot", "b"]), float(rnd.randrange(100)), f"n{seq}", "p", f"t{seq}", at, seq))
    return rows


def brute(rows, size, slide):
    out = {}
    for r in rows:
        second = (r[5] - START).total_seconds()
        w = second // slide * slide
        while w > second - size:
            out.setdefault((r[0], w), []).append(r)
            w -= slide
    return {k: (sum(r[1] for r in v) / len(v), len(v), min(v, key=lambda r: (r[5], r[6]))[4]) for k, v in out.items()}


@pytest.mark.parametrize("size,slide", [(120, 60), (60, 60), (180, 60), (90, 60)])
def test_windows(spark, size, slide):
    rows = make(300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = readings.sliding_average(df, size=f"{size} seconds", slide=f"{slide} seconds").collect()
    flat = {(r.id, (r.window_start - START).total_seconds()): (r.avg_value, r.readings, r.timestamp) for r in got}
    assert flat == brute(rows, size, slide) and len(flat) == len(got)
    assert all((r.window_end - r.window_start).total_seconds() == size for r in got)


def test_processing_time(spark):
    df = spark.createDataFrame(make(50), SCHEMA)
    got = readings.sliding_average(df, time="processing").collect()
    assert sum(r.readings for r in got) == 100 and {r.id for r in got} == {"hot", "b"}
    assert all(r.window_start.year >= 2025 for r in got)


def test_incomplete_reading(spark):
    schema = "id_hum string, bbc_hum float, bbc_name string, bbc_password string, timestamp string, seq long"
    df = spark.createDataFrame([("h", 20.1, "n", "p", "t", 1), ("h", 20.1, None, "p", "t", 2)], schema)
    got = readings.to_reading(df, "humidity").collect()
    assert [(r.seq, r.value) for r in got] == [(1, 20.100000381469727)]
    docs = readings.average_documents(spark.createDataFrame([(None, None, 1.5, 1)], "id string, timestamp string, avg_value double, window_start int"))
    assert tuple(docs.first())[:4] == ("", "", "", 1.5)


def test_json(spark):
    df = spark.createDataFrame([("a", 1.5, None, "p", "t")], "id string, value double, name string, password string, timestamp string")
    assert readings.reading_json(df).first().json == '{"field0":"a","field1":1.5,"field2":null,"field3":"p","field4":"t"}'


def test_packed_order(spark):
    """One number orders like (ts, seq), nulls first, over the whole range of either."""
    from homestream.functions.columns import packed_order
    times, numbers = [None, "0001-01-01", "1969-12-31 23:59:59.999999", "2024-01-01", "9999-12-31"], [None, -(1 << 63) + 1, -1, 0, 7, (1 << 63) - 1]
    rows = [(t, n, i * 10 + j) for i, t in enumerate(times) for j, n in enumerate(numbers)]
    df = spark.createDataFrame(rows, "t string, n long, want int").withColumn("t", F.col("t").cast("timestamp"))
    got = [r.want for r in df.orderBy(packed_order(F.col("t"), F.col("n"))).select("want").collect()]
    assert got == sorted(got)
    assert df.filter(packed_order(F.col("t"), F.col("n")).isNull()).count() == 0
