import random

import pytest
from pyspark.sql import functions as F

from homestream.operators import aggregate, readings

SCHEMA = "id string, value double, name string, password string, timestamp string, seq long, at long"


def frame(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, r.randint(0, 40) / 2]), f"n{i}", "p", f"t{i:04d}", i, r.randint(0, 900)) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("event_ts", F.timestamp_seconds(F.col("at") + 1704067200)).drop("at")


@pytest.mark.parametrize("size,slide", [("2 minutes", "1 minute"), ("1 minute", "1 minute"), ("5 minutes", "1 minute")])
def test_average_equals_the_built_in(spark, size, slide, monkeypatch):
    _, df = frame(spark)
    got = aggregate.sliding_aggregate(df.repartition(5), aggregate.average(), size=size, slide=slide)
    want = readings.sliding_average(df, size=size, slide=slide)
    columns = ["id", "window_start", "window_end", "avg_value", "readings", "name", "password", "timestamp"]
    assert got.columns == columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(columns).collect()))


def test_payload_of_the_first_reading_over_batches(spark):
    """Partial accumulators hold readings in order, whatever the order of Arrow batches."""
    _, df = frame(spark, 300, 3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = aggregate.sliding_aggregate(df.repartition(2), aggregate.average()).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = readings.sliding_average(df).collect()
    pick = lambda rows: sorted((str(r.id), r.window_start, r.name, r.readings, r.avg_value) for r in rows)
    assert pick(got) == pick(want)


def test_own_aggregate_and_edges(spark):
    """A set of values, which no built-in partial sum could hold."""
    distinct = aggregate.Aggregate(create=frozenset, add=lambda a, r: a | {r["value"]}, merge=lambda a, b: a | b,
                                   result=lambda a: {"values": sorted(x for x in a if x is not None)}, schema="values array<double>")
    rows, df = frame(spark)
    got = {(r.id, int(r.window_start.timestamp()) - 1704067200): r["values"] for r in aggregate.sliding_aggregate(df, distinct, size="3 minutes").collect()}
    want = {}
    for i, v, *_, at in rows:
        for k in range(3):
            want.setdefault((i, at // 60 * 60 - 60 * k), set()).add(v)
    assert got == {k: sorted(x for x in v if x is not None) for k, v in want.items()}
    assert aggregate.sliding_aggregate(df.limit(0), distinct).count() == 0
    assert aggregate.sliding_aggregate(df.withColumn("event_ts", F.lit(None).cast("timestamp")), distinct).count() == 0
    with pytest.raises(ValueError):
        aggregate.sliding_aggregate(df, distinct, size="90 seconds", slide="1 minute")
