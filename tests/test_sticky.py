import random

import pytest
from pyspark.sql import functions as F

from homestream.operators import sticky
from tests import folds

SCHEMA = "id string, f string, g string, h string, seq long, value double"


def made(n, seed, nulls=0.3, keys="kkkq"):
    r = random.Random(seed)
    value = lambda letters: None if r.random() < nulls else r.choice(letters)
    return [(r.choice(keys), value("ab"), value("xyz"), value("p"), i, i / 2) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("event_ts", F.timestamp_seconds(F.col("seq") + 1704067200))


def want(rows, watch):
    return [r["seq"] for r in folds.changes([dict(zip(("id", "f", "g", "h", "seq"), r)) for r in rows], "id", watch)]


@pytest.mark.parametrize("width", ["1 second", "7 seconds", "50 seconds", "1 hour"])
@pytest.mark.parametrize("watch", [["f"], ["f", "g"], ["f", "g", "h"]])
def test_equals_the_fold(spark, width, watch):
    for seed, nulls in ((1, 0.3), (2, 0.8), (3, 0.0)):
        rows = made(250, seed, nulls)
        kept, _ = sticky.sticky_changes(frame(spark, rows).repartition(3), "id", watch, chunk=width)
        assert kept.columns == frame(spark, rows[:0]).columns
        assert sorted(r.seq for r in kept.collect()) == want(rows, watch)


def test_state_goes_on(spark):
    """Batches one after the other, each from the state of the one before, keep what the whole does."""
    rows, state, kept = made(300, 5, 0.4, "kq"), None, []
    for lo in range(0, 300, 75):
        out, after = sticky.sticky_changes(frame(spark, rows[lo:lo + 75]), "id", ["f", "g"], chunk="9 seconds", state=state)
        kept += [r.seq for r in out.collect()]
        state = spark.createDataFrame(after.collect(), after.schema)
    assert sorted(kept) == want(rows, ["f", "g"])
    last = {r["id"]: (r["f"], r["g"]) for r in folds.changes([dict(zip(("id", "f", "g", "h", "seq"), r)) for r in rows], "id", ["f", "g"])}
    assert {r.id: (r.f, r.g) for r in state.collect()} == last


def test_edges(spark):
    empty = frame(spark, [])
    kept, after = sticky.sticky_changes(empty, "id", ["f", "g"])
    assert kept.count() == after.count() == 0
    state = spark.createDataFrame([("old", "a", None), (None, "a", "b")], "id string, f string, g string")
    kept, after = sticky.sticky_changes(empty, "id", ["f", "g"], state=state)
    assert kept.count() == 0 and [tuple(r) for r in after.collect()] == [("old", "a", None)]
    kept, _ = sticky.sticky_changes(frame(spark, [(None, "a", "b", "c", 1, 0.0)] * 3), "id", ["f"])
    assert kept.count() == 0


def test_rows_are_read_and_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    frame(spark, made(100, 1)).write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, _ = sticky.sticky_changes(spark.read.parquet(path), "id", ["f", "g"])
        kept.collect()
        final = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_entries():
    r = random.Random(8)
    for _ in range(300):
        rows = [tuple(r.choice([None, "a", "b"]) for _ in range(2)) for _ in range(r.randint(1, 12))]
        places = sticky.entries_of(rows)
        masks, ends = sticky.follow(rows, places)
        firsts = [None if p is None else rows[p][i] for i, p in enumerate(places[1::2])]
        for state in [None, *[(a, b) for a in (None, "a", "b", "c") for b in (None, "a", "b", "c")]]:
            s, kept = state, []
            for i, row in enumerate(rows):
                if s is None or sticky._hit(s, row):
                    s, kept = row, [*kept, i]
            e = sticky.chosen(state, firsts, places)
            assert kept == ([] if e is None else [i for i, m in enumerate(masks) if m >> e & 1])
            assert s == (state if e is None else rows[ends[e]])


def test_chunks_across_batches(spark):
    """Chunks that go on in the next Arrow batch, and several in one, are the same chunks."""
    rows, old = made(300, 11), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            kept, _ = sticky.sticky_changes(frame(spark, rows), "id", ["f", "g"], chunk="5 seconds")
            assert sorted(r.seq for r in kept.collect()) == want(rows, ["f", "g"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_entries_are_not_broadcast(spark):
    """There is one for each key and chunk, so what goes by way of the driver would grow with the time covered."""
    kept, _ = sticky.sticky_changes(frame(spark, made(100, 1)), "id", ["f", "g"], chunk="5 seconds")
    kept.collect()
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
