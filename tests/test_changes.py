import random

import pytest
from pyspark.sql import functions as F

from homestream.operators.changes import changes_only, with_last_change
from homestream.operators.timeline import carry_forward, number_rows
from tests import folds

SCHEMA = "id string, c string, f string, ts long, seq long"


def make(seed, keys=12, n=900, hot=0.4):
    """Random histories; one key owns a large share; equal times are settled by seq."""
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        key = "hot" if rnd.random() < hot else f"k{rnd.randrange(keys)}"
        rows.append((key, rnd.choice("ab"), rnd.choice(["x", "y", None]), rnd.randrange(n // 2), seq))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("ts", F.timestamp_seconds("ts"))


def ordered(rows):
    return [dict(zip(("id", "c", "f", "ts", "seq"), r)) for r in sorted(rows, key=lambda r: (r[3], r[4]))]


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


@pytest.mark.parametrize("chunk", [None, "1 second", "7 seconds", "1 minute", "1 day"])
@pytest.mark.parametrize("steady,nullable", [((), "f"), (("c",), "f"), (("c",), None)])
def test_fold(spark, chunk, steady, nullable):
    for seed in (1, 2):
        rows = make(seed)
        watch = [*steady, *([nullable] if nullable else [])]
        want = sorted(r["seq"] for r in folds.changes(ordered(rows), "id", watch))
        got = changes_only(frame(spark, rows), "id", steady, nullable, ("ts", "seq"), chunk=chunk)
        assert seqs(got) == want
        assert got.columns == ["id", "c", "f", "ts", "seq"]


@pytest.mark.parametrize("chunk", [None, "5 seconds"])
def test_fold_ignoring_nulls(spark, chunk):
    rows = [(k, None if s % 5 == 0 else c, f, t, s) for k, c, f, t, s in make(3)]
    want = sorted(r["seq"] for r in folds.changes(ordered(rows), "id", ["c", "f"], "ignore"))
    got = changes_only(frame(spark, rows), "id", ["c"], "f", ("ts", "seq"), "ignore", chunk)
    assert seqs(got) == want


def test_edges(spark):
    def kept(values, **kw):
        rows = [("d", "a", f, i, i) for i, f in enumerate(values)]
        return seqs(changes_only(frame(spark, rows), "d" and "id", (), "f", ("ts", "seq"), chunk="2 seconds", **kw))

    assert kept([None, "x", "y"]) == [0]                 # unknown at first: frozen
    assert kept(["x", None, "x", "y"]) == [0, 3]
    assert kept(["x", None, "y", None, "y", "x"]) == [0, 2, 5]
    assert kept([None, "x", None, "x", "y"], null_mode="ignore") == [1, 4]
    both = [("d", "a", "x", 0, 0), ("d", "b", "y", 1, 1), ("d", "b", None, 2, 2), ("d", "a", None, 3, 3),
            ("d", "a", "z", 4, 4), ("d", "b", "z", 5, 5)]
    assert seqs(changes_only(frame(spark, both), "id", ["c"], "f", ("ts", "seq"), chunk="1 second")) == [0, 1, 3, 5]


def test_bad_modes(spark):
    df = frame(spark, make(1, n=3))
    with pytest.raises(ValueError):
        changes_only(df, "id", (), "f", ("ts", "seq"), null_mode="other")


def test_last_change(spark):
    rows = [("d", "a", "x", 10, 0), ("d", "a", "y", 20, 1), ("e", "a", "x", 5, 2)]
    df = frame(spark, rows)
    late = {r.id: r.last_change.second for r in with_last_change(df, "id", ("ts",)).collect()}
    first = {r.id: r.last_change.second for r in with_last_change(df, "id", ("ts",), refresh=False).collect()}
    assert late == {"d": 20, "e": 5} and first == {"d": 10, "e": 5}


@pytest.mark.parametrize("chunk", [None, "3 seconds", "1 hour"])
def test_number_rows_and_carry(spark, chunk):
    rows = make(5)
    got = {r.seq: r.pos for r in number_rows(frame(spark, rows), "id", ["ts", "seq"], "pos", chunk).collect()}
    seen, filled, last = {}, {}, {}
    for r in ordered(rows):
        assert got[r["seq"]] == seen.get(r["id"], 0)
        seen[r["id"]] = seen.get(r["id"], 0) + 1
        last[r["id"]] = r["f"] if r["f"] is not None else last.get(r["id"])
        filled[r["seq"]] = last[r["id"]]
    carried = carry_forward(frame(spark, rows), "id", ["ts", "seq"], "f", chunk)
    assert {r.seq: r.f for r in carried.collect()} == filled
