import random

import pytest

from homestream.operators import frames
from tests import folds


@pytest.mark.parametrize("chunk", [None, 5, 1000])
@pytest.mark.parametrize("n", [1, 3, 7])
def test_confirm_fold(spark, chunk, n):
    rnd = random.Random(n)
    rows, last = [], "a"
    for session in range(8):
        for frame in range(150 if session == 0 else 30):
            last = last if rnd.random() < 0.7 else rnd.choice("abc")
            rows.append((session, frame, last if rnd.random() < 0.9 else "Unknown", rnd.choice([0.4, 0.5, 0.6, 0.9])))
    df = spark.createDataFrame(rows, "session int, frame_no long, name string, confidence double").repartition(3)
    got = {r.session: (r.frame_no, r.name) for r in frames.confirm_runs(df, n=n, chunk=chunk).collect()}
    assert got == folds.confirm([(s, f, m, m != "Unknown" and c > 0.5) for s, f, m, c in rows], n)


def test_outcome_and_triggers(spark):
    triggers = spark.createDataFrame([(1, 6, "ann")], "session int, frame_no long, name string")
    sessions = spark.createDataFrame([(1,), (2,), (2,)], "session int")
    assert sorted(map(tuple, frames.detection_outcome(sessions, triggers).collect())) == [(1, "ann"), (2, "Unknown")]
    assert sorted(map(tuple, frames.trigger_messages(triggers).collect())) == [(1, 1, "ann"), (1, 2, "Unknown")]


def test_label_rounding(spark):
    df = spark.createDataFrame([("a", 0.145), ("b", 0.5), ("c", 0.065)], "name string, confidence double")
    want = [f"{n} ({c:.2f})" for n, c in (("a", 0.145), ("b", 0.5), ("c", 0.065))]
    assert [r.label for r in frames.label_text(df).collect()] == want


def test_boxes(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "top int, right int, bottom int, left int")
    assert frames.rescale_boxes(df).first().asDict() == {"left": 8, "top": 2, "right": 4, "bottom": 6}
