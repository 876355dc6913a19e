from homestream.streaming.index import DocumentIndex
from homestream.streaming.sinks import Commits

SCHEMA = "doc_id string, id string, value double, window_start timestamp"


def docs(spark, rows):
    """(doc_id, value, minute)"""
    return spark.createDataFrame([(d, d[:1], float(v), m) for d, v, m in rows], "doc_id string, id string, value double, m long").selectExpr(
        "doc_id", "id", "value", "timestamp_seconds(m * 60) window_start")


def index(spark, tmp_path, commits=None):
    schema = spark.createDataFrame([], "doc_id string, id string, value double").schema
    return DocumentIndex(spark, str(tmp_path / "index"), schema, buckets=4, commits=commits)


def values(i):
    return {r.doc_id: r.value for r in i.read().collect()}


def test_last_write_wins(spark, tmp_path):
    i = index(spark, tmp_path)
    assert values(i) == {}
    want = {}
    for n in range(10):
        rows = [(f"d{k}", n * 100 + k, n) for k in range(n, 30, 3)] + [("d1", n, -5)]     # an earlier window in the same batch
        i.write(docs(spark, rows), n, "run")
        want.update({d: float(v) for d, v, _ in sorted(rows, key=lambda r: r[2])})
        if n in (4, 7):
            assert i.compact(least=2)
        assert values(i) == want
    # a read is the bases and what came after them
    assert max(i.pending().values()) <= 2 and len(i._parts(i._deltas(), i._bases())) <= 4 * 3


def test_replays(spark, tmp_path):
    i = index(spark, tmp_path)
    first, second = [("a", 1, 0), ("b", 1, 0)], [("a", 2, 1), ("c", 2, 1)]
    i.write(docs(spark, first), 0, "run")
    i.write(docs(spark, second), 1, "run")
    i.write(docs(spark, second), 1, "run")        # replay before a compaction
    assert values(i) == {"a": 2, "b": 1, "c": 2}
    i.compact(least=1)
    i.write(docs(spark, second), 1, "run")        # and after it
    assert values(i) == {"a": 2, "b": 1, "c": 2} and not any(i.pending().values())
    i.write(docs(spark, [("b", 9, 3)]), 0, "other")
    assert values(i) == {"a": 2, "b": 9, "c": 2}
    assert not i.compact(least=2) and values(i) == {"a": 2, "b": 9, "c": 2}


def test_unrecorded_deltas(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "commits"))
    i = index(spark, tmp_path, commits)
    i.write(docs(spark, [("a", 1, 0)]), 0, "run")
    assert values(i) == {} and not i.compact(least=1)
    commits.record("run", 0)
    i.write(docs(spark, [("a", 2, 0)]), 1, "run")
    assert values(i) == {"a": 1}
    i.compact(least=1)
    assert values(i) == {"a": 1}
    commits.record("run", 1)
    assert values(i) == {"a": 2}
    i.compact(least=1)
    assert values(i) == {"a": 2} and commits.last() == {"run": 1}


def test_compaction_removes_what_nobody_reads(spark, tmp_path):
    i = index(spark, tmp_path)
    for n in range(12):
        i.write(docs(spark, [(f"d{k}", n, n) for k in range(40)]), n, "run")
        i.compact(least=2)
    assert values(i) == {f"d{k}": 11.0 for k in range(40)}
    assert len(i._deltas()) < 8
