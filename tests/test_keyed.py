from homestream.operators import keyed
from homestream.schemas import CONTROL_LOG, DOCUMENT, LOCK_STATE, READING_LOG
from homestream.streaming.sinks import SPANS, AppendLog, KeyedTable, _children

LOCKS = "device_id string, name string, status boolean, location string, password string, seq long"
VALUES = ["name", "status", "location", "password"]


def test_coalesce_upsert(spark):
    target = spark.createDataFrame([("a", "front", False, "hall", "old"), ("z", "back", True, None, None)], LOCK_STATE)
    rows = spark.createDataFrame([
        ("a", None, True, None, "new", 1), ("a", None, False, None, None, 2),
        ("b", None, True, None, None, 1),
    ], LOCKS)
    got = keyed.coalesce_upsert(target, rows, "device_id", VALUES, ["seq"])
    assert sorted(map(tuple, got.collect())) == [
        ("a", "front", False, "hall", "new"), ("b", None, True, None, None), ("z", "back", True, None, None)]
    again = keyed.coalesce_upsert(got, rows, "device_id", VALUES, ["seq"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_insert_if_absent(spark):
    target = spark.createDataFrame([("a", "u", "t1")], CONTROL_LOG)
    rows = spark.createDataFrame(
        [("a", "u", "t1"), ("a", "u", "t2"), ("a", "u", "t2"), (None, "u", "t3"), (None, "u", "t3")], CONTROL_LOG)
    got = keyed.insert_if_absent(target, rows, CONTROL_LOG.fieldNames()).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        ("a", "u", "t1"), ("a", "u", "t2"), (None, "u", "t3"), (None, "u", "t3")]))


def test_first_and_last_window_win(spark):
    rows = spark.createDataFrame([("d", "t", 1.0, 5), ("d", "t", 2.0, 4), ("e", "t", 3.0, 1)],
                                 "location string, record_time string, value double, w int")
    got = keyed.insert_if_absent(spark.createDataFrame([], READING_LOG), rows, ["location", "record_time"], "w")
    assert sorted(map(tuple, got.collect())) == [("d", "t", 2.0), ("e", "t", 3.0)]
    stored = spark.createDataFrame([("dt", "d", "t", 0.0), ("x", "x", "", 9.0)], DOCUMENT)
    docs = spark.createDataFrame([("dt", "d", "t", 1.0, 5), ("dt", "d", "t", 2.0, 4)],
                                 "doc_id string, id string, timestamp string, value double, w int")
    got = keyed.index_latest(stored, docs, order=["w"])
    assert sorted(map(tuple, got.collect())) == [("dt", "d", "t", 1.0), ("x", "x", "", 9.0)]


def test_keyed_table_replay(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "Lock"), LOCK_STATE)
    assert table.read().count() == 0
    first = spark.createDataFrame([("a", "n", True, None, "p", 1)], LOCKS)
    second = spark.createDataFrame([("a", None, False, None, None, 2)], LOCKS)
    table.upsert(first, "device_id", VALUES, 0, ["seq"])
    table.upsert(second, "device_id", VALUES, 1, ["seq"])
    want = [("a", "n", False, None, "p")]
    assert list(map(tuple, table.read().collect())) == want
    table.upsert(second, "device_id", VALUES, 1, ["seq"])      # replay
    assert list(map(tuple, table.read().collect())) == want and table.versions() == [0, 1]


def test_append_log_replay(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "Control"), CONTROL_LOG, "control_time")
    keys = CONTROL_LOG.fieldNames()
    b0 = spark.createDataFrame([("a", "u", "2024-01-01T1"), ("a", "u", "2024-01-01T1"), ("b", "u", None)], CONTROL_LOG)
    b1 = spark.createDataFrame([("a", "u", "2024-01-01T1"), ("a", "u", "2024-01-02T1")], CONTROL_LOG)
    for _ in range(2):
        log.insert_if_absent(b0, keys, 0, "fan")
    for _ in range(2):
        log.insert_if_absent(b1, keys, 1, "fan")
    log.insert_if_absent(b1.limit(0), keys, 2, "fan")
    log.insert_if_absent(b1, keys, 0, "door")                    # other stream, same rows
    got = sorted(map(str, map(tuple, log.read().collect())))
    assert got == sorted(map(str, [("a", "u", "2024-01-01T1"), ("b", "u", None), ("a", "u", "2024-01-02T1")]))


def test_append_log_latest(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "index"), DOCUMENT, "timestamp")
    log.append(spark.createDataFrame([("d1", "d", "1", 1.0), ("e1", "e", "1", 5.0)], DOCUMENT), 0)
    log.append(spark.createDataFrame([("d1", "d", "1", 2.0)], DOCUMENT), 1)
    assert sorted(map(tuple, log.latest("doc_id").collect())) == [("d1", "d", "1", 2.0), ("e1", "e", "1", 5.0)]


def test_keyed_table_filled_before(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "Lock"), LOCK_STATE)
    table.write(spark.createDataFrame([("a", "front", True, "hall", "p"), ("z", "back", True, None, None)], LOCK_STATE))
    batch = spark.createDataFrame([("a", None, False, None, None, 1)], LOCKS)
    want = [("a", "front", False, "hall", "p"), ("z", "back", True, None, None)]
    for _ in range(2):                                            # and replayed
        table.upsert(batch, "device_id", VALUES, 0, ["seq"], "first")
        assert sorted(map(tuple, table.read().collect())) == want and table.versions() == [0, 1]


def test_keyed_table_new_checkpoint(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "Lock"), LOCK_STATE)
    for n in range(3):
        table.upsert(spark.createDataFrame([("a", f"n{n}", True, None, None, n)], LOCKS), "device_id", VALUES, n, ["seq"], "old")
    table.upsert(spark.createDataFrame([("b", "m", True, None, None, 9)], LOCKS), "device_id", VALUES, 0, ["seq"], "new")
    assert sorted(r.name for r in table.read().collect()) == ["m", "n2"]


def test_keyed_table_keeps_one(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "Lock"), LOCK_STATE, keep=1)
    for n in range(3):
        table.write(spark.createDataFrame([("a", f"n{n}", True, None, None)], LOCK_STATE))
    assert table.versions() == [2] and [r.name for r in table.read().collect()] == ["n2"]


def test_append_log_new_checkpoint(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "Control"), CONTROL_LOG, "control_time")
    keys, rows = CONTROL_LOG.fieldNames(), [("a", "u", f"2024-01-0{d}T1") for d in (1, 2, 3)]
    for n, r in enumerate(rows):
        log.insert_if_absent(spark.createDataFrame([r], CONTROL_LOG), keys, n, "led", run="old")
    late = ("a", "u", "2023-01-01T1")
    for _ in range(2):
        # batch 0 of a new run: a row that batch 2 of the old run stored, and a late one
        log.insert_if_absent(spark.createDataFrame([rows[2], late], CONTROL_LOG), keys, 0, "led", run="new")
    assert sorted(map(tuple, log.read().collect())) == [late, *rows]


def test_append_log_latest_of_runs(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "index"), DOCUMENT, "timestamp")
    for n in range(2):
        log.append(spark.createDataFrame([("d1", "d", "1", float(n))], DOCUMENT), n, run="z-old")
    log.append(spark.createDataFrame([("d1", "d", "1", 7.0)], DOCUMENT), 0, run="a-new")
    assert [r.value for r in log.latest("doc_id").collect()] == [7.0]


def test_absent_rows_keep_unknown_copies(spark):
    rows = spark.createDataFrame([(None, "t", 1.0, 1), (None, "t", 1.0, 1), (None, "t", 2.0, 2), ("d", "t", 3.0, 1)],
                                 "location string, record_time string, value double, w int")
    target = spark.createDataFrame([("d", "t", 0.0)], READING_LOG)
    got = keyed.absent_rows(target, rows, ["location", "record_time"], "w").collect()
    assert sorted(r.value for r in got) == [1.0, 1.0, 2.0]
    plan = keyed.absent_rows(target, rows, ["location", "record_time"], "w")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("w#") and plan.count("LogicalRDD") == 2       # each input once


def test_shared_folder_is_only_read(spark, tmp_path):
    from homestream.session import checkpoint_root, cut_lineage, shared_dir
    assert shared_dir(spark, "a", "b").startswith(checkpoint_root(spark).rstrip("/") + "/a/")
    df = spark.range(5)
    cut = cut_lineage(df)
    assert cut.count() == 5 and "ParquetScan" not in df._jdf.queryExecution().toString()
    assert cut.inputFiles()


def test_session_without_shared_folder(tmp_path):
    """A local session whose configuration names no folder: nothing is set at run time, streams work."""
    import os
    import subprocess
    import sys
    code = ("from homestream.session import local_session, shared_dir\n"
            "from homestream.plans.queries import QUERIES\n"
            "s = local_session(2)\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
            "assert shared_dir(s, 'a') == shared_dir(s, 'a')\n"
            "print('ROWS', QUERIES['stream_led_changes'](s, '/root/testdata/sf0.001').count())\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=200,
                         env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)})
    assert "ROWS" in got.stdout, got.stderr[-2000:]


def test_append_log_of_many_days(spark, tmp_path):
    """A micro-batch of many days makes a bounded number of folders; a later one finds its days in them."""
    log = AppendLog(spark, str(tmp_path / "Control"), CONTROL_LOG, "control_time")
    keys, days = CONTROL_LOG.fieldNames(), [f"20{y:02d}-{m:02d}-{d:02d}" for y in range(20, 22) for m in range(1, 13) for d in range(1, 28, 3)]
    rows = [("a", "u", f"{d}T1") for d in days]
    first = spark.createDataFrame([*rows, ("b", "u", None)], CONTROL_LOG)
    for _ in range(2):                                            # and replayed
        log.insert_if_absent(first, keys, 0, "fan", run="old")
    assert len([n for n in _children(spark, log.path) if n.startswith("day=")]) <= SPANS + 1
    assert log.stored([days[0]]).count() < len(days) / 4          # not the whole history
    new = ("a", "u", "2020-01-02T1")                              # between two stored days
    again = spark.createDataFrame([*rows[::7], new], CONTROL_LOG)
    for _ in range(2):
        log.insert_if_absent(again, keys, 0, "fan", run="new")
    log.insert_if_absent(spark.createDataFrame([rows[40]], CONTROL_LOG), keys, 1, "fan", run="new")
    assert sorted(map(str, map(tuple, log.read().collect()))) == sorted(map(str, [*rows, new, ("b", "u", None)]))
