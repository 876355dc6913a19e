import random

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F, types as T

from homestream.operators import clean, readings
from homestream.operators.changes import changes_only, device_changes
from homestream.operators.timeline import with_chunk
from homestream.plans import views
from homestream.schemas import KINDS
from homestream.sources.devices import read_device_stream, read_device_table
from homestream.streaming import pipeline, sinks
from homestream.streaming.changes import CarryForward, ChangeFilter, Confirmation, each_batch
from tests import folds

SF = "/root/testdata/sf0.001"
SEQ = (T.StructField("seq", T.LongType()),)
WIRE = {k: KINDS[k].schema.fieldNames() + ["seq"] for k in KINDS}


def feed(spark, tmp_path, kind, parts):
    """The kind's events as ``parts`` files in time order, so that state crosses micro-batches."""
    df = views.DEVICES[kind](spark, SF).select(*WIRE[kind])
    n = df.count()
    path = tmp_path / f"in_{kind}"
    for i in range(parts):
        lo, hi = n * i // parts, n * (i + 1) // parts
        piece = df.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1)
        piece.write.mode("append").parquet(str(path))
    return str(path)


def source(spark, kind, path, per_trigger=1):
    return read_device_stream(spark, kind, path=path, extra=SEQ, max_per_trigger=per_trigger)


def drain(df, name, checkpoint, mode="append"):
    out = []

    def take(batch, _):
        out.extend(batch.collect())

    pipeline.start(df, name, take, str(checkpoint), trigger=None, output_mode=mode).awaitTermination()
    return out


def filtered(df, name, tmp_path, state):
    """All rows that a state operator puts out over the micro-batches of a stream."""
    out = []
    pipeline.start(df, name, each_batch(state, lambda b, _: out.extend(b.collect())), str(tmp_path / f"cp_{name}"), trigger=None).awaitTermination()
    return out


@pytest.mark.parametrize("kind", ["led", "fan", "door"])
def test_stream_equals_batch(spark, tmp_path, kind):
    path = feed(spark, tmp_path, kind, 4)
    rows = pipeline.device_rows(source(spark, kind, path), kind)
    k = KINDS[kind]
    got = filtered(rows, f"eq_{kind}", tmp_path, ChangeFilter(spark, str(tmp_path / "state"), rows.schema, k.key, [*k.steady, k.watched_nullable]))
    batch = device_changes(pipeline.validated(read_device_table(spark, kind, path, SEQ), kind), kind)
    assert sorted(map(str, got)) == sorted(map(str, batch.select(*got[0].__fields__).collect()))


def keyed_stream(spark, tmp_path, rows, parts, schema="id string, c string, f string, seq long"):
    path = str(tmp_path / "in")
    for i in range(parts):
        spark.createDataFrame(rows[len(rows) * i // parts:len(rows) * (i + 1) // parts], schema).coalesce(1).write.mode("append").parquet(path)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
            .withColumn("event_ts", F.timestamp_seconds(F.col("seq") + 1704067200)))


@pytest.mark.parametrize("mode", ["sticky", "ignore"])
def test_stream_fold_and_last_change(spark, tmp_path, mode):
    rnd = random.Random(4)
    rows = [(rnd.choice("kkq"), rnd.choice(["a", "b", None]), rnd.choice(["x", "y", None]), i) for i in range(300)]
    stream = keyed_stream(spark, tmp_path, rows, 3)
    for refresh in (False, True):
        state = ChangeFilter(spark, str(tmp_path / f"state{refresh}"), stream.schema, "id", ["c", "f"], null_mode=mode, chunk="20 seconds",
                             last_change="at", refresh=refresh, ttl="1 hour")
        out = filtered(stream, f"fold_{mode}_{refresh}", tmp_path, state)
        kept = folds.changes([dict(zip(("id", "c", "f", "seq"), r)) for r in rows], "id", ["c", "f"], mode)
        assert sorted(r.seq for r in out) == [r["seq"] for r in kept]
        first = {}
        for r in kept:
            first.setdefault(r["id"], r["seq"])
        assert all(r["at"].minute * 60 + r["at"].second == (r.seq if refresh else first[r.id]) for r in out)


def test_hot_key_spreads(spark, tmp_path):
    """A key with a third of the rows is worked off in chunks: no Python worker sees more than one at a time."""
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", "ab"[i // 3 % 2], None if i % 7 == 0 else "xy"[i // 5 % 2], i) for i in range(3000)]
    stream = keyed_stream(spark, tmp_path, rows, 2)
    state = ChangeFilter(spark, str(tmp_path / "state"), stream.schema, "id", ["c", "f"], chunk="30 seconds")
    batch = spark.read.schema("id string, c string, f string, seq long").parquet(str(tmp_path / "in")).withColumn(
        "event_ts", F.timestamp_seconds(F.col("seq") + 1704067200))
    chunks = with_chunk(batch, ["event_ts"], "30 seconds").groupBy("id", "_chunk").count()
    assert chunks.agg(F.max("count")).first()[0] <= 10
    kept = folds.changes([dict(zip(("id", "c", "f", "seq"), r)) for r in rows], "id", ["c", "f"])
    assert sorted(r.seq for r in filtered(stream, "hot", tmp_path, state)) == [r["seq"] for r in kept]
    assert state.table.read().count() == len({r[0] for r in rows})


def test_silent_keys_are_forgotten(spark, tmp_path):
    """A key that was silent for longer than the state lives emits again; a row behind the watermark is late."""
    schema = "id string, c string, seq long"
    rows = [("a", "on", 0), ("b", "on", 10), ("b", "off", 400), ("c", "on", 401), ("a", "on", 402), ("c", "on", 390), ("b", "off", 410)]
    stream = keyed_stream(spark, tmp_path, rows, 7, schema)
    state = ChangeFilter(spark, str(tmp_path / "state"), stream.schema, "id", ["c"], ttl="1 minute", watermark="1 second")
    out = [(r.id, r.seq) for r in filtered(stream, "ttl", tmp_path, state)]
    # a is forgotten once 400 was seen, so it emits at 402; 390 is late; b goes on from its own state
    assert out == [("a", 0), ("b", 10), ("b", 400), ("c", 401), ("a", 402)]
    forever = ChangeFilter(spark, str(tmp_path / "state2"), stream.schema, "id", ["c"])
    assert [(r.id, r.seq) for r in filtered(stream, "no_ttl", tmp_path, forever)] == [("a", 0), ("b", 10), ("b", 400), ("c", 401)]


def test_changes_only_refuses_streams(spark, tmp_path):
    path = feed(spark, tmp_path, "led", 1)
    with pytest.raises(ValueError):
        changes_only(pipeline.validated(source(spark, "led", path), "led"), "id_led", (), "bbc_led")


def frames_stream(spark, tmp_path, rows, parts):
    return keyed_stream(spark, tmp_path, rows, parts, "session string, frame_no long, name string, confidence double, seq long")


@pytest.mark.parametrize("chunk", [3, 1000])
def test_confirmation_stream(spark, tmp_path, chunk):
    r = random.Random(2)
    rows = [(r.choice("aabc"), i, r.choice(["ann", "ann", "bob", "Unknown"]), r.choice([0.9, 0.2]), i) for i in range(240)]
    stream = frames_stream(spark, tmp_path, rows, 6)
    state = Confirmation(spark, str(tmp_path / "state"), stream.schema, n=4, chunk=chunk)
    got = {x.session: (x.frame_no, x.name) for x in filtered(stream, f"confirm{chunk}", tmp_path, state)}
    assert got == folds.confirm([(s, n, name, name != "Unknown" and c > 0.5) for s, n, name, c, _ in rows], 4) and got
    assert {x.session for x in state.table.read().filter("done").collect()} == {*got}


def test_ended_sessions_are_removed(spark, tmp_path):
    """An ended session stays ended until it was silent for the time to live; then its name may be confirmed anew."""
    rows = [("s", i, "ann", 0.9, i) for i in (0, 1, 2, 3)] + [("t", 9, "bob", 0.9, 500), ("s", 600, "ann", 0.9, 600), ("s", 601, "ann", 0.9, 601)]
    stream = frames_stream(spark, tmp_path, rows, 7)
    state = Confirmation(spark, str(tmp_path / "state"), stream.schema, n=2, ttl="2 minutes")
    assert [(x.session, x.frame_no) for x in filtered(stream, "ended", tmp_path, state)] == [("s", 1), ("s", 601)]


def test_carry_forward_stream(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.choice("ab"), i, r.choice(["ann", "bob", None, None]), r.choice([None, i / 10]), i) for i in range(200)]
    stream = frames_stream(spark, tmp_path, rows, 5)
    state = CarryForward(spark, str(tmp_path / "state"), stream.schema, "session", "frame_no", ["name", "confidence"], chunk=11)
    got = {x.frame_no: (x.name, x.confidence) for x in filtered(stream, "carry", tmp_path, state)}
    last, want = {}, {}
    for s, n, name, c, _ in rows:
        old = last.get(s, (None, None))
        last[s] = want[n] = (old[0] if name is None else name, old[1] if c is None else c)
    assert got == want


@pytest.mark.parametrize("stop_at", ["state", "Fan", "Control", "commit"])
def test_one_commit_for_all_tables(spark, tmp_path, stop_at):
    """A query that fails between two tables shows neither; resumed on its own checkpoint it ends where a batch does."""
    tables, path = pipeline.Tables(spark, str(tmp_path / "tables")), feed(spark, tmp_path, "fan", 3)
    calls = []

    def fail(table):
        calls.append(table)
        if table == stop_at and calls.count(stop_at) == 2:
            raise RuntimeError("stopped between two tables")

    def run(between):
        q = pipeline.start_device(source(spark, "fan", path), "fan", tables, str(tmp_path / "cp"), None, between=between)
        q.awaitTermination()

    with pytest.raises(StreamingQueryException):
        run(fail)
    first = device_changes(pipeline.validated(read_device_table(spark, "fan", path, SEQ).filter(f"seq < {spark.read.parquet(path).count() // 3}"), "fan"), "fan")
    log = lambda: sorted(map(tuple, tables.control().read().collect()))
    rows = lambda df: sorted({tuple(r) for r in df.select("id_fan", "bbc_name", "timestamp").collect()})
    assert log() == rows(first)
    assert {r.device_id for r in tables.state("fan").read().collect()} == {r.id_fan for r in first.collect()}
    run(None)
    every = device_changes(pipeline.validated(read_device_table(spark, "fan", path, SEQ), "fan"), "fan")
    assert log() == rows(every)
    from homestream.operators.keyed import coalesce_upsert, fan_rows
    _, schema, _ = pipeline.STATE_TABLES["fan"]
    want = coalesce_upsert(spark.createDataFrame([], schema), fan_rows(every), "device_id", [c for c in schema.fieldNames() if c != "device_id"])
    assert sorted(map(str, tables.state("fan").read().collect())) == sorted(map(str, want.collect()))


def test_pipeline_tables(spark, tmp_path):
    tables = pipeline.Tables(spark, str(tmp_path / "tables"))
    paths = {k: feed(spark, tmp_path, k, 3) for k in KINDS}
    queries = pipeline.run_devices({k: source(spark, k, p) for k, p in paths.items()}, tables,
                                   str(tmp_path / "cp"), trigger=None)
    for q in queries:
        q.awaitTermination()

    def stored(kind):
        return pipeline.validated(read_device_table(spark, kind, paths[kind], SEQ), kind)

    changed = {k: device_changes(stored(k), k) for k in ("led", "fan", "door")}
    control = {tuple(r) for k in changed for r in
               changed[k].select(KINDS[k].key, "bbc_name", "timestamp").collect()}
    log = list(map(tuple, tables.control().read().collect()))
    assert len(log) == len(control) and set(log) == control
    for kind in changed:
        _, schema, to_rows = pipeline.STATE_TABLES[kind]
        values = [c for c in schema.fieldNames() if c != "device_id"]
        from homestream.operators.keyed import coalesce_upsert
        want = coalesce_upsert(spark.createDataFrame([], schema), to_rows(changed[kind]), "device_id", values)
        assert sorted(map(str, tables.state(kind).read().collect())) == sorted(map(str, want.collect()))

    # closed windows only: the watermark holds back the last ones
    for kind in ("temperature", "humidity"):
        averages = readings.sliding_average(readings.to_reading(stored(kind), kind))
        first, last = {}, {}
        for r in averages.orderBy("window_start").collect():
            first.setdefault((r.id, r.timestamp), r.avg_value)
            last[(r.id, r.timestamp)] = r.avg_value
        got = {(r.location, r.record_time): r.value for r in tables.readings(kind).read().collect()}
        assert len(first) - 2 <= len(got) <= len(first)
        assert all(first[k] == v for k, v in got.items())
        if kind == "temperature":
            docs = {(r.id, r.timestamp): r.value for r in tables.documents().read().collect()}
            assert len(docs) == len(got)
            assert sum(last[k] != v for k, v in docs.items()) <= 2

    # every micro-batch of a query came under the query's own identity
    assert len(sinks._children(spark, f"{tables.root}/Control/_runs")) == 3

    before = sorted(map(str, log))
    pipeline.fan_out(tables, "fan")(changed["fan"], 99)              # everything once more
    assert sorted(map(str, map(tuple, tables.control().read().collect()))) == before


def test_late_rows_are_counted(spark, tmp_path):
    # a watermark drops rows from the micro-batch after the one it closes windows in
    schema = "id string, value double, name string, password string, timestamp string, event_ts timestamp, seq long"
    path = str(tmp_path / "in")
    for i, minute in enumerate([0, 30, 31, 1, 40]):
        (spark.sql(f"select 'd' id, 1d value, 'n' name, 'p' password, 't{i}' timestamp, "
                   f"timestamp'2024-01-01 00:{minute:02d}:00' event_ts, {i}L seq")
         .coalesce(1).write.mode("append").parquet(path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    rows = []
    late = pipeline.LateRows()
    spark.streams.addListener(late)
    try:
        q = pipeline.start(readings.sliding_average(stream), "late", lambda b, _: rows.extend(b.collect()),
                           str(tmp_path / "cp"), trigger=None)
        q.awaitTermination()
        for _ in range(100):
            if late.of(q):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(late)
    assert late.of(q) == sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]) > 0
    assert "t3" not in {r.timestamp for r in rows}


def test_quarantine(spark, tmp_path):
    path = feed(spark, tmp_path, "fan", 2)
    out = str(tmp_path / "rejects")
    pipeline.start_quarantine(source(spark, "fan", path), "fan", out, str(tmp_path / "cp"), trigger=None).awaitTermination()
    want = clean.rejected(pipeline.validated(read_device_table(spark, "fan", path, SEQ), "fan", "quarantine"))
    got = spark.read.parquet(out)
    assert got.count() == want.count() > 0 and {r[0] for r in got.select(clean.REASON).collect()} == {"bbc_control_fan"}


def test_sinks(spark, tmp_path, capfd):
    df = spark.createDataFrame([("led_schema", b"1"), ("fan_schema", b"2")], "topic string, value binary")
    sinks.write_routed(df, path=str(tmp_path / "topics"))
    back = spark.read.parquet(str(tmp_path / "topics")).filter("topic = 'fan_schema'").collect()
    assert [bytes(r.value) for r in back] == [b"2"]
    assert sinks.ROW_SINK.jdbc() == {"batchsize": "1", "numPartitions": "1"}
    assert sinks.INDEX_SINK.index()["es.batch.size.entries"] == "50"
    path = feed(spark, tmp_path, "led", 1)
    q = sinks.write_console(source(spark, "led", path), "LED Status: ", trigger="0 seconds")
    q.processAllAvailable()
    q.stop()


def test_source_arguments(spark):
    with pytest.raises(ValueError):
        read_device_stream(spark, "led")


def test_processing_time_windows(spark, tmp_path):
    """By the wall clock each reading lands in the two windows around the moment it is worked off."""
    path = feed(spark, tmp_path, "temperature", 3)
    rows = {}

    def take(batch, _):
        rows.update({(r.id, r.window_start): r for r in batch.collect()})

    averages = pipeline.device_rows(source(spark, "temperature", path), "temperature", time="processing")
    before = time.time()
    pipeline.start(averages, "wall", take, str(tmp_path / "cp"), trigger=None, output_mode="update").awaitTermination()
    valid = readings.to_reading(pipeline.validated(read_device_table(spark, "temperature", path, SEQ), "temperature"), "temperature")
    assert sum(r.readings for r in rows.values()) == 2 * valid.count()
    assert {r.id for r in rows.values()} == {r.id for r in valid.select("id").distinct().collect()}
    assert all(before - 240 <= r.window_start.timestamp() <= time.time() for r in rows.values())


def test_external_sink_goes_by_its_options(spark, tmp_path):
    path, parts = feed(spark, tmp_path, "led", 1), []
    options = sinks.SinkOptions(interval="0 seconds", parallelism=2)
    q = pipeline.start_external(source(spark, "led", path).repartition(5), "external", lambda b: parts.append((b.rdd.getNumPartitions(), b.count())), options, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert parts == [(2, spark.read.parquet(path).count())]


def test_routed_records_survive_a_stop(spark, tmp_path):
    """Records of a topic count with their state: a query stopped before the commit shows none of the batch, and
    resumed shows each once."""
    schema = "key long, feed string, value double, ts timestamp, seq long"
    path = str(tmp_path / "in")
    for i, rows in enumerate([[(1, "a", 1.0), (2, "a", 5.0)], [(1, "b", 2.0)], [(1, "a", 3.0), (2, "b", 6.0)]]):
        spark.createDataFrame([(*r, None, i * 10 + n) for n, r in enumerate(rows)], schema).withColumn(
            "ts", F.timestamp_seconds(F.col("seq") + 1704067200)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    users = {"feeds": {"led": ["a"], "fan": ["a", "b"]}, "columns": {
        "device": F.col("key").cast("string"), "user": F.lit("u"), "pass": F.lit("p")}}
    commits = sinks.Commits(spark, str(tmp_path / "commits"))
    log = sinks.RoutedLog(spark, str(tmp_path / "topics"), commits)
    state = pipeline.device_records(spark, str(tmp_path), stream.schema, users, commits)
    write, failing = pipeline.route(state, log, commits), [True]

    def once(batch, batch_id):
        if batch_id == 1 and failing:
            failing.pop()
            log.write(state.advance(batch, batch_id), batch_id, sinks.run_of(batch))
            raise RuntimeError("stopped before the commit")
        write(batch, batch_id)

    def run():
        pipeline.start(stream, "routed", once, str(tmp_path / "cp"), trigger=None).awaitTermination()

    def shown(kind):
        k = KINDS[kind]
        rows = log.read(k.topic).select("batch_id", F.from_json("value", k.schema).alias("r")).select("batch_id", "r.*")
        return sorted((r.batch_id, r[k.key], r.bbc_fan if kind == "fan" else r.bbc_led) for r in rows.collect())

    with pytest.raises(StreamingQueryException):
        run()
    assert shown("led") == [(0, "1", "1.0"), (0, "2", "5.0")] and shown("fan") == []
    run()
    assert shown("led") == [(0, "1", "1.0"), (0, "2", "5.0"), (1, "1", "1.0"), (2, "1", "3.0"), (2, "2", "5.0")]
    assert shown("fan") == [(1, "1", "1.0"), (2, "1", "3.0"), (2, "2", "5.0")]


def test_routed_records_join_nothing_by_key(spark, tmp_path):
    """Records of a micro-batch's keys without a join, so that no table of keys goes by way of the driver; keys that it
    doesn't touch, and rows without a key, make none."""
    schema = "key long, feed string, value double, ts timestamp, seq long"
    users = {"feeds": {"led": ["a"], "fan": ["a", "b"]}, "columns": {
        "device": F.col("key").cast("string"), "user": F.lit("u"), "pass": F.lit("p")}}
    at = lambda rows: spark.createDataFrame([(k, f, v, None, n) for k, f, v, n in rows], schema).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1704067200))
    first, second = at([(1, "a", 1.0, 0), (2, "a", 5.0, 3), (None, "a", 7.0, 4)]), at([(1, "b", 2.0, 9), (1, "b", 4.0, 8)])
    state = pipeline.device_records(spark, str(tmp_path), first.schema, users)
    found = []
    for n, batch in enumerate((first, second)):
        out = state.advance(batch, n, "run")
        found.append(sorted((r.topic == KINDS["led"].topic, r.value) for r in out.collect()))
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    state.release()
    assert [len(f) for f in found] == [2, 2]
    assert all('"u"' in v and "09" in v.split("T")[-1] for _, v in found[1])
