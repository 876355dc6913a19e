"""The device job: one streaming query per device kind, each fanning out to its tables.

source -> event time -> validation -> foreachBatch(change filter -> tables), or -> sliding average -> foreachBatch(tables)

All tables of a root folder share one commit record: a micro-batch counts in all of them or in none.
"""

from collections import Counter

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from homestream.operators import clean, feeds, keyed, readings
from homestream.operators.changes import ORDER
from homestream.schemas import (
    CONTROL_LOG, DOCUMENT, FAN_STATE, KINDS, LIGHT_STATE, LOCK_STATE, READING_LOG,
)
from homestream.session import shared_dir
from homestream.streaming.changes import ChangeFilter
from homestream.streaming.index import DocumentIndex
from homestream.streaming.sinks import AppendLog, Commits, KeyedTable, RoutedLog, run_of
from homestream.streaming.state import KeyedState

STATE_TABLES = {
    "fan": ("Fan", FAN_STATE, keyed.fan_rows),
    "door": ("Lock", LOCK_STATE, keyed.lock_rows),
    "led": ("Light", LIGHT_STATE, keyed.light_rows),
}
READING_TABLES = {"temperature": "Temperature", "humidity": "Humidity"}
WATERMARK = "1 second"
CHECKPOINT_EVERY = "5 seconds"
#: Tasks that write the records of one kind from one micro-batch.
RECORD_PARTS = 8


class Tables:
    """The target tables below one root folder."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, f"{self.root}/_commits")

    def state(self, kind):
        name, schema, _ = STATE_TABLES[kind]
        return KeyedTable(self.spark, f"{self.root}/{name}", schema, commits=self.commits)

    def control(self):
        return AppendLog(self.spark, f"{self.root}/Control", CONTROL_LOG, "control_time", self.commits)

    def readings(self, kind):
        return AppendLog(self.spark, f"{self.root}/{READING_TABLES[kind]}", READING_LOG, "record_time", self.commits)

    def documents(self):
        return DocumentIndex(self.spark, f"{self.root}/temperature_index", DOCUMENT, commits=self.commits)

    def changes(self, kind, rows, run, **options):
        """The change filter of a switchable device; each query (run) has a state of its own."""
        k = KINDS[kind]
        return ChangeFilter(self.spark, f"{self.root}/_state/{kind}/{run}", rows, k.key, [*k.steady, k.watched_nullable],
                            ORDER, commits=self.commits, **options)


def validated(df: DataFrame, kind, on_error="drop") -> DataFrame:
    """Rows with a usable event time that pass the rules of their kind."""
    if "event_ts" not in df.columns:
        df = clean.with_event_time(df, on_error=on_error)
    return clean.clean_device(df, kind, on_error)


def device_rows(df: DataFrame, kind, size="2 minutes", slide="1 minute", time="event"):
    """Validated rows of a switchable device, or window averages of a sensor."""
    rows = validated(df, kind)
    if not KINDS[kind].reading:
        return rows
    return readings.sliding_average(readings.to_reading(rows, kind), size=size, slide=slide, watermark=WATERMARK, time=time)


def fan_out(tables: Tables, kind, between=None, **options):
    """foreachBatch writer: a micro-batch of :func:`device_rows` feeds every table of its kind and is then recorded.

    ``options`` go to the change filter. ``between(table name)`` is called before each table is written (tests stop a
    query there). Called outside a stream, every batch counts as a run of its own.
    """
    k, at = KINDS[kind], between or (lambda table: None)

    def write(batch: DataFrame, batch_id: int):
        run = run_of(batch)
        batch = batch.persist()
        try:
            if k.reading:
                at(READING_TABLES[kind])
                tables.readings(kind).insert_if_absent(
                    readings.reading_rows(batch), ["location", "record_time"], batch_id, kind, "window_start", run)
                if kind == "temperature":
                    at("temperature_index")
                    tables.documents().write(readings.average_documents(batch), batch_id, run)
            else:
                at("state")
                state = tables.changes(kind, batch.schema, run, **options)
                try:
                    kept = state.advance(batch, batch_id, run).persist()
                    try:
                        _write_changes(tables, kind, kept, batch_id, run, at)
                    finally:
                        kept.unpersist()
                finally:
                    state.release()
            at("commit")
            tables.commits.record(run, batch_id)
        finally:
            batch.unpersist()

    return write


def _write_changes(tables, kind, kept, batch_id, run, at):
    name, schema, to_rows = STATE_TABLES[kind]
    values = [c for c in schema.fieldNames() if c != "device_id"]
    order = [c for c in ORDER if c in kept.columns]
    at(name)
    tables.state(kind).upsert(to_rows(kept), "device_id", values, batch_id, order, run)
    at("Control")
    tables.control().insert_if_absent(
        keyed.control_rows(kept, KINDS[kind].key), CONTROL_LOG.fieldNames(), batch_id, kind, run=run)


def start(df: DataFrame, name, on_batch, checkpoint=None, trigger=CHECKPOINT_EVERY, output_mode="append",
          state_partitions=None):
    """Start a query. ``trigger=None`` works off what is there and stops.

    ``state_partitions`` replaces the session's shuffle partitions for this query. It is fixed with the
    first start of a checkpoint and every micro-batch pays for each partition, so size it by the rows
    and keys of a micro-batch, not by those of the whole history.
    """
    checkpoint = checkpoint or shared_dir(df.sparkSession, "streams", name)
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    writer = writer.queryName(name) if name else writer
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    conf, key = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(key)
    try:
        conf.set(key, str(state_partitions or before))
        return writer.start()          # the query keeps its own copy of the settings
    finally:
        conf.set(key, before)


def start_device(df: DataFrame, kind, tables: Tables, checkpoint=None, trigger=CHECKPOINT_EVERY,
                 state_partitions=None, between=None, state_ttl=None, **options):
    ttl = {} if KINDS[kind].reading or not state_ttl else {"ttl": state_ttl, "watermark": WATERMARK}
    return start(device_rows(df, kind, **options), kind, fan_out(tables, kind, between, **ttl), checkpoint, trigger,
                 state_partitions=state_partitions)


def start_external(df: DataFrame, name, write, options, checkpoint=None, trigger=None):
    """A stream into an external sink, by the sink's options: a micro-batch each ``interval``, written by ``write(batch)``
    with at most ``parallelism`` tasks. Every batch is offered once more after a failure, so the sink must be keyed."""
    return start(df, name, lambda batch, _: write(batch.coalesce(options.parallelism)), checkpoint, trigger or options.interval)


def device_records(spark, root, rows, users, commits=None):
    """Feed values -> latest of each feed -> pairs -> complete records -> topics, micro-batch by micro-batch.

    The state is the latest value of each (key, feed). A micro-batch's output is a record (topic, value as JSON) of each
    kind for the keys it touched whose feeds are all known. ``rows``: schema of (key, feed, value, ts, seq); ``users``:
    kind -> feeds in order, and the columns of device, name and password as expressions over the key.
    """
    key, order = ["key", "feed"], ("ts", "seq")

    def step(batch, state):
        # what the micro-batch touched and when goes along in the folds, so that nothing is joined by key
        both = batch.select(state.columns).withColumns({"_touched": F.lit(True), "_seen": F.col("ts")}).unionByName(
            state.withColumns({"_touched": F.lit(False), "_seen": F.lit(None).cast(rows["ts"].dataType)}))
        after = made.hold(both.groupBy(*key).agg(
            F.max_by(F.struct("value", *order), F.struct(*order)).alias("_l"), F.max("_touched").alias("_touched"),
            F.max("_seen").alias("_seen")).select(*key, "_l.*", "_touched", "_seen"))
        names = sorted({f for feeds_ in users["feeds"].values() for f in feeds_})
        snapshot = feeds.pair_feeds(after.filter("key IS NOT NULL").select("key", "feed", "value", "_touched", "_seen"), feeds=names,
                                    names=[f"f_{n}" for n in names], more=[F.max("_touched").alias("_touched"), F.max("_seen").alias("ts")])
        # each kind of record is a reader of it; its rows are those of a micro-batch, whatever the state has grown to
        snapshot = made.hold(snapshot.filter("_touched").drop("_touched")).coalesce(RECORD_PARTS).withColumns(users["columns"])
        out = None
        for kind, wanted in users["feeds"].items():
            record = feeds.assemble_device_record(snapshot, kind, "device", [f"f_{f}" for f in wanted], "user", "pass", "ts")
            part = feeds.with_topic(record.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*record.columns), {"ignoreNullFields": "false"}).alias("value")))
            out = part if out is None else out.unionByName(part)
        return out.select("topic", "value"), after

    made = KeyedState(spark, f"{root}/latest", rows, key, ["value", *order], step, ts="ts", commits=commits)
    return made


def route(state: KeyedState, log: RoutedLog, commits: Commits):
    """foreachBatch writer of :func:`device_records`: state and records count together."""
    def write(batch, batch_id):
        run = run_of(batch)
        batch = batch.persist()
        try:
            log.write(state.advance(batch, batch_id, run), batch_id, run)
            commits.record(run, batch_id)
        finally:
            state.release()
            batch.unpersist()
    return write


def start_quarantine(df: DataFrame, kind, path, checkpoint=None, trigger=CHECKPOINT_EVERY):
    """Second reader of a source that files its rejects, row and reason, below ``path``."""
    rejects = clean.rejected(validated(df, kind, on_error="quarantine"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start(rejects, f"{kind}_rejects", write, checkpoint, trigger)


def run_devices(sources: dict, tables: Tables, checkpoint_root=None, trigger=CHECKPOINT_EVERY, state_partitions=None):
    """All device queries: ``sources`` maps a kind to its streaming frame."""
    return [
        start_device(df, kind, tables, f"{checkpoint_root}/{kind}" if checkpoint_root else None, trigger,
                     state_partitions)
        for kind, df in sources.items()
    ]


class LateRows(StreamingQueryListener):
    """Rows that watermarks drop, added up per query over all of its progress reports, also those that
    Spark no longer keeps. Register with ``spark.streams.addListener``; reports arrive a little later."""

    def __init__(self):
        self.counts = Counter()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.counts[str(p.id)] += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def of(self, query):
        return self.counts[str(query.id)]
