"""Registered queries: (spark, sf_dir) -> DataFrame, each over whole tables.

Times leave as text so that every engine prints the same value; ``event_ts`` and the like stay typed
inside the operators.
"""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from homestream.functions.columns import speed_value, status_flag, zip_to_map
from homestream.operators import (
    aggregate, changes, clean, commands, documents, feeds, frames, keyed, match, people, readings, timeline, wire,
)
from homestream.plans import views
from homestream.session import cut_lineage, shared_dir
from homestream.sources import people as gallery
from homestream.streaming import changes as stream_changes, pipeline, sinks
from homestream.schemas import (
    CONTROL_LOG, DOCUMENT, FAN_STATE, KINDS, LIGHT_STATE, LOCK_STATE, READING_LOG,
)

MATCH_TOLERANCE = 1.1      # the table's vectors are unit length and about 1.0 to 1.2 apart


def _text(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def _empty(spark, schema):
    return spark.createDataFrame([], schema)


def cleaned(kind, on_error="drop"):
    return lambda s, d: clean.clean_device(views.DEVICES[kind](s, d), kind, on_error)


def changed(kind, **options):
    return lambda s, d: changes.device_changes(cleaned(kind)(s, d), kind, **options)


def averages(kind, **options):
    return lambda s, d: readings.sliding_average(readings.to_reading(cleaned(kind)(s, d), kind), **options)


def _plain(query):
    return lambda s, d: query(s, d).drop("event_ts")


def _averages(kind, **options):
    def run(s, d):
        a = averages(kind, **options)(s, d)
        return a.select("id", _text("window_start"), _text("window_end"), "avg_value", "readings",
                        "name", "password", "timestamp")
    return run


def fan_quarantine(s, d):
    return clean.rejected(cleaned("fan", "quarantine")(s, d)).drop("event_ts")


def event_time_parse(s, d):
    rows = clean.accepted(clean.with_event_time(views.stamps(s, d), on_null="null"))
    return rows.select("seq", "timestamp", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_ts"))


def event_time_lenient(s, d):
    rows = clean.accepted(clean.with_event_time(views.stamps(s, d), on_null="null", lenient=True))
    return rows.select("seq", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_ts"))


def event_time_rejects(s, d):
    return clean.rejected(clean.with_event_time(views.stamps(s, d), on_null="null")).drop("event_ts")


def status(s, d):
    return views.fan(s, d).select(
        "seq", "bbc_fan", status_flag(F.col("bbc_fan")).alias("status"),
        speed_value(F.col("bbc_control_fan")).alias("speed"))


def light_state(s, d):
    return keyed.coalesce_upsert(_empty(s, LIGHT_STATE), keyed.light_rows(changed("led")(s, d)),
                                 "device_id", ["name", "status", "location"])


def fan_state(s, d):
    return keyed.coalesce_upsert(_empty(s, FAN_STATE), keyed.fan_rows(changed("fan")(s, d)),
                                 "device_id", ["name", "status", "location", "speed"])


def lock_state(s, d):
    return keyed.coalesce_upsert(_empty(s, LOCK_STATE), keyed.lock_rows(changed("door")(s, d)),
                                 "device_id", ["name", "status", "location", "password"])


def light_state_merge_existing(s, d):
    return keyed.coalesce_upsert(views.lights(s, d), keyed.light_rows(changed("led")(s, d)),
                                 "device_id", ["name", "status", "location"])


def _control_events(s, d):
    return keyed.control_events(changed("fan")(s, d), changed("door")(s, d), changed("led")(s, d))


def control_log(s, d):
    return keyed.insert_if_absent(_empty(s, CONTROL_LOG), _control_events(s, d), CONTROL_LOG.fieldNames())


def control_log_replay(s, d):
    """The same events offered twice leave the log as it is."""
    return keyed.insert_if_absent(control_log(s, d), _control_events(s, d), CONTROL_LOG.fieldNames())


def last_change_time(s, d):
    parts = []
    for kind, refresh in (("fan", True), ("door", False)):
        k = KINDS[kind]
        parts.append(changes.with_last_change(changed(kind)(s, d), k.key, refresh=refresh).select(
            F.lit(kind).alias("kind"), F.col(k.key).alias("device_id"), _text("last_change")))
    return parts[0].unionByName(parts[1])


def _first_wins(kind, **options):
    def run(s, d):
        rows = readings.reading_rows(averages(kind, **options)(s, d))
        return keyed.insert_if_absent(_empty(s, READING_LOG), rows, ["location", "record_time"], "window_start")
    return run


def temperature_docs_last_wins(s, d):
    docs = readings.average_documents(averages("temperature")(s, d))
    return keyed.index_latest(_empty(s, DOCUMENT), docs)


def humidity_documents(s, d):
    docs = documents.humidity_documents(averages("humidity")(s, d))
    latest = keyed.latest_documents(docs)
    return latest.select("doc_id", "id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"), "value")


def reading_json(s, d):
    rows = readings.to_reading(cleaned("temperature")(s, d), "temperature")
    return readings.reading_json(rows).select("seq", "json")


def valid_documents(s, d):
    return documents.valid_documents(averages("temperature")(s, d))


def _nearest(**options):
    def run(s, d):
        m = match.nearest_match(views.probes(s, d), views.gallery(s, d), tolerance=MATCH_TOLERANCE, **options)
        return m.select("probe_id", "name", "gallery_idx", F.round("distance", 6).alias("distance"),
                        F.round("confidence", 6).alias("confidence"))
    return run


def confident_match(s, d):
    m = match.nearest_match(views.probes(s, d), views.gallery(s, d), tolerance=MATCH_TOLERANCE)
    return frames.confident_only(m, min_confidence=-0.05).select("probe_id", "name", F.round("confidence", 6).alias("confidence"))


def frame_numbers(s, d):
    return views.detections(s, d).select("session", "frame_no", "seq")


def _confirmed(s, d, n=3):
    return frames.confirm_runs(views.detections(s, d), n=n, min_confidence=0.1)


def recognition(s, d):
    """The whole detection job: sampled frames, nearest person, two sightings in a row, feed messages."""
    seen = views.probes(s, d).join(
        views.table(s, d, "embeddings").select(F.col("vec_id").alias("probe_id"), F.col("label").alias("session")), "probe_id"
    ).withColumnRenamed("probe_id", "frame_no")
    named = match.nearest_match(frames.sample_frames(seen), views.gallery(s, d), ["session", "frame_no"], MATCH_TOLERANCE)
    named = cut_lineage(named)         # confirmation reads its input twice
    return frames.trigger_messages(frames.confirm_runs(named, n=2, min_confidence=-0.1))


def trigger_messages(s, d):
    return frames.trigger_messages(_confirmed(s, d))


def detection_outcome(s, d):
    return frames.detection_outcome(views.detections(s, d), _confirmed(s, d, n=5))


def _shown(detections):
    seen = F.col("frame_no") % frames.FRAME_SKIP == 0
    return detections.select(
        "session", "frame_no", F.when(seen, F.col("name")).alias("name"), F.when(seen, F.col("confidence")).alias("confidence"))


def carry_forward(s, d):
    """Frames that are not sampled show the result of the last sampled one."""
    return frames.carry_forward(_shown(views.detections(s, d)), "session", "frame_no", ["name", "confidence"])


def sample_frames(s, d):
    return frames.sample_frames(views.detections(s, d)).select("session", "frame_no", "name", "confidence")


def rescale_boxes(s, d):
    return frames.rescale_boxes(views.detections(s, d).select("session", "frame_no", "top", "right", "bottom", "left"))


def label_text(s, d):
    return frames.label_text(views.detections(s, d)).select("session", "frame_no", "label")


def parse_commands(s, d):
    return commands.parse_commands(views.transcripts(s, d))


def route_commands(s, d):
    return commands.route_commands(parse_commands(s, d)).select("event_id", "feed", "payload")


def gallery_stats(s, d):
    return people.gallery_stats(views.gallery(s, d))


def remove_person(s, d):
    return people.remove_person(views.gallery(s, d), ["p3", "p7"]).select("name", "gallery_idx")


def list_people(s, d):
    return people.list_people(views.images(s, d))


def image_labels(s, d):
    return people.with_label(views.images(s, d)).select("path", "name", "length")


def validate_uploads(s, d):
    return people.validate_uploads(views.uploads(s, d))


def stored_name(s, d):
    return people.stored_name(views.uploads(s, d)).select("name", "original", "stored_name")


def capture_name(s, d):
    shots = timeline.number_rows(views.uploads(s, d), "name", ["ts", "original"], "shot")
    return people.capture_name(shots).select("name", "shot", "stored_name")


def latest_per_feed(s, d):
    return feeds.latest_per_feed(views.feeds(s, d))


def pair_feeds(s, d):
    return feeds.pair_feeds(latest_per_feed(s, d), feeds=("click", "view"), names=("click", "view_value"))


def complete_pairs(s, d):
    return feeds.complete_only(pair_feeds(s, d), ["click", "view_value"])


def _snapshot(s, d):
    rows = views.feeds(s, d)
    names = ("click", "view", "purchase", "signup", "error")
    pairs = feeds.pair_feeds(feeds.latest_per_feed(rows), feeds=names, names=[f"f_{n}" for n in names])
    seen = rows.groupBy("key").agg(F.max("ts").alias("ts"))
    return pairs.join(seen, "key").withColumns(_users())


def _users():
    return {
        "device": F.concat(F.lit("dev-"), F.col("key").cast("string")),
        "user": F.concat(F.lit("user-"), F.col("key").cast("string")),
        "pass": F.concat(F.lit("pw-"), (F.col("key") % 3).cast("string")),
    }


RECORD_FEEDS = {"led": ["click"], "fan": ["click", "view"], "door": ["purchase", "signup"], "temperature": ["error"], "humidity": ["view"]}


def _record(kind, *fields):
    return lambda s, d: feeds.assemble_device_record(_snapshot(s, d), kind, "device", fields, "user", "pass", "ts")


def with_topic(s, d):
    return feeds.with_topic(views.event_kinds(s, d))


def zip_map(s, d):
    """Part names zipped with the values at hand; the shorter side ends the record."""
    names = F.split(F.when(F.col("event_type") == "click", "led_fan").otherwise("led_fan_servo"), "_")
    values = F.array(F.col("event_type"), F.col("user_id").cast("string"), F.col("value").cast("string"))
    return views.table(s, d, "events").select(
        "event_id", zip_to_map(names, F.slice(values, F.lit(1), F.when(F.col("event_type") == "view", 2).otherwise(3))).alias("m")
    ).select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("bbc_led", "bbc_fan", "bbc_servo")])


def mask_secrets(s, d):
    return clean.mask_secrets(cleaned("door")(s, d)).select("seq", "id_door", "bbc_servo", "bbc_password")


def frame_schema_id(s, d):
    parts = [
        wire.encode_frames(views.DEVICES[kind](s, d), kind, 300 + i).select(
            F.lit(kind).alias("kind"), "seq", wire.schema_id("value").alias("schema_id"))
        for i, kind in enumerate(KINDS)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _wire_round_trip(kind):
    def run(s, d):
        sent = wire.encode_frames(views.DEVICES[kind](s, d).drop("event_ts"), kind, 7)
        return clean.accepted(wire.decode_frames(sent, kind)).drop("frame", "schema_id")
    return run


def _documents(kind):
    def run(s, d):
        return documents.device_documents(changed(kind)(s, d), kind).withColumnRenamed("Timestamp", "stamp")
    return run


def _user_average(s, d):
    a = aggregate.sliding_aggregate(readings.to_reading(cleaned("temperature")(s, d), "temperature"), aggregate.average())
    return a.select("id", _text("window_start"), _text("window_end"), "avg_value", "readings", "name", "password", "timestamp")


def temp_window_extremes(s, d):
    """An aggregate that the library doesn't have: lowest, highest and the highest's wire time, by window."""
    def add(acc, r):
        if r["value"] is None:
            return acc
        v, at = r["value"], r["timestamp"]
        return merge(acc, (v, v, at))

    def merge(a, b):
        if a is None or b is None:
            return a or b
        # of equal highest values the one with the smaller time
        return (min(a[0], b[0]), *min(a[1:], b[1:], key=lambda x: (-x[0], x[1])))

    extremes = aggregate.Aggregate(
        create=lambda: None, add=add, merge=merge,
        result=lambda a: dict(zip(("low", "high", "high_at"), a or (None, None, None))), schema="low double, high double, high_at string")
    a = aggregate.sliding_aggregate(readings.to_reading(cleaned("temperature")(s, d), "temperature"), extremes, size="2 hours", slide="1 hour")
    return a.select("id", _text("window_start"), "low", "high", "high_at")


def _letters(content):
    """A stand-in model: one face for each 2,000 characters begun, with counts of two letters and the size."""
    text = bytes(content).decode()
    parts = [text[i:i + 2000] for i in range(0, len(text), 2000)]
    return [[float(p.count("a")), float(p.count("e")), float(len(p))] for p in parts]


def gallery_retrained(s, d):
    """From images to the gallery: all people, then without those of one language; nothing is encoded twice."""
    out = shared_dir(s, "runs", uuid.uuid4().hex)
    pictures = views.images(s, d, content=True)
    store = gallery.EncodingStore(s, f"{out}/encodings")
    gallery.retrain(pictures, _letters, store, f"{out}/gallery")
    left = gallery.remove_people(pictures, ["fr"], _letters, store, f"{out}/gallery")
    return left.select("name", "gallery_idx", *[F.col("encoding")[i].cast("double").alias(c) for i, c in enumerate(("n_a", "n_e", "size"))])


def stream_routed_records(s, d):
    """Feed values as a stream: latest, pairs, complete records, topics. The last record of each device and topic."""
    out = shared_dir(s, "runs", uuid.uuid4().hex)
    rows = views.feed_stream(s, d)
    commits = sinks.Commits(s, f"{out}/_commits")
    log = sinks.RoutedLog(s, f"{out}/topics", commits)
    state = pipeline.device_records(s, out, rows.schema, {"feeds": RECORD_FEEDS, "columns": _users()}, commits)
    _run(rows, pipeline.route(state, log, commits), f"{out}/checkpoint", s, d).awaitTermination()
    parts = []
    for kind, wanted in RECORD_FEEDS.items():
        k = KINDS[kind]
        r = log.read(k.topic).select("topic", "batch_id", F.from_json("value", k.schema).alias("r"))
        second = {"fan": "bbc_control_fan", "door": "bbc_password"}.get(kind)
        values = [c for c in k.schema.fieldNames() if c not in (k.key, "bbc_name", "bbc_password", "timestamp", second)]
        parts.append(r.select("topic", "batch_id", F.col(f"r.{k.key}").alias("device"), F.col(f"r.{values[0]}").cast("double").alias("first"),
                              (F.col(f"r.{second}").cast("double") if second else F.lit(None).cast("double")).alias("second"),
                              F.col("r.bbc_name").alias("name"), F.col("r.timestamp").alias("stamp")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy("topic", "device").agg(F.max_by(F.struct("first", "second", "name", "stamp"), "batch_id").alias("r")).select("topic", "device", "r.*")


def training_run(s, d):
    """Every document taken as a person's picture; the stand-in model sees its bytes."""
    def encode(content):
        return [[float(len(content))]] if content else []

    pictures = views.images(s, d, content=True)
    return people.encode_images(pictures, encode).groupBy("name").agg(
        F.count("encoding").alias("faces"), F.sum(F.col("encoding")[0].cast("double")).alias("bytes"),
        F.count("error").alias("failed"))


def _state_partitions(s, d):
    """As many as the input has splits, at least 8, at most what the session shuffles into."""
    splits = views.table(s, d, "events").rdd.getNumPartitions()
    return max(8, min(splits, int(s.conf.get("spark.sql.shuffle.partitions"))))


def _run(rows, on_batch, folder, s, d):
    """Start a query that works off what is there, on its checkpoint in ``folder``."""
    return pipeline.start(rows, None, on_batch, folder, trigger=None, state_partitions=_state_partitions(s, d))


def _batches(s, out):
    """foreachBatch writer of a plain folder: a replay writes its batch again."""
    return lambda b, n: b.write.mode("overwrite").parquet(f"{out}/rows/batch_id={n}")


def _streamed(kind):
    """The change stream of a device kind, run to the end of its input through a real streaming query."""
    def run(s, d):
        out = shared_dir(s, "runs", uuid.uuid4().hex)
        rows = pipeline.device_rows(views.DEVICES[kind](s, d, stream=True), kind)
        kept = pipeline.Tables(s, f"{out}/tables").changes(kind, rows.schema, "only")
        kept.table.commits = None     # one table: its own versions suffice
        _run(rows, stream_changes.each_batch(kept, _batches(s, out)), f"{out}/checkpoint", s, d).awaitTermination()
        return s.read.parquet(f"{out}/rows").drop("event_ts", "batch_id")
    return run


def stream_changes_two_nullable(s, d):
    """Doors by servo and password as they come, both with nulls."""
    out = shared_dir(s, "runs", uuid.uuid4().hex)
    rows = views.door(s, d, stream=True)
    kept = stream_changes.ChangeFilter(s, f"{out}/state", rows.schema, "id_door", ["bbc_servo", "bbc_password"])
    _run(rows, stream_changes.each_batch(kept, _batches(s, out)), f"{out}/checkpoint", s, d).awaitTermination()
    return s.read.parquet(f"{out}/rows").drop("event_ts", "batch_id")


def changes_two_nullable(s, d):
    return changes.changes_only(views.door(s, d), "id_door", (), ["bbc_servo", "bbc_password"]).drop("event_ts")


def stream_confirm_runs(s, d):
    """Confirmation of sessions on a stream of frames, state between micro-batches."""
    out = shared_dir(s, "runs", uuid.uuid4().hex)
    rows = views.detection_stream(s, d)
    state = stream_changes.Confirmation(s, f"{out}/state", rows.schema, n=3, min_confidence=0.1)
    _run(rows, stream_changes.each_batch(state, _batches(s, out)), f"{out}/checkpoint", s, d).awaitTermination()
    return s.read.schema("session bigint, frame_no bigint, name string").parquet(f"{out}/rows").drop("batch_id")


def stream_carry_forward(s, d):
    """Skipped frames of a stream show the last result, also from an earlier micro-batch."""
    out = shared_dir(s, "runs", uuid.uuid4().hex)
    rows = _shown(views.detection_stream(s, d))
    state = stream_changes.CarryForward(s, f"{out}/state", rows.schema, "session", "frame_no", ["name", "confidence"])
    _run(rows, stream_changes.each_batch(state, _batches(s, out)), f"{out}/checkpoint", s, d).awaitTermination()
    return s.read.parquet(f"{out}/rows").drop("batch_id")


def _device_streams(s, d, tables, out, mark=""):
    return [_run(pipeline.device_rows(views.DEVICES[kind](s, d, stream=True), kind), pipeline.fan_out(tables, kind), f"{out}/{kind}{mark}", s, d)
            for kind in ("fan", "door", "led")]


def stream_control_log(s, d):
    """All three change streams into one Control table, through the whole pipeline."""
    out = shared_dir(s, "runs", uuid.uuid4().hex)
    tables = pipeline.Tables(s, f"{out}/tables")
    for q in _device_streams(s, d, tables, out):
        q.awaitTermination()
    return tables.control().read()


def stream_light_merge_existing(s, d):
    """The led stream into a Light table that already holds rows."""
    out = shared_dir(s, "runs", uuid.uuid4().hex)
    tables = pipeline.Tables(s, f"{out}/tables")
    tables.state("led").write(views.lights(s, d))
    rows = pipeline.device_rows(views.DEVICES["led"](s, d, stream=True), "led")
    _run(rows, pipeline.fan_out(tables, "led"), f"{out}/led", s, d).awaitTermination()
    return tables.state("led").read()


def stream_control_log_restart(s, d):
    """The change streams twice into one Control table, the second time under new checkpoints: nothing
    is lost and nothing is added twice."""
    out = shared_dir(s, "runs", uuid.uuid4().hex)
    tables = pipeline.Tables(s, f"{out}/tables")
    for again in range(2):
        for q in _device_streams(s, d, tables, out, f"-{again}"):
            q.awaitTermination()
    return tables.control().read()


QUERIES = {
    "led_clean": _plain(cleaned("led")),
    "fan_clean": _plain(cleaned("fan")),
    "fan_quarantine": fan_quarantine,
    "door_clean": _plain(cleaned("door")),
    "temp_clean": _plain(cleaned("temperature")),
    "hum_clean": _plain(cleaned("humidity")),
    "event_time_parse": event_time_parse,
    "event_time_lenient": event_time_lenient,
    "event_time_rejects": event_time_rejects,
    "status_flag": status,
    "mask_secrets": mask_secrets,
    "led_changes": _plain(changed("led")),
    "fan_changes": _plain(changed("fan")),
    "door_changes": _plain(changed("door")),
    "led_changes_ignore_nulls": _plain(changed("led", null_mode="ignore")),
    "door_changes_ignore_nulls": _plain(changed("door", null_mode="ignore")),
    "last_change_time": last_change_time,
    "light_state": light_state,
    "fan_state": fan_state,
    "lock_state": lock_state,
    "light_state_merge_existing": light_state_merge_existing,
    "control_log": control_log,
    "control_log_replay": control_log_replay,
    "temp_window_avg": _averages("temperature"),
    "hum_window_avg": _averages("humidity"),
    "temp_window_avg_2h": _averages("temperature", size="2 hours", slide="1 hour"),
    "hum_window_avg_2h": _averages("humidity", size="2 hours", slide="1 hour"),
    "temperature_first_wins": _first_wins("temperature"),
    "humidity_first_wins": _first_wins("humidity"),
    "temperature_first_wins_2h": _first_wins("temperature", size="2 hours", slide="1 hour"),
    "temperature_docs_last_wins": temperature_docs_last_wins,
    "humidity_documents": humidity_documents,
    "reading_json": reading_json,
    "fan_documents": _documents("fan"),
    "door_documents": _documents("door"),
    "led_documents": _documents("led"),
    "valid_documents": valid_documents,
    "nearest_match": _nearest(),
    "nearest_match_blocks": _nearest(broadcast_bytes=0),
    "confident_match": confident_match,
    "recognition": recognition,
    "frame_numbers": frame_numbers,
    "confirm_runs": _confirmed,
    "trigger_messages": trigger_messages,
    "detection_outcome": detection_outcome,
    "carry_forward": carry_forward,
    "sample_frames": sample_frames,
    "rescale_boxes": rescale_boxes,
    "label_text": label_text,
    "parse_commands": parse_commands,
    "route_commands": route_commands,
    "gallery_stats": gallery_stats,
    "remove_person": remove_person,
    "training_run": training_run,
    "list_people": list_people,
    "image_labels": image_labels,
    "validate_uploads": validate_uploads,
    "stored_name": stored_name,
    "capture_name": capture_name,
    "latest_per_feed": latest_per_feed,
    "pair_feeds": pair_feeds,
    "complete_pairs": complete_pairs,
    "led_record": _record("led", "f_click"),
    "fan_record": _record("fan", "f_click", "f_view"),
    "door_record": _record("door", "f_purchase", "f_signup"),
    "temperature_record": _record("temperature", "f_error"),
    "humidity_record": _record("humidity", "f_view"),
    "with_topic": with_topic,
    "zip_to_map": zip_map,
    "frame_schema_id": frame_schema_id,
    "wire_round_trip_fan": _wire_round_trip("fan"),
    "wire_round_trip_temp": _wire_round_trip("temperature"),
    "temp_window_user_avg": _user_average,
    "temp_window_extremes": temp_window_extremes,
    "gallery_retrained": gallery_retrained,
    "stream_routed_records": stream_routed_records,
    "changes_two_nullable": changes_two_nullable,
    "stream_changes_two_nullable": stream_changes_two_nullable,
    "stream_confirm_runs": stream_confirm_runs,
    "stream_carry_forward": stream_carry_forward,
    "stream_led_changes": _streamed("led"),
    "stream_fan_changes": _streamed("fan"),
    "stream_door_changes": _streamed("door"),
    "stream_control_log": stream_control_log,
    "stream_light_merge_existing": stream_light_merge_existing,
    "stream_control_log_restart": stream_control_log_restart,
}
