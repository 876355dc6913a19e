"""The registered queries once more as plain SQL over the raw tables, for an independent check."""

# views (same rules as homestream.plans.views) -------------------------------------------------

_COMMON = """'user-' || user_id AS bbc_name, {password} AS bbc_password,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", ts AS event_ts, event_id AS seq FROM events"""
_COMMON_PW = _COMMON.format(password="'pw-' || (user_id % 3)")

VIEWS = {
    "led": f"""SELECT CASE WHEN event_id % 101 <> 0 THEN 'led-' || (user_id % 50) END AS id_led,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type IN ('click', 'purchase') THEN '1' ELSE '0' END AS bbc_led,
  {_COMMON_PW}""",
    "fan": f"""SELECT CASE WHEN event_id % 101 <> 0 THEN 'fan-' || (user_id % 20) END AS id_fan,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type IN ('click', 'purchase') THEN '1' ELSE '0' END AS bbc_fan,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '-5' WHEN event_id % 97 = 0 THEN 'abc'
       ELSE CAST(CAST(floor(value / 100) AS INTEGER) AS VARCHAR) END AS bbc_control_fan,
  {_COMMON_PW}""",
    "door": f"""SELECT CASE WHEN event_id % 101 <> 0 THEN 'door-' || (user_id % 20) END AS id_door,
  CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_type = 'signup' THEN '1' ELSE '0' END AS bbc_servo,
  {_COMMON.format(password="CASE WHEN event_id % 7 <> 0 THEN 'pw-' || (user_id % 3) END")}""",
    "temp": f"""SELECT CASE WHEN event_id % 101 <> 0 THEN 'temp-' || (user_id % 20) END AS id_temp,
  CASE WHEN event_id % 19 <> 0 THEN CAST(value AS FLOAT) END AS bbc_temp, {_COMMON_PW}""",
    "hum": f"""SELECT CASE WHEN event_id % 103 <> 0 THEN 'hum-' || (user_id % 10) END AS id_hum,
  CASE WHEN event_id % 17 <> 0 THEN CAST(value * 0.5::DOUBLE - 5 AS FLOAT) END AS bbc_hum, {_COMMON_PW}""",
    "stamps": """SELECT event_id AS seq, CASE WHEN event_id % 37 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  WHEN event_id % 41 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') WHEN event_id % 43 = 0 THEN 'at ' || user_id
  WHEN event_id % 47 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS "timestamp" FROM events""",
    "detections": """SELECT user_id % 50 AS session, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 'Unknown' ELSE event_type END AS name,
  CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value / 100 END AS confidence,
  CAST(floor(value) AS INTEGER) AS top, CAST(floor(value) + 40 AS INTEGER) AS "right",
  CAST(floor(value) + 60 AS INTEGER) AS bottom, CAST(user_id % 640 AS INTEGER) AS "left",
  row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) - 1 AS frame_no FROM events""",
    "transcripts": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Bật quạt giúp tôi' WHEN 1 THEN 'tắt quạt'
  WHEN 2 THEN 'BẬT ĐÈN' WHEN 3 THEN 'tắt đèn phòng khách'
  WHEN 4 THEN 'Tốc độ quạt ' || CAST(floor(value) AS INTEGER)
  WHEN 5 THEN 'tốc độ quạt lên ' || CAST(floor(value) AS INTEGER) || ' rồi bật quạt'
  WHEN 6 THEN 'xin chào' END AS text FROM events""",
    "feeds": "SELECT user_id AS key, event_type AS feed, value, ts, event_id AS seq FROM events",
    "uploads": """SELECT 'p-' || user_id || '-' || strftime(ts, '%Y%m%d') AS name,
  CASE WHEN event_type = 'error' THEN 'text/plain' ELSE 'image/jpeg' END AS content_type,
  event_id || '.jpg' AS original, ts FROM events""",
    "images": "SELECT 'dataset/' || lang || '/' || doc_id || '.jpg' AS path, n_chars AS length FROM documents",
    "gallery": "SELECT 'p' || label AS name, vec_id AS gallery_idx, embedding::DOUBLE[] AS encoding FROM embeddings",
    "probes": "SELECT vec_id AS probe_id, list_reverse(embedding)::DOUBLE[] AS encoding FROM embeddings",
    "lights": """SELECT 'led-' || (n_nationkey * 3) AS device_id, n_name AS name, n_regionkey = 1 AS status,
  'region-' || n_regionkey AS location FROM nation""",
    # cleaned
    "led_ok": "SELECT * FROM led WHERE id_led IS NOT NULL",
    "fan_known": "SELECT * FROM fan WHERE id_fan IS NOT NULL AND bbc_control_fan IS NOT NULL",
    "fan_ok": """SELECT * FROM fan_known WHERE regexp_full_match(bbc_control_fan, '[+-]?[0-9]+')
  AND TRY_CAST(bbc_control_fan AS INTEGER) >= 0""",
    "door_ok": "SELECT * FROM door WHERE id_door IS NOT NULL AND bbc_servo IS NOT NULL",
    "temp_ok": "SELECT * FROM temp WHERE id_temp IS NOT NULL AND bbc_temp BETWEEN 0 AND 150",
    "hum_ok": "SELECT * FROM hum WHERE id_hum IS NOT NULL AND bbc_hum BETWEEN 0 AND 150",
}


def _changes(source, key, steady, nullable):
    """Runs of the steady field; inside a run the nullable field counts if known at its opening."""
    steady = steady or "1"
    return {
        f"{source}_lag": f"SELECT *, lag({steady}) OVER (PARTITION BY {key} ORDER BY event_ts, seq) AS pc FROM {source}_ok",
        f"{source}_runs": f"""SELECT *, sum(CASE WHEN pc IS NULL OR pc <> {steady} THEN 1 ELSE 0 END)
  OVER (PARTITION BY {key} ORDER BY event_ts, seq) AS run FROM {source}_lag""",
        f"{source}_state": f"""SELECT *, row_number() OVER w AS rn, first_value({nullable}) OVER w AS f0,
  last_value({nullable} IGNORE NULLS) OVER (PARTITION BY {key}, run ORDER BY event_ts, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pf
  FROM {source}_runs WINDOW w AS (PARTITION BY {key}, run ORDER BY event_ts, seq)""",
        f"{source}_chg": f"""SELECT * EXCLUDE (pc, run, rn, f0, pf) FROM {source}_state
  WHERE rn = 1 OR (f0 IS NOT NULL AND {nullable} IS NOT NULL AND {nullable} <> pf)""",
    }


def _averages(out, source, key, value, slide, size, steps):
    first = "arg_min({c}, (ts_us, seq))"
    return {
        f"{out}_w": f"""SELECT {key} AS id, CAST({value} AS DOUBLE) AS v, bbc_name, bbc_password, "timestamp", seq,
  event_ts AS ts_us, time_bucket(INTERVAL '{slide}', event_ts) - k * INTERVAL '{slide}' AS ws
  FROM {source}_ok, range({steps}) AS r(k)""",
        out: f"""SELECT id, ws, ws + INTERVAL '{size}' AS we, sum(v) / count(*) AS avg_value, count(*) AS readings,
  {first.format(c='bbc_name')} AS name, {first.format(c='bbc_password')} AS password,
  {first.format(c='"timestamp"')} AS "timestamp" FROM {out}_w GROUP BY id, ws""",
    }


VIEWS.update(_changes("led", "id_led", None, "bbc_led"))
VIEWS.update(_changes("fan", "id_fan", "bbc_control_fan", "bbc_fan"))
VIEWS.update(_changes("door", "id_door", "bbc_servo", "bbc_password"))
VIEWS.update(_averages("temp_avg", "temp", "id_temp", "bbc_temp", "1 minute", "2 minutes", 2))
VIEWS.update(_averages("hum_avg", "hum", "id_hum", "bbc_hum", "1 minute", "2 minutes", 2))
VIEWS.update(_averages("temp_avg2h", "temp", "id_temp", "bbc_temp", "1 hour", "2 hours", 2))
VIEWS.update(_averages("hum_avg2h", "hum", "id_hum", "bbc_hum", "1 hour", "2 hours", 2))
VIEWS.update({
    "control_events": """SELECT id_fan AS device_id, bbc_name AS username, "timestamp" AS control_time FROM fan_chg
  UNION ALL SELECT id_door, bbc_name, "timestamp" FROM door_chg
  UNION ALL SELECT id_led, bbc_name, "timestamp" FROM led_chg""",
    "pairwise": """SELECT probe_id, name, gallery_idx, list_distance(p.encoding, g.encoding) AS distance,
  row_number() OVER (PARTITION BY probe_id ORDER BY list_distance(p.encoding, g.encoding), gallery_idx) AS rn
  FROM probes p, gallery g""",
    "matched": """SELECT probe_id, CASE WHEN distance <= 1.1 THEN name ELSE 'Unknown' END AS name,
  CASE WHEN distance <= 1.1 THEN gallery_idx END AS gallery_idx,
  CASE WHEN distance <= 1.1 THEN distance END AS distance,
  CASE WHEN distance <= 1.1 THEN 1 - distance ELSE 0 END AS confidence FROM pairwise WHERE rn = 1""",
    "sighted": """SELECT label AS session, vec_id AS frame_no, m.name FROM embeddings JOIN matched m ON probe_id = vec_id
  WHERE vec_id % 2 = 0 AND m.name <> 'Unknown' AND m.confidence > -0.1""",
    "sighted_lag": "SELECT *, lag(name) OVER (PARTITION BY session ORDER BY frame_no) AS pn FROM sighted",
    "sighted_twice": "SELECT session, arg_min(name, frame_no) AS name FROM sighted_lag WHERE name = pn GROUP BY session",
    "sure": "SELECT * FROM detections WHERE name <> 'Unknown' AND confidence > 0.1",
    "sure_lag": "SELECT *, lag(name) OVER (PARTITION BY session ORDER BY frame_no) AS pn FROM sure",
    "sure_runs": """SELECT *, sum(CASE WHEN pn IS NULL OR pn <> name THEN 1 ELSE 0 END)
  OVER (PARTITION BY session ORDER BY frame_no) AS run FROM sure_lag""",
    "sure_pos": "SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY frame_no) AS pos FROM sure_runs",
    "confirmed3": "SELECT session, min(frame_no) AS frame_no, arg_min(name, frame_no) AS name FROM sure_pos WHERE pos = 3 GROUP BY session",
    "confirmed5": "SELECT session, min(frame_no) AS frame_no, arg_min(name, frame_no) AS name FROM sure_pos WHERE pos = 5 GROUP BY session",
    "heard": """SELECT *, lower(text) AS said,
  TRY_CAST(regexp_extract(lower(text), 'tốc độ quạt\\s*(\\D*)\\s*(\\d+)', 2) AS BIGINT) AS n FROM transcripts""",
    "parsed": """SELECT event_id, text,
  CASE WHEN n BETWEEN 1 AND 99 THEN 'set_speed' WHEN contains(said, 'bật quạt') THEN 'on' WHEN contains(said, 'tắt quạt') THEN 'off'
       WHEN contains(said, 'bật đèn') THEN 'on' WHEN contains(said, 'tắt đèn') THEN 'off' END AS action,
  CASE WHEN n BETWEEN 1 AND 99 THEN NULL WHEN contains(said, 'bật quạt') OR contains(said, 'tắt quạt') THEN 'fan'
       WHEN contains(said, 'bật đèn') OR contains(said, 'tắt đèn') THEN 'light' END AS target,
  CASE WHEN n BETWEEN 1 AND 99 THEN CAST(n AS INTEGER) END AS speed FROM heard""",
    "latest": "SELECT key, feed, arg_max(value, (ts, seq)) AS value FROM feeds GROUP BY key, feed",
    "paired": """SELECT key, max(CASE WHEN feed = 'click' THEN value END) AS click,
  max(CASE WHEN feed = 'view' THEN value END) AS view_value FROM latest GROUP BY key""",
    "snapshot": """SELECT key, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp",
  'dev-' || key AS device, 'user-' || key AS usr, 'pw-' || (key % 3) AS pw,
  """ + ", ".join(f"arg_max(CASE WHEN feed = '{f}' THEN value END, CASE WHEN feed = '{f}' THEN (ts, seq) END) AS f_{f}"
                  for f in ("click", "view", "purchase", "signup", "error")) + " FROM feeds GROUP BY key",
})

_NULLS = "CAST(NULL AS VARCHAR)"


def _time(col, as_=None):
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S') AS {as_ or col}"


def _avg_out(view):
    return (f"SELECT id, {_time('ws', 'window_start')}, {_time('we', 'window_end')}, avg_value, readings, "
            f'name, password, "timestamp" FROM {view}')


def _first_wins(view):
    return (f'SELECT id AS location, "timestamp" AS record_time, arg_min(avg_value, ws) AS value '
            f'FROM {view} GROUP BY id, "timestamp"')


def _ignore(source, key, fields):
    past = f"(PARTITION BY {key} ORDER BY event_ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    known = ", ".join(f"last_value({f} IGNORE NULLS) OVER {past} AS k_{f}" for f in fields)
    test = " OR ".join(f"({f} IS NOT NULL AND (k_{f} IS NULL OR k_{f} <> {f}))" for f in fields)
    drop = ", ".join(["event_ts", *[f"k_{f}" for f in fields]])
    return f"SELECT * EXCLUDE ({drop}) FROM (SELECT *, {known} FROM {source}_ok) WHERE {test}"


_LAST = "arg_max({c}, (event_ts, seq)) FILTER (WHERE {c} IS NOT NULL)"

BODIES = {
    **{f"{n}_clean": f"SELECT * EXCLUDE (event_ts) FROM {n}_ok" for n in ("led", "fan", "door", "temp", "hum")},
    "fan_quarantine": """SELECT * EXCLUDE (event_ts), 'bbc_control_fan' AS reject_reason FROM fan_known
  WHERE NOT regexp_full_match(bbc_control_fan, '[+-]?[0-9]+')""",
    "event_time_parse": """SELECT seq, "timestamp",
  strftime(strptime("timestamp", '%Y-%m-%dT%H:%M:%S.%f'), '%Y-%m-%d %H:%M:%S.%g') AS event_ts FROM stamps
  WHERE "timestamp" IS NULL OR regexp_full_match("timestamp", '.{19}\\.[0-9]{6}')""",
    "event_time_lenient": """SELECT seq, strftime(TRY_CAST("timestamp" AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%g') AS event_ts FROM stamps
  WHERE "timestamp" IS NULL OR TRY_CAST("timestamp" AS TIMESTAMP) IS NOT NULL""",
    "event_time_rejects": """SELECT seq, "timestamp", 'timestamp' AS reject_reason FROM stamps
  WHERE "timestamp" IS NOT NULL AND NOT regexp_full_match("timestamp", '.{19}\\.[0-9]{6}')""",
    "status_flag": """SELECT seq, bbc_fan, bbc_fan IS NOT NULL AND bbc_fan <> '0' AS status,
  coalesce(TRY_CAST(bbc_control_fan AS INTEGER), 0) AS speed FROM fan""",
    "mask_secrets": "SELECT seq, id_door, bbc_servo, sha256(bbc_password) AS bbc_password FROM door_ok",
    **{f"{n}_changes": f"SELECT * EXCLUDE (event_ts) FROM {n}_chg" for n in ("led", "fan", "door")},
    "led_changes_ignore_nulls": _ignore("led", "id_led", ["bbc_led"]),
    "door_changes_ignore_nulls": _ignore("door", "id_door", ["bbc_servo", "bbc_password"]),
    "last_change_time": f"""SELECT 'fan' AS kind, id_fan AS device_id, {_time('max(event_ts)', 'last_change')} FROM fan_chg GROUP BY id_fan
  UNION ALL SELECT 'door', id_door, {_time('min(event_ts)', 'last_change')} FROM door_chg GROUP BY id_door""",
    "light_state": f"""SELECT id_led AS device_id, {_NULLS} AS name,
  arg_max(coalesce(bbc_led <> '0', false), (event_ts, seq)) AS status, {_NULLS} AS location FROM led_chg GROUP BY id_led""",
    "fan_state": f"""SELECT id_fan AS device_id, {_NULLS} AS name,
  arg_max(coalesce(bbc_fan <> '0', false), (event_ts, seq)) AS status, {_NULLS} AS location,
  arg_max(CAST(bbc_control_fan AS INTEGER), (event_ts, seq)) AS speed FROM fan_chg GROUP BY id_fan""",
    "lock_state": f"""SELECT id_door AS device_id, {_NULLS} AS name,
  arg_max(coalesce(bbc_servo <> '0', false), (event_ts, seq)) AS status, {_NULLS} AS location,
  {_LAST.format(c='bbc_password')} AS password FROM door_chg GROUP BY id_door""",
    "light_state_merge_existing": """SELECT coalesce(n.device_id, l.device_id) AS device_id, l.name,
  coalesce(n.status, l.status) AS status, l.location FROM lights l FULL OUTER JOIN
  (SELECT id_led AS device_id, arg_max(coalesce(bbc_led <> '0', false), (event_ts, seq)) AS status FROM led_chg GROUP BY id_led) n
  ON n.device_id = l.device_id""",
    "control_log": "SELECT DISTINCT * FROM control_events",
    "control_log_replay": "SELECT DISTINCT * FROM control_events",
    "temp_window_avg": _avg_out("temp_avg"),
    "hum_window_avg": _avg_out("hum_avg"),
    "temp_window_avg_2h": _avg_out("temp_avg2h"),
    "hum_window_avg_2h": _avg_out("hum_avg2h"),
    "temperature_first_wins": _first_wins("temp_avg"),
    "humidity_first_wins": _first_wins("hum_avg"),
    "temperature_first_wins_2h": _first_wins("temp_avg2h"),
    "temperature_docs_last_wins": """SELECT id || "timestamp" AS doc_id, id, "timestamp", arg_max(avg_value, ws) AS value
  FROM temp_avg GROUP BY id, "timestamp\"""",
    "humidity_documents": """SELECT id || "timestamp" AS doc_id, id,
  strftime(strptime("timestamp", '%Y-%m-%dT%H:%M:%S.%f'), '%Y-%m-%d %H:%M:%S.%g') AS "timestamp", arg_max(avg_value, ws) AS value
  FROM hum_avg GROUP BY id, hum_avg."timestamp\"""",
    "reading_json": """SELECT seq, CAST(json_object('field0', id_temp, 'field1', CAST(bbc_temp AS DOUBLE), 'field2', bbc_name,
  'field3', bbc_password, 'field4', "timestamp") AS VARCHAR) AS json FROM temp_ok""",
    "fan_documents": """SELECT id_fan || "timestamp" AS doc_id, id_fan AS id, bbc_name AS "Status",
  coalesce(bbc_control_fan, '0') AS "Speed", "timestamp" AS stamp, coalesce(bbc_fan, '0') AS "Fan_Status" FROM fan_chg""",
    "door_documents": """SELECT id_door || "timestamp" AS doc_id, id_door AS id, bbc_name AS "Status",
  coalesce(bbc_password, '') AS "Password", "timestamp" AS stamp, coalesce(bbc_servo, '0') AS "Door_Status" FROM door_chg""",
    "led_documents": """SELECT id_led || "timestamp" AS doc_id, id_led AS id, bbc_name AS "Status",
  "timestamp" AS stamp, coalesce(bbc_led, '0') AS "Led_Status" FROM led_chg""",
    "valid_documents": """SELECT id, avg_value AS temperature, name, "timestamp" FROM temp_avg
  WHERE id <> '' AND avg_value IS NOT NULL AND name <> '' AND "timestamp" <> ''""",
    **{n: """SELECT probe_id, name, gallery_idx, round(distance, 6) AS distance, round(confidence, 6) AS confidence FROM matched"""
       for n in ("nearest_match", "nearest_match_blocks")},
    "confident_match": "SELECT probe_id, name, round(confidence, 6) AS confidence FROM matched WHERE name <> 'Unknown' AND confidence > -0.05",
    "frame_numbers": "SELECT session, frame_no, seq FROM detections",
    "confirm_runs": "SELECT session, frame_no, name FROM confirmed3",
    "trigger_messages": """SELECT session, 1 AS step, name AS payload FROM confirmed3
  UNION ALL SELECT session, 2, 'Unknown' FROM confirmed3""",
    "recognition": """SELECT session, 1 AS step, name AS payload FROM sighted_twice
  UNION ALL SELECT session, 2, 'Unknown' FROM sighted_twice""",
    "detection_outcome": """SELECT s.session, coalesce(c.name, 'Unknown') AS name
  FROM (SELECT DISTINCT session FROM detections) s LEFT JOIN confirmed5 c ON c.session = s.session""",
    "carry_forward": """SELECT session, frame_no,
  last_value(CASE WHEN frame_no % 2 = 0 THEN name END IGNORE NULLS) OVER w AS name,
  last_value(CASE WHEN frame_no % 2 = 0 THEN confidence END IGNORE NULLS) OVER w AS confidence
  FROM detections WINDOW w AS (PARTITION BY session ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "sample_frames": "SELECT session, frame_no, name, confidence FROM detections WHERE frame_no % 2 = 0",
    "rescale_boxes": """SELECT session, frame_no, "left" * 2 AS "left", top * 2 AS top, "right" * 2 AS "right", bottom * 2 AS bottom FROM detections""",
    "label_text": "SELECT session, frame_no, printf('%s (%.2f)', name, confidence) AS label FROM detections",
    "parse_commands": "SELECT * FROM parsed",
    "route_commands": """SELECT event_id,
  CASE WHEN action = 'set_speed' THEN 'BBC_CONTROL_FAN' WHEN target = 'fan' THEN 'BBC_FAN' ELSE 'BBC_LED' END AS feed,
  CASE action WHEN 'set_speed' THEN CAST(speed AS VARCHAR) WHEN 'on' THEN '1' ELSE '0' END AS payload
  FROM parsed WHERE action IS NOT NULL""",
    "gallery_stats": "SELECT name, count(*) AS faces FROM gallery GROUP BY name",
    "remove_person": "SELECT name, gallery_idx FROM gallery WHERE name NOT IN ('p3', 'p7')",
    "list_people": "SELECT DISTINCT string_split(path, '/')[-2] AS name FROM images",
    "image_labels": "SELECT path, string_split(path, '/')[-2] AS name, length FROM images",
    "validate_uploads": """SELECT name, count(*) AS files, bool_and(starts_with(content_type, 'image/')) AS all_images,
  count(*) = 5 AND bool_and(starts_with(content_type, 'image/')) AS valid FROM uploads GROUP BY name""",
    "stored_name": "SELECT name, original, name || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || original AS stored_name FROM uploads",
    "capture_name": """SELECT name, shot, name || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || shot || '.jpg' AS stored_name
  FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, original) - 1 AS shot FROM uploads)""",
    "latest_per_feed": "SELECT key, feed, value FROM latest",
    "pair_feeds": "SELECT * FROM paired",
    "complete_pairs": "SELECT * FROM paired WHERE click IS NOT NULL AND view_value IS NOT NULL",
    "led_record": """SELECT device AS id_led, CAST(f_click AS VARCHAR) AS bbc_led, usr AS bbc_name, pw AS bbc_password, "timestamp"
  FROM snapshot WHERE f_click IS NOT NULL""",
    "fan_record": """SELECT device AS id_fan, CAST(f_click AS VARCHAR) AS bbc_fan, CAST(f_view AS VARCHAR) AS bbc_control_fan,
  usr AS bbc_name, pw AS bbc_password, "timestamp" FROM snapshot WHERE f_click IS NOT NULL AND f_view IS NOT NULL""",
    "door_record": """SELECT device AS id_door, CAST(f_purchase AS VARCHAR) AS bbc_servo, usr AS bbc_name,
  CAST(f_signup AS VARCHAR) AS bbc_password, "timestamp" FROM snapshot WHERE f_purchase IS NOT NULL AND f_signup IS NOT NULL""",
    "temperature_record": """SELECT device AS id_temp, CAST(f_error AS FLOAT) AS bbc_temp, usr AS bbc_name, pw AS bbc_password, "timestamp"
  FROM snapshot WHERE f_error IS NOT NULL""",
    "humidity_record": """SELECT device AS id_hum, CAST(f_view AS FLOAT) AS bbc_hum, usr AS bbc_name, pw AS bbc_password, "timestamp"
  FROM snapshot WHERE f_view IS NOT NULL""",
    "with_topic": """SELECT event_id AS seq,
  CASE event_type WHEN 'click' THEN 'led' WHEN 'view' THEN 'fan' WHEN 'purchase' THEN 'door' WHEN 'signup' THEN 'humidity' WHEN 'error' THEN 'temperature' END AS kind,
  CASE event_type WHEN 'click' THEN 'led_schema' WHEN 'view' THEN 'fan_schema' WHEN 'purchase' THEN 'door_schema' WHEN 'signup' THEN 'hum_schema' WHEN 'error' THEN 'tem_schema' END AS topic
  FROM events""",
    "zip_to_map": """SELECT event_id, event_type AS bbc_led, CAST(user_id AS VARCHAR) AS bbc_fan,
  CASE WHEN event_type NOT IN ('click', 'view') THEN CAST(value AS VARCHAR) END AS bbc_servo FROM events""",
    "frame_schema_id": """SELECT k AS kind, event_id AS seq, CAST(id AS BIGINT) AS schema_id
  FROM events, (VALUES ('led', 300), ('fan', 301), ('door', 302), ('humidity', 303), ('temperature', 304)) AS v(k, id)""",
    **{f"stream_{n}_changes": f"SELECT * EXCLUDE (event_ts) FROM {n}_chg" for n in ("led", "fan", "door")},
    "stream_control_log": "SELECT DISTINCT * FROM control_events",
    "stream_control_log_restart": "SELECT DISTINCT * FROM control_events",
    "training_run": """SELECT lang AS name, count(*) FILTER (WHERE strlen(text) > 0) AS faces,
  CAST(sum(strlen(text)) FILTER (WHERE strlen(text) > 0) AS DOUBLE) AS bytes,
  count(*) FILTER (WHERE text IS NULL OR strlen(text) = 0) AS failed FROM documents GROUP BY lang""",
    "wire_round_trip_fan": "SELECT * EXCLUDE (event_ts) FROM fan",
    "wire_round_trip_temp": "SELECT * EXCLUDE (event_ts) FROM temp",
}

BODIES["stream_light_merge_existing"] = BODIES["light_state_merge_existing"]
BODIES["stream_confirm_runs"], BODIES["stream_carry_forward"] = BODIES["confirm_runs"], BODIES["carry_forward"]
BODIES["temp_window_user_avg"] = BODIES["temp_window_avg"]
BODIES["temp_window_extremes"] = f"""SELECT id, {_time('ws', 'window_start')}, min(v) AS low, max(v) AS high,
  arg_min("timestamp", (-v, "timestamp")) AS high_at FROM temp_avg2h_w GROUP BY id, ws"""
BODIES["gallery_retrained"] = """SELECT name, row_number() OVER (ORDER BY path, face) - 1 AS gallery_idx,
  CAST(length(part) - length(replace(part, 'a', '')) AS DOUBLE) AS n_a, CAST(length(part) - length(replace(part, 'e', '')) AS DOUBLE) AS n_e,
  CAST(length(part) AS DOUBLE) AS size
  FROM (SELECT name, path, face, substr(text, 2000 * face + 1, 2000) AS part FROM (
    SELECT lang AS name, 'dataset/' || lang || '/' || doc_id || '.jpg' AS path, text,
      unnest(range(0, (length(text) + 1999) // 2000)) AS face FROM documents WHERE lang <> 'fr'))"""
BODIES["stream_routed_records"] = """SELECT 'led_schema' AS topic, device, f_click AS "first", CAST(NULL AS DOUBLE) AS "second", usr AS name, "timestamp" AS stamp
  FROM snapshot WHERE f_click IS NOT NULL
  UNION ALL SELECT 'fan_schema', device, f_click, f_view, usr, "timestamp" FROM snapshot WHERE f_click IS NOT NULL AND f_view IS NOT NULL
  UNION ALL SELECT 'door_schema', device, f_purchase, f_signup, usr, "timestamp" FROM snapshot WHERE f_purchase IS NOT NULL AND f_signup IS NOT NULL
  UNION ALL SELECT 'tem_schema', device, CAST(CAST(f_error AS FLOAT) AS DOUBLE), NULL, usr, "timestamp" FROM snapshot WHERE f_error IS NOT NULL
  UNION ALL SELECT 'hum_schema', device, CAST(CAST(f_view AS FLOAT) AS DOUBLE), NULL, usr, "timestamp" FROM snapshot WHERE f_view IS NOT NULL"""
# no window says this one: each step looks for the next row that differs from the last kept one
BODIES["changes_two_nullable"] = BODIES["stream_changes_two_nullable"] = """SELECT * EXCLUDE (event_ts, n) FROM (
  WITH RECURSIVE doors AS (SELECT *, row_number() OVER (PARTITION BY id_door ORDER BY event_ts, seq) AS n FROM door WHERE id_door IS NOT NULL),
  kept AS (SELECT id_door, n, bbc_servo, bbc_password FROM doors WHERE n = 1
    UNION ALL SELECT d.id_door, d.n, d.bbc_servo, d.bbc_password FROM (
      SELECT k.id_door, min(d.n) AS n FROM kept k JOIN doors d ON d.id_door = k.id_door AND d.n > k.n
        AND (d.bbc_servo <> k.bbc_servo OR d.bbc_password <> k.bbc_password) GROUP BY k.id_door) x
      JOIN doors d ON d.id_door = x.id_door AND d.n = x.n)
  SELECT doors.* FROM doors JOIN kept ON kept.id_door = doors.id_door AND kept.n = doors.n)"""


def _needed(sql, found):
    """Views a text mentions, dependencies first."""
    import re
    for name in VIEWS:
        if name not in found and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
            _needed(VIEWS[name], found)
            found[name] = VIEWS[name]
    return found


def _with_views(sql):
    views = _needed(sql, {})
    if not views:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in views.items()) + "\n" + sql


ORACLES = {name: _with_views(sql) for name, sql in BODIES.items()}
