import pytest

from homestream.operators import clean, wire
from homestream.schemas import KINDS

HEAD = b"\x00\x00\x00\x01\x2c"


def test_round_trip(spark):
    rows = [("t1", 21.5, "Ánh", "пароль", "x" * 9000), (None, None, None, None, None), ("", -0.0, "a", "b", "c")]
    df = spark.createDataFrame(rows, KINDS["temperature"].schema).repartition(2)
    frames = wire.encode_frames(df, "temperature", 300)
    assert {r[0] for r in frames.select(wire.schema_id("value")).collect()} == {300}
    back = wire.decode_frames(frames, "temperature", on_error="fail")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_known_bytes(spark):
    df = spark.createDataFrame([("a", None, "b", None, "é")], KINDS["led"].schema)
    assert bytes(wire.encode_frames(df, "led", 1).first()[0]) == b"\0\0\0\0\1" + b"\2\2a" + b"\0" + b"\2\2b" + b"\0" + b"\2\4\xc3\xa9"


def test_bad_frames(spark):
    bad = [None, b"", b"abc", HEAD, HEAD + b"\2\2a\0\0\0\4", HEAD + b"\2\3a\0\0\0\0", HEAD + b"\2\xff\xff\xff\xff\xff\xff",
           HEAD + b"\2\x0ashort", HEAD + b"\x06\2a\0\0\0\0"]
    good = [HEAD + b"\0" * 5, HEAD + b"\2\2a" + b"\0" * 4 + b"tail", HEAD + b"\2\4\xff\xfe" + b"\0" * 4]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(bad + good)], "i int, value binary").coalesce(1)
    marked = wire.decode_frames(df, "led")
    assert sorted(r.i for r in clean.rejected(marked).collect()) == list(range(len(bad)))
    assert {r.i: r.id_led for r in clean.accepted(marked).collect()} == {9: None, 10: "a", 11: "��"}
    assert {r.i: r.schema_id for r in clean.rejected(marked).collect()}[3] == 300
    assert wire.decode_frames(df, "led", on_error="drop").count() == len(good)
    with pytest.raises(Exception, match="unreadable"):
        wire.decode_frames(df, "led", on_error="fail").collect()
