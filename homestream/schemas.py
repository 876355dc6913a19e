"""Explicit schemas of the device events and the keyed target tables.

Nothing is inferred: every reader gets one of these, and every field is nullable.
"""

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


STRING, FLOAT, DOUBLE = T.StringType(), T.FloatType(), T.DoubleType()

# Field names and types of the five device events, in wire order.
LED = _struct(
    ("id_led", STRING), ("bbc_led", STRING),
    ("bbc_name", STRING), ("bbc_password", STRING), ("timestamp", STRING),
)
FAN = _struct(
    ("id_fan", STRING), ("bbc_fan", STRING), ("bbc_control_fan", STRING),
    ("bbc_name", STRING), ("bbc_password", STRING), ("timestamp", STRING),
)
DOOR = _struct(
    ("id_door", STRING), ("bbc_servo", STRING),
    ("bbc_name", STRING), ("bbc_password", STRING), ("timestamp", STRING),
)
HUMIDITY = _struct(
    ("id_hum", STRING), ("bbc_hum", FLOAT),
    ("bbc_name", STRING), ("bbc_password", STRING), ("timestamp", STRING),
)
TEMPERATURE = _struct(
    ("id_temp", STRING), ("bbc_temp", FLOAT),
    ("bbc_name", STRING), ("bbc_password", STRING), ("timestamp", STRING),
)


@dataclass(frozen=True)
class DeviceKind:
    """What the engine has to know about one kind of device.

    ``steady`` are the watched fields that cleaning leaves non-null, ``watched_nullable`` is the
    watched field that may still be null, ``reading`` is the measured field of a sensor.
    """

    name: str
    topic: str
    schema: T.StructType
    key: str
    feeds: tuple
    steady: tuple = ()
    watched_nullable: str | None = None
    reading: str | None = None


# Topic and feed names per kind.
KINDS = {
    k.name: k
    for k in (
        DeviceKind("led", "led_schema", LED, "id_led", ("bbc-led",),
                   watched_nullable="bbc_led"),
        DeviceKind("fan", "fan_schema", FAN, "id_fan", ("bbc-fan", "bbc-control-fan"),
                   steady=("bbc_control_fan",), watched_nullable="bbc_fan"),
        DeviceKind("door", "door_schema", DOOR, "id_door", ("bbc-servo", "bbc-password"),
                   steady=("bbc_servo",), watched_nullable="bbc_password"),
        DeviceKind("humidity", "hum_schema", HUMIDITY, "id_hum", ("bbc-humidity",),
                   reading="bbc_hum"),
        DeviceKind("temperature", "tem_schema", TEMPERATURE, "id_temp", ("bbc-temperature",),
                   reading="bbc_temp"),
    )
}

FAN_STATE = _struct(
    ("device_id", STRING), ("name", STRING), ("status", T.BooleanType()),
    ("location", STRING), ("speed", T.IntegerType()),
)
LOCK_STATE = _struct(
    ("device_id", STRING), ("name", STRING), ("status", T.BooleanType()),
    ("location", STRING), ("password", STRING),
)
LIGHT_STATE = _struct(
    ("device_id", STRING), ("name", STRING), ("status", T.BooleanType()), ("location", STRING),
)
CONTROL_LOG = _struct(("device_id", STRING), ("username", STRING), ("control_time", STRING))
READING_LOG = _struct(("location", STRING), ("record_time", STRING), ("value", DOUBLE))
DOCUMENT = _struct(("doc_id", STRING), ("id", STRING), ("timestamp", STRING), ("value", DOUBLE))
GALLERY = _struct(
    ("name", STRING), ("gallery_idx", T.LongType()), ("encoding", T.ArrayType(FLOAT)),
)
