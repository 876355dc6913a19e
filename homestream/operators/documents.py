"""Index documents of the device streams."""

from pyspark.sql import DataFrame, functions as F

from homestream.functions.columns import wire_time
from homestream.schemas import KINDS


def device_documents(changes: DataFrame, kind: str) -> DataFrame:
    """One document per change; doc_id = device ‖ timestamp, missing texts '' and states '0'."""
    k = KINDS[kind]

    def text(col, default=""):
        return F.coalesce(F.col(col), F.lit(default))

    fields = [text(k.key).alias("id"), text("bbc_name").alias("Status")]
    if kind == "fan":
        fields.append(text("bbc_control_fan", "0").alias("Speed"))
    if kind == "door":
        fields.append(text("bbc_password").alias("Password"))
    state = {"fan": ("bbc_fan", "Fan_Status"), "door": ("bbc_servo", "Door_Status"),
             "led": ("bbc_led", "Led_Status")}[kind]
    return changes.select(
        F.concat(text(k.key), text("timestamp")).alias("doc_id"), *fields,
        F.col("timestamp").alias("Timestamp"), text(state[0], "0").alias(state[1]),
    )


def humidity_documents(averages: DataFrame) -> DataFrame:
    """Average documents with a parsed timestamp instead of the wire string."""
    return averages.select(
        F.concat(F.coalesce("id", F.lit("")), F.coalesce("timestamp", F.lit(""))).alias("doc_id"),
        F.coalesce("id", F.lit("")).alias("id"), wire_time(F.col("timestamp")).alias("timestamp"),
        F.coalesce("avg_value", F.lit(0.0)).alias("value"), "window_start",
    )


def valid_documents(averages: DataFrame) -> DataFrame:
    """Named documents; a row with an empty id, value, name or timestamp is left out."""
    filled = averages.filter("avg_value IS NOT NULL")
    for c in ("id", "name", "timestamp"):
        filled = filled.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    return filled.select("id", F.col("avg_value").alias("temperature"), "name", "timestamp")
