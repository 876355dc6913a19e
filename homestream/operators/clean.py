"""Validation of device events: required ids, strict parsing, ranges, and what to do with rejects.

A malformed row never kills the job by default. ``on_error`` is one of

* ``drop``        leave the row out,
* ``quarantine``  keep it with ``reject_reason`` set; split with :func:`accepted` / :func:`rejected`,
* ``fail``        raise when such a row is read.
"""

from pyspark.sql import DataFrame, functions as F

from homestream.functions.columns import masked, strict_int, wire_time
from homestream.schemas import KINDS

REASON = "reject_reason"


def settle(df: DataFrame, bad, reason: str, on_error: str) -> DataFrame:
    """Apply one reject rule. ``bad`` must not be null for any row."""
    if on_error == "drop":
        return df.filter(~bad)
    if on_error == "fail":
        return df.filter(F.when(bad, F.raise_error(F.lit(reason)).cast("boolean")).otherwise(True))
    if on_error == "quarantine":
        mark = F.when(bad, F.lit(reason))
        known = F.col(REASON) if REASON in df.columns else None
        return df.withColumn(REASON, mark if known is None else F.coalesce(known, mark))
    raise ValueError(f"on_error must be drop, quarantine or fail, not {on_error!r}")


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNull()).drop(REASON) if REASON in df.columns else df


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNotNull()) if REASON in df.columns else df.limit(0)


def require_not_null(df: DataFrame, cols) -> DataFrame:
    for c in [cols] if isinstance(cols, str) else cols:
        df = df.filter(F.col(c).isNotNull())
    return df


def in_range(df: DataFrame, col: str, lo=0.0, hi=150.0) -> DataFrame:
    """Keep lo <= value <= hi. Null and NaN readings are not in any range."""
    return df.filter(F.col(col).between(lo, hi))


def with_event_time(df: DataFrame, col="timestamp", out="event_ts", on_null="now",
                    on_error="quarantine", lenient=False, watermark=None) -> DataFrame:
    """Parse the wire timestamp. A missing one takes the wall clock, a malformed one is a reject."""
    parsed = wire_time(F.col(col), lenient)
    bad = F.col(col).isNotNull() & parsed.isNull()
    if on_null == "now":
        value = F.when(F.col(col).isNull(), F.current_timestamp()).otherwise(parsed)
    elif on_null == "null":
        value = parsed
    else:
        raise ValueError("on_null must be 'now' or 'null'")
    df = settle(df, bad, "timestamp", on_error).withColumn(out, value)
    return df.withWatermark(out, watermark) if watermark else df


def clean_led(df: DataFrame) -> DataFrame:
    return require_not_null(df, "id_led")


def clean_fan(df: DataFrame, on_error="drop") -> DataFrame:
    """Id present, control present and not negative; a control that is no integer is a reject."""
    df = require_not_null(df, ["id_fan", "bbc_control_fan"])
    control = strict_int(F.col("bbc_control_fan"))
    df = df.filter(control.isNull() | (control >= 0))
    return settle(df, control.isNull(), "bbc_control_fan", on_error)


def clean_door(df: DataFrame) -> DataFrame:
    return require_not_null(df, ["id_door", "bbc_servo"])


def clean_sensor(df: DataFrame, kind: str, lo=0.0, hi=150.0, on_error="drop") -> DataFrame:
    """Id present and reading in range; a missing reading is a reject."""
    k = KINDS[kind]
    df = require_not_null(df, k.key)
    if on_error == "drop":
        return in_range(df, k.reading, lo, hi)
    missing = F.col(k.reading).isNull()
    return settle(df.filter(missing | F.col(k.reading).between(lo, hi)), missing, k.reading, on_error)


def clean_device(df: DataFrame, kind: str, on_error="drop") -> DataFrame:
    if kind == "led":
        return clean_led(df)
    if kind == "fan":
        return clean_fan(df, on_error)
    if kind == "door":
        return clean_door(df)
    return clean_sensor(df, kind, on_error=on_error)


def mask_secrets(df: DataFrame, cols=("bbc_password", "password")) -> DataFrame:
    """Replace passwords by their digest; equal secrets stay equal, so change detection is unmoved."""
    return df.withColumns({c: masked(F.col(c)) for c in cols if c in df.columns})
