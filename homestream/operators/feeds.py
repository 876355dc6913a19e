"""From feed values to device records: snapshot, pairing, completeness, assembly, routing."""

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.functions.columns import packed_order, wire_text
from homestream.operators.timeline import cols
from homestream.schemas import KINDS


def latest_per_feed(df: DataFrame, key="key", feed="feed", value="value", order=("ts", "seq")) -> DataFrame:
    """Last value of each feed; the aggregate combines map-side, so a busy feed is no hot spot.

    A time and a number make one fixed-width order: with a fixed-width value nothing is sorted.
    """
    order = cols(order)
    kinds = [df.schema[c].dataType for c in order]
    packed = len(order) == 2 and isinstance(kinds[0], T.TimestampType) and isinstance(kinds[1], T.IntegralType)
    at = packed_order(*[F.col(c) for c in order]) if packed else F.struct(*order)
    return df.groupBy(*cols(key), feed).agg(F.max_by(value, at).alias(value))


def pair_feeds(snapshot: DataFrame, key="key", feeds=(), feed="feed", value="value", names=None, more=()) -> DataFrame:
    """One row per key with one column per feed, null where a feed has no value. ``more``: further aggregates."""
    names = names or feeds
    return snapshot.groupBy(*cols(key)).agg(
        *[F.max(F.when(F.col(feed) == f, F.col(value))).alias(n) for f, n in zip(feeds, names)], *more
    )


def complete_only(df: DataFrame, fields) -> DataFrame:
    """A record is built only when every feed it needs has a value."""
    return df.dropna(how="any", subset=list(fields))


def assemble_device_record(df: DataFrame, kind: str, device, values, name, password, ts) -> DataFrame:
    """Device record in wire layout. ``values`` are the feed columns in feed order.

    A door's second feed is its password; other kinds carry the user's password.
    """
    k = KINDS[kind]
    fields = {k.key: F.col(device)}
    if k.reading:
        fields[k.reading] = F.col(values[0]).cast("float")
    elif kind == "fan":
        fields.update(bbc_fan=F.col(values[0]).cast("string"), bbc_control_fan=F.col(values[1]).cast("string"))
    elif kind == "door":
        fields["bbc_servo"] = F.col(values[0]).cast("string")
    else:
        fields["bbc_led"] = F.col(values[0]).cast("string")
    fields["bbc_name"] = F.col(name)
    fields["bbc_password"] = F.col(values[1]).cast("string") if kind == "door" else F.col(password)
    fields["timestamp"] = wire_text(F.col(ts))
    return complete_only(df, values).select(*[fields[f].alias(f) for f in k.schema.fieldNames()])


def with_topic(df: DataFrame, kind_col="kind", out="topic") -> DataFrame:
    """Topic of each record's kind; null for a kind nobody listens to."""
    pairs = [F.lit(x) for k in KINDS.values() for x in (k.name, k.topic)]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(kind_col)))
