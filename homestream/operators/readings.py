"""Sensor readings and their sliding averages."""

from pyspark.sql import DataFrame, functions as F

from homestream.functions.columns import duration_micros, reading_json as _reading_json
from homestream.operators.clean import settle
from homestream.schemas import KINDS

PAYLOAD = ("name", "password", "timestamp")


def to_reading(df: DataFrame, kind: str, on_error="drop") -> DataFrame:
    """(id, value, name, password, timestamp) plus whatever ordering columns the input carries.

    A float reading widens to double before anything is summed. A reading without name, password
    or timestamp is a reject.
    """
    k = KINDS[kind]
    extra = [c for c in df.columns if c not in k.schema.fieldNames()]
    out = df.select(
        F.col(k.key).alias("id"),
        F.col(k.reading).cast("double").alias("value"),
        F.col("bbc_name").alias("name"),
        F.col("bbc_password").alias("password"),
        F.col("timestamp"),
        *extra,
    )
    incomplete = F.col("name").isNull() | F.col("password").isNull() | F.col("timestamp").isNull()
    return settle(out, incomplete, "reading", on_error)


def reading_json(df: DataFrame, out="json") -> DataFrame:
    return df.select(
        "*", _reading_json(*[F.col(c) for c in ("id", "value", *PAYLOAD)]).alias(out)
    )


def _first(cols, order):
    """First arrival's payload; an equal timestamp is settled by the next order column."""
    return F.min_by(F.struct(*cols), F.struct(*order))


def sliding_average(df: DataFrame, ts="event_ts", order=None, size="2 minutes", slide="1 minute",
                    watermark="1 second", time="event") -> DataFrame:
    """Average per id and sliding window with the payload of the first reading in it.

    ``time="processing"`` windows by the wall clock instead of event time.

    Batch: readings are first folded into panes of one slide, so each row is aggregated once and
    only pane totals are copied into the windows that cover them; both steps combine map-side and
    group by (id, time), which spreads a hot device. Streaming: one stateful ``window()``
    aggregation, because panes would need a second state store and double the output delay.
    """
    if time == "processing":
        df = df.withColumn(ts, F.current_timestamp())
    elif time != "event":
        raise ValueError("time must be 'event' or 'processing'")
    order = list(order or ([ts, "seq"] if "seq" in df.columns else [ts]))
    size_us, slide_us = duration_micros(size), duration_micros(slide)

    if df.isStreaming or size_us % slide_us:
        if df.isStreaming and watermark:
            df = df.withWatermark(ts, watermark)
        sums = (
            df.groupBy("id", F.window(ts, size, slide).alias("w"))
            .agg(F.avg("value").alias("avg_value"), F.count("value").alias("readings"),
                 _first(PAYLOAD, order).alias("first"))
        )
        return sums.select(
            "id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            F.coalesce("avg_value", F.lit(0.0)).alias("avg_value"), "readings",
            *[F.col(f"first.{c}").alias(c) for c in PAYLOAD],
        )

    panes = (
        df.groupBy("id", F.window(ts, slide).start.alias("pane"))
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"),
             F.min_by(F.struct(*PAYLOAD, F.struct(*order).alias("at")), F.struct(*order)).alias("first"))
    )
    offsets = F.array(*[F.expr(f"make_dt_interval(0, 0, 0, {-i * slide_us / 1e6:.6f})")
                        for i in range(size_us // slide_us)])
    covered = panes.select("id", "total", "n", "first",
                           F.explode(F.transform(offsets, lambda o: F.col("pane") + o)).alias("window_start"))
    return (
        covered.groupBy("id", "window_start")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("readings"),
             F.min_by("first", "first.at").alias("first"))
        .select(
            "id", "window_start",
            (F.col("window_start") + F.expr(f"make_dt_interval(0, 0, 0, {size_us / 1e6:.6f})")).alias("window_end"),
            F.when(F.col("readings") > 0, F.col("total") / F.col("readings")).otherwise(0.0).alias("avg_value"),
            "readings",
            *[F.col(f"first.{c}").alias(c) for c in PAYLOAD],
        )
    )


def reading_rows(averages: DataFrame) -> DataFrame:
    """Window averages as rows of the reading log; ``window_start`` is kept for ordering."""
    return averages.select(
        F.col("id").alias("location"), F.col("timestamp").alias("record_time"),
        F.col("avg_value").alias("value"), "window_start",
    )


def average_documents(averages: DataFrame) -> DataFrame:
    """Window averages as index documents; doc_id = id ‖ timestamp, nulls become '' or 0.0."""
    ident, stamp = F.coalesce("id", F.lit("")), F.coalesce("timestamp", F.lit(""))
    return averages.select(
        F.concat(ident, stamp).alias("doc_id"), ident.alias("id"), stamp.alias("timestamp"),
        F.coalesce("avg_value", F.lit(0.0)).alias("value"), "window_start",
    )
