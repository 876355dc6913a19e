"""Device event sources."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from homestream.operators.wire import decode_frames
from homestream.schemas import KINDS


def read_device_stream(spark: SparkSession, kind, path=None, kafka=None, starting="latest",
                       max_per_trigger=None, extra=(), on_error="quarantine") -> DataFrame:
    """Streaming frame of one device kind.

    ``kafka``: broker options; the kind's topic is subscribed under its own group, the frames are
    decoded and the offset becomes ``seq``. ``path``: a folder of parquet files in the kind's schema
    (plus ``extra`` fields). ``max_per_trigger`` bounds a micro-batch, in offsets or files.
    """
    k = KINDS[kind]
    if (path is None) == (kafka is None):
        raise ValueError("give either path or kafka")
    if path is not None:
        schema = T.StructType(k.schema.fields + list(extra))
        reader = spark.readStream.schema(schema)
        if max_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_per_trigger)
        return reader.parquet(path)
    reader = (spark.readStream.format("kafka").option("subscribe", k.topic)
              .option("kafka.group.id", f"{kind}-group").option("startingOffsets", starting).options(**kafka))
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return decode_frames(reader.load().select("value", F.col("offset").alias("seq")), kind, on_error=on_error)


def read_device_table(spark: SparkSession, kind, path, extra=()) -> DataFrame:
    return spark.read.schema(T.StructType(KINDS[kind].schema.fields + list(extra))).parquet(path)
