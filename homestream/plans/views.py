"""Device, frame, transcript, feed and upload views derived from the test tables.

Each view is a projection of a whole table. The modulo rules only place nulls and malformed values;
they remove no row. The same views exist as SQL in :mod:`homestream.plans.oracles`.
"""

import uuid

from pyspark.sql import functions as F

from homestream.functions.columns import wire_text
from homestream.operators.timeline import number_rows
from homestream.session import shared_dir


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df, *order, least=4):
    """The rows as files in ``order``, read back as a stream of one file per micro-batch, the oldest first.

    One range shuffle writes them all; a file's place in the order becomes its modification time, which is what a file
    source goes by. As many files as the input has splits, so a micro-batch is bounded by the size of a split.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "staged", uuid.uuid4().hex)
    n = max(least, df.rdd.getNumPartitions())
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    for i, f in enumerate(files):
        fs.setTimes(f, 1_700_000_000_000 + 1000 * i, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def event_stream(spark, sf_dir):
    """The events table as a stream in time order, in several micro-batches."""
    return staged(table(spark, sf_dir, "events"), "ts", "event_id")


def _events(spark, sf_dir, stream=False):
    e = event_stream(spark, sf_dir) if stream else table(spark, sf_dir, "events")
    return e.withColumn("at", F.col("ts").cast("timestamp"))


def _every(n):
    return F.col("event_id") % n == 0


def _device_id(prefix, n, null_every):
    return F.when(~_every(null_every), F.concat(F.lit(prefix), (F.col("user_id") % n).cast("string")))



def _on():
    return F.col("event_type").isin("click", "purchase")


def _flag(cond):
    return F.when(cond, "1").otherwise("0")


def _common(password=None):
    return [
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("bbc_name"),
        (password if password is not None else _password()).alias("bbc_password"),
        wire_text(F.col("at")).alias("timestamp"),
        F.col("at").alias("event_ts"),
        F.col("event_id").alias("seq"),
    ]


def _password():
    return F.concat(F.lit("pw-"), (F.col("user_id") % 3).cast("string"))


def led(spark, sf_dir, stream=False):
    return _events(spark, sf_dir, stream).select(
        _device_id("led-", 50, 101).alias("id_led"),
        F.when(_every(13), None).otherwise(_flag(_on())).alias("bbc_led"),
        *_common(),
    )


def fan(spark, sf_dir, stream=False):
    return _events(spark, sf_dir, stream).select(
        _device_id("fan-", 20, 101).alias("id_fan"),
        F.when(_every(11), None).otherwise(_flag(_on())).alias("bbc_fan"),
        F.when(_every(23), None).when(_every(29), "-5").when(_every(97), "abc")
        .otherwise(F.floor(F.col("value") / 100).cast("int").cast("string")).alias("bbc_control_fan"),
        *_common(),
    )


def door(spark, sf_dir, stream=False):
    return _events(spark, sf_dir, stream).select(
        _device_id("door-", 20, 101).alias("id_door"),
        F.when(_every(31), None).otherwise(_flag(F.col("event_type") == "signup")).alias("bbc_servo"),
        *_common(F.when(~_every(7), _password())),
    )


def temperature(spark, sf_dir, stream=False):
    return _events(spark, sf_dir, stream).select(
        _device_id("temp-", 20, 101).alias("id_temp"),
        F.when(~_every(19), F.col("value").cast("float")).alias("bbc_temp"),
        *_common(),
    )


def humidity(spark, sf_dir, stream=False):
    return _events(spark, sf_dir, stream).select(
        _device_id("hum-", 10, 103).alias("id_hum"),
        F.when(~_every(17), (F.col("value") * 0.5 - 5).cast("float")).alias("bbc_hum"),
        *_common(),
    )


DEVICES = {"led": led, "fan": fan, "door": door, "temperature": temperature, "humidity": humidity}


def detections(spark, sf_dir, times=False):
    """Recognition results: a session's numbered frames with name and confidence; ``times`` keeps event_ts."""
    error = F.col("event_type") == "error"
    rows = _events(spark, sf_dir).select(
        (F.col("user_id") % 50).alias("session"), F.col("at"), F.col("event_id").alias("seq"),
        F.when(error, "Unknown").otherwise(F.col("event_type")).alias("name"),
        F.when(error, 0.0).otherwise(F.col("value") / 100).alias("confidence"),
        F.floor("value").cast("int").alias("top"),
        (F.floor("value") + 40).cast("int").alias("right"),
        (F.floor("value") + 60).cast("int").alias("bottom"),
        (F.col("user_id") % 640).cast("int").alias("left"),
    )
    numbered = number_rows(rows, "session", ["at", "seq"], "frame_no")
    return numbered.withColumnRenamed("at", "event_ts") if times else numbered.drop("at")


def detection_stream(spark, sf_dir):
    """The same as a stream, in time order."""
    return staged(detections(spark, sf_dir, times=True), "event_ts", "seq")


def transcripts(spark, sf_dir):
    speed = F.floor("value").cast("int").cast("string")
    kind = F.col("event_id") % 8
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == 0, "Bật quạt giúp tôi").when(kind == 1, "tắt quạt").when(kind == 2, "BẬT ĐÈN")
        .when(kind == 3, "tắt đèn phòng khách").when(kind == 4, F.concat(F.lit("Tốc độ quạt "), speed))
        .when(kind == 5, F.concat(F.lit("tốc độ quạt lên "), speed, F.lit(" rồi bật quạt")))
        .when(kind == 6, "xin chào").alias("text"),
    )


def feeds(spark, sf_dir):
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("key"), F.col("event_type").alias("feed"), "value",
        F.col("at").alias("ts"), F.col("event_id").alias("seq"),
    )


def feed_stream(spark, sf_dir):
    return staged(feeds(spark, sf_dir), "ts", "seq")


def uploads(spark, sf_dir):
    """One upload request per user and day, so request sizes vary."""
    return _events(spark, sf_dir).select(
        F.concat(F.lit("p-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("at", "yyyyMMdd")).alias("name"),
        F.when(F.col("event_type") == "error", "text/plain").otherwise("image/jpeg").alias("content_type"),
        F.concat(F.col("event_id").cast("string"), F.lit(".jpg")).alias("original"),
        F.col("at").alias("ts"),
    )


def images(spark, sf_dir, content=False):
    return table(spark, sf_dir, "documents").select(
        *([F.col("text").cast("binary").alias("content")] if content else []),
        F.concat(F.lit("dataset/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"),
        F.col("n_chars").alias("length"),
    )


def gallery(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("name"),
        F.col("vec_id").alias("gallery_idx"), F.col("embedding").alias("encoding"),
    )


def probes(spark, sf_dir):
    """Every vector read back to front: same norm as the gallery, but no trivial self match."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("probe_id"), F.reverse("embedding").alias("encoding"),
    )


def stamps(spark, sf_dir):
    """Wire timestamps as a careless producer writes them: short fractions, none, junk, missing."""
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.when(_every(37), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(_every(41), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
        .when(_every(43), F.concat(F.lit("at "), F.col("user_id").cast("string")))
        .when(~_every(47), wire_text(F.col("at"))).alias("timestamp"),
    )


def lights(spark, sf_dir):
    """A Light table that is already there: named, placed lamps, some of which never report."""
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("led-"), (F.col("n_nationkey") * 3).cast("string")).alias("device_id"),
        F.col("n_name").alias("name"), (F.col("n_regionkey") == 1).alias("status"),
        F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("location"),
    )


def event_kinds(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(kind == "click", "led").when(kind == "view", "fan").when(kind == "purchase", "door")
        .when(kind == "signup", "humidity").when(kind == "error", "temperature").alias("kind"),
    )
