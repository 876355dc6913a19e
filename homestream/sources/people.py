"""Image folders, encodings by content, and the stored gallery."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from homestream.operators.people import encode_images, encodings_of, rebuild_gallery, unseen_images, with_digest, with_label
from homestream.schemas import GALLERY
from homestream.streaming.sinks import KeyedTable, _children

# What counts as an image file, in any case.
IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")


def _glob():
    any_case = ["".join(f"[{c}{c.upper()}]" for c in t) for t in IMAGE_TYPES]
    return "*.{" + ",".join(any_case) + "}"


def scan_images(spark: SparkSession, folder) -> DataFrame:
    """All images below a folder with content and person (the parent folder's name)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", _glob()).load(folder))
    return with_label(files)


def _store(spark, path):
    # one version only: a removed person's vectors must not stay readable in older ones
    return KeyedTable(spark, path, GALLERY, keep=1)


def load_gallery(spark: SparkSession, path) -> DataFrame:
    """The stored gallery; empty when nothing was saved yet."""
    return _store(spark, path).read()


def save_gallery(gallery: DataFrame, path):
    _store(gallery.sparkSession, path).write(gallery)


def clear_gallery(spark: SparkSession, path):
    save_gallery(spark.createDataFrame([], GALLERY), path)


class EncodingStore:
    """What the model found in each content, once: (digest, face_no, encoding, error) as batches in a folder. A batch
    counts once its job has committed. Images without a face and images that the model failed on are held too."""

    SCHEMA = "digest binary, face_no long, encoding array<float>, error string"

    def __init__(self, spark, path):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        done = [n for n in _children(self.spark, self.path) if "_SUCCESS" in _children(self.spark, f"{self.path}/{n}")]
        if not done:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{n}" for n in done])

    def update(self, images: DataFrame, encode_fn) -> None:
        """Encode the contents that aren't known yet."""
        new = unseen_images(images, self.read())
        encoded = encode_images(new.withColumn("path", F.concat(F.lit("/"), F.hex("digest"), F.lit("/x"))), encode_fn)
        encoded.select(F.unhex("name").alias("digest"), "face_no", "encoding", "error").write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def keep_only(self, images: DataFrame) -> None:
        """Forget the contents that no image holds any more: a removed person's vectors must not stay."""
        rows = self.read()
        old = _children(self.spark, self.path)
        held = with_digest(images).select("digest").distinct()
        rows.join(held, "digest", "left_semi").write.parquet(f"{self.path}/{uuid.uuid4().hex}")
        for name in old:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def retrain(images: DataFrame, encode_fn, store: EncodingStore, gallery_path) -> DataFrame:
    """The gallery of all people whose images are left; cleared where nobody is. Only unseen contents are encoded."""
    spark = images.sparkSession
    if images.isEmpty():
        clear_gallery(spark, gallery_path)
    else:
        store.update(images, encode_fn)
        save_gallery(rebuild_gallery(encodings_of(images, store.read())), gallery_path)
    return load_gallery(spark, gallery_path)


def remove_people(images: DataFrame, names, encode_fn, store: EncodingStore, gallery_path) -> DataFrame:
    """Take people away: their images don't count, their vectors are forgotten, the gallery is rebuilt or cleared."""
    left = with_label(images).filter(~F.coalesce(F.col("name").isin(list(names)), F.lit(False))).select(images.columns)
    gallery = retrain(left, encode_fn, store, gallery_path)
    store.keep_only(left)
    return gallery
