"""People and their images: uploads, folders, gallery upkeep."""

from pyspark.sql import DataFrame, functions as F

from homestream.operators.timeline import number_all
from homestream.schemas import GALLERY

IMAGES_PER_PERSON = 5


def with_label(images: DataFrame, path="path", out="name") -> DataFrame:
    """Label of an image: the folder it lies in."""
    return images.withColumn(out, F.element_at(F.split(F.col(path), "/"), -2))


def list_people(images: DataFrame) -> DataFrame:
    return with_label(images).select("name").distinct()


def validate_uploads(uploads: DataFrame, n=IMAGES_PER_PERSON, key="name") -> DataFrame:
    """Per request: number of files, whether all are images, and whether it is accepted."""
    image = F.coalesce(F.col("content_type").startswith("image/"), F.lit(False))
    return (
        uploads.groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.bool_and(image).alias("all_images"))
        .withColumn("valid", (F.col("files") == n) & F.col("all_images"))
    )


def stored_name(uploads: DataFrame, out="stored_name") -> DataFrame:
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    return uploads.withColumn(out, F.concat_ws("_", F.col("name"), stamp, F.col("original")))


def capture_name(shots: DataFrame, out="stored_name") -> DataFrame:
    """Name of a camera shot: its number within the capture takes the place of the file name."""
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    return shots.withColumn(out, F.format_string("%s_%s_%d.jpg", F.col("name"), stamp, F.col("shot")))


def remove_person(gallery: DataFrame, names) -> DataFrame:
    """Gallery without the named people; ``names`` is a list or a DataFrame with a name column."""
    if isinstance(names, DataFrame):
        return gallery.join(names.select("name").distinct(), "name", "left_anti").select(*gallery.columns)
    return gallery.filter(~F.col("name").isin(list(names)) | F.col("name").isNull())


def gallery_stats(gallery: DataFrame) -> DataFrame:
    return gallery.groupBy("name").agg(F.count(F.lit(1)).alias("faces"))


def encode_images(images: DataFrame, encode_fn) -> DataFrame:
    """(path, name, face_no, encoding, error): n rows per image, one row with ``error`` if none.

    ``encode_fn(bytes) -> list of vectors`` is the caller's model; it runs inside the tasks. An image
    it raises on, or in which it finds no face, is reported and does not stop the job.
    """
    def run(batches):
        import pandas as pd
        for pdf in batches:
            out = []
            for path, name, content in zip(pdf["path"], pdf["name"], pdf["content"]):
                try:
                    vectors = list(encode_fn(content))
                    error = None if vectors else "no face"
                except Exception as e:
                    vectors, error = [], f"{type(e).__name__}: {e}"
                out += [(path, name, i, [float(x) for x in v], None) for i, v in enumerate(vectors)]
                if error:
                    out.append((path, name, None, None, error))
            frame = pd.DataFrame(out, columns=["path", "name", "face_no", "encoding", "error"])
            yield frame.astype({"face_no": "Int64"})

    return with_label(images).select("path", "name", "content").mapInPandas(
        run, "path string, name string, face_no long, encoding array<float>, error string")


def unseen_images(images: DataFrame, seen: DataFrame) -> DataFrame:
    """One image (digest, path, content) of each content that ``seen`` (digest) doesn't hold.

    Which image stands for a content is settled on narrow rows; only what is left is read with its content.
    """
    known = with_digest(images)
    chosen = known.groupBy("digest").agg(F.min("path").alias("path")).join(seen.select("digest"), "digest", "left_anti")
    return known.join(chosen, ["digest", "path"], "left_semi").dropDuplicates(["digest"])


def with_digest(images: DataFrame) -> DataFrame:
    return images.withColumn("digest", F.unhex(F.sha2(F.coalesce("content", F.lit(b"")), 256)))


def encodings_of(images: DataFrame, encodings: DataFrame) -> DataFrame:
    """(path, name, face_no, encoding, error) of every image by its content's encodings (digest, face_no, encoding, error)."""
    rows = with_digest(with_label(images)).select("path", "name", "digest")
    return rows.join(encodings, "digest").select("path", "name", "face_no", "encoding", "error")


def rebuild_gallery(encoded: DataFrame) -> DataFrame:
    """Gallery rows of all encoded faces, numbered in path order (the order that settles ties)."""
    faces = encoded.filter("error IS NULL").select("path", "face_no", "name", "encoding")
    return number_all(faces, ["path", "face_no"], "gallery_idx").select("name", "gallery_idx", "encoding").to(GALLERY)
