"""Helpers shared by the operators: shared folder, written intermediates, text columns, Arrow batches."""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from homestream.session import shared_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, the folder that driver and executors share."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: cuts the lineage, so that a lost executor
    costs no recomputation, and lets several jobs read one result."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the folder of a frame that :func:`written` made and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def kept_rows(df: DataFrame, decided: DataFrame, keys: dict, best: Column) -> DataFrame:
    """The rows of ``df`` that stay, one for each key that does.

    ``decided`` holds every key of ``df`` once, with ``stays`` and the number ``n`` of its rows; ``keys`` gives a key's
    columns as expressions over ``df``. Of several rows under a key that stays, the one with the greatest ``best``
    does; of rows alike in that, any one. Rows under a key of their own are never grouped: they pass an anti join.
    """
    def told(rows):
        return rows.select(*[F.col(k).alias(f"_decided_{k}") for k in keys])

    def same(other):
        return reduce(lambda a, b: a & b, [c.eqNullSafe(other[f"_decided_{k}"]) for k, c in keys.items()])

    off = told(decided.filter(~F.col("stays") | (F.col("n") > 1)))
    alone = df.join(off, same(off), "left_anti")
    again = told(decided.filter(F.col("stays") & (F.col("n") > 1)))
    if again.isEmpty():
        return alone
    # folds map-side, so that a row repeated in a third of the table is no single group of rows
    folded = (df.join(again, same(again), "left_semi")
              .select(*[c.alias(f"_decided_{k}") for k, c in keys.items()], best.alias("_best"), F.struct(*df.columns).alias("_row"))
              .groupBy(*[f"_decided_{k}" for k in keys]).agg(F.max_by("_row", "_best").alias("_row")))
    return alone.unionByName(folded.select(*[F.col("_row")[c].alias(c) for c in df.columns]))


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def folds_of(doc_id: str, parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``; a null identifier counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def utf8(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes; null as empty. No text is decoded for it."""
    import pyarrow as pa
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def small(batches, rows=1000):
    """Arrow batches cut to at most ``rows``: a worker keeps what its largest batch took, in lists of Python and in Arrow."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
