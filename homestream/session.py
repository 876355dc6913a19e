"""Session defaults. On a cluster the submitted configuration wins; nothing here overrides it."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus=None, app="homestream", shuffle_partitions=None, memory="8g", shared=None):
    """A session for tests and the benchmark. ``shared``: its checkpoint folder, by default what the
    environment sets, see :func:`shared_dir`."""
    cpus = int(cpus or os.cpu_count() or 4)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark):
    """The shared folder: the session's setting, else what the context was given; None without either."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    return root


def shared_dir(spark, *parts):
    """A path below the shared checkpoint folder, which the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where every task runs on this machine, may lack it. It then gets a temporary
    folder, through the context: the setting itself can't be changed at run time.
    """
    root = checkpoint_root(spark)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="homestream-"))
        root = checkpoint_root(spark)
    return "/".join([root.rstrip("/"), *parts])


def cut_lineage(df):
    """Write a frame that several jobs read to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, "cut", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
