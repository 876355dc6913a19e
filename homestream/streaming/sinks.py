"""Writers: versioned keyed tables, append-only logs, and guarded external connectors.

A micro-batch is known by its query's run and its batch id. The run is the identity that a checkpoint
keeps across restarts, so a replay after a failure comes under the same pair and replaces exactly what it
wrote before, while a query with a new checkpoint adds to what is there, whoever wrote it.
"""

import uuid
from bisect import bisect_left
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.operators.keyed import absent_rows, coalesce_upsert, latest_documents


def _fs(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark, path):
    """Names below a directory of any Hadoop file system; empty when it is not there."""
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def run_of(batch: DataFrame):
    """The identity of the streaming query that a micro-batch belongs to; a fresh one outside a stream."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or uuid.uuid4().hex


class Commits:
    """Which micro-batches count, for several tables at once.

    A micro-batch writes its part of every table under its run and batch id and is recorded here at the end, by one new
    name in the run's folder. The tables' readers and merges see what is recorded and nothing else, so a query that
    fails between two tables shows neither. Batches of a run follow each other: the newest one stands for all before.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> dict:
        """Run -> its last recorded batch id."""
        done = {run: _children(self.spark, f"{self.path}/{run}") for run in _children(self.spark, self.path)}
        return {run: max(map(int, names)) for run, names in done.items() if names}

    def record(self, run, batch_id):
        p, fs = _fs(self.spark, f"{self.path}/{run}/{batch_id:012d}")
        fs.mkdirs(p)
        for name in _children(self.spark, f"{self.path}/{run}"):
            if int(name) < batch_id:
                old, _ = _fs(self.spark, f"{self.path}/{run}/{name}")
                fs.delete(old, True)


class KeyedTable:
    """One row per key, kept as complete versions; a version counts once its _SUCCESS marker exists and, where there are
    ``commits``, its micro-batch is recorded.

    Meant for tables whose size follows the number of devices or people, not the number of events.
    Versions grow by one; a version that a micro-batch wrote carries its run and batch id in its name. The
    last ``keep`` versions stay, for readers that opened one and for replays, which need two.
    """

    def __init__(self, spark, path, schema, keep=10, commits: Commits = None):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, max(keep, 1)
        self.commits = commits

    def _done(self):
        """Number -> folder name of every complete version."""
        names = [n for n in _children(self.spark, self.path) if n.startswith("v=")]
        return {int(n[2:14]): n for n in names if "_SUCCESS" in _children(self.spark, f"{self.path}/{n}")}

    def _seen(self):
        """Complete versions whose micro-batch is recorded, or that no micro-batch wrote."""
        done = self._done()
        if self.commits is None:
            return done
        last = self.commits.last()

        def counts(name):
            run, _, batch = name[15:].rpartition("-")
            return not run or int(batch) <= last.get(run, -1)
        return {v: n for v, n in done.items() if counts(n)}

    def versions(self):
        return sorted(self._seen())

    def _read(self, name):
        if name is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        seen = self._seen()
        return self._read(seen[max(seen)] if seen else None)

    def turn(self, run, batch_id):
        """(name of the version that a micro-batch writes, the rows it starts from). A replay repeats its own version and
        starts from the one before."""
        done, seen, mark = self._done(), self._seen(), f"-{run}-{batch_id}"
        newest = max(done, default=-1)
        if newest >= 0 and done[newest][14:] == mark:
            name, before = done[newest], [v for v in seen if v < newest]
        else:
            name, before = f"v={newest + 1:012d}{mark}", seen
        return name, self._read(seen[max(before)] if before else None)

    def write(self, df: DataFrame, name=None):
        """A new version with these rows; ``name`` repeats a version that a replay writes again."""
        done = self._done()
        name = name or f"v={max(done, default=-1) + 1:012d}"
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/{name}")
        old = sorted(v for v in done if v < int(name[2:14]))
        for v in old[:max(0, len(old) - self.keep + 1)]:
            p, fs = _fs(self.spark, f"{self.path}/{done[v]}")
            fs.delete(p, True)

    def upsert(self, rows: DataFrame, key, values, batch_id, order=("event_ts", "seq"), run="stream"):
        """Merge a micro-batch into the newest version."""
        name, base = self.turn(run, batch_id)
        self.write(coalesce_upsert(base, rows, key, values, order), name)


#: Folders of days that one micro-batch writes at most: one that brings more days files several of them together.
SPANS = 16


def spans_of(days) -> list:
    """(first day, last day) of the folders for a micro-batch's days: each day its own, or runs of days alike in number."""
    days, n = sorted(days), max(1, -(-len(days) // SPANS))
    return [(days[i], days[min(i + n, len(days)) - 1]) for i in range(0, len(days), n)]


class AppendLog:
    """Rows that are only ever added, partitioned by day, source, run and micro-batch; with ``commits`` only recorded
    micro-batches are read.

    Insert-if-absent lists and reads only the days its own rows fall on, so its cost follows the batch
    and those days and not the whole history. A micro-batch of more than ``SPANS`` days files them in folders
    ``day=<first>~<last>``, so their number follows the micro-batches and not the length of time. Runs are numbered in
    the order in which they first wrote.
    """

    PARTITIONS = ("day", "source", "run")

    def __init__(self, spark, path, schema, time_col, commits: Commits = None):
        self.spark, self.path, self.schema, self.time_col = spark, path.rstrip("/"), schema, time_col
        self.commits = commits
        self._stored = T.StructType(schema.fields + [T.StructField(c, T.StringType()) for c in self.PARTITIONS] + [
            T.StructField("batch_id", T.LongType())])

    def _day(self):
        return F.substring(F.col(self.time_col), 1, 10)

    def _run(self, run):
        """The run's name with its number in front; a run that writes for the first time gets the next one."""
        known = _children(self.spark, f"{self.path}/_runs")
        name = next((n for n in known if n[7:] == run), None)
        if name is None:
            name = f"{max((int(n[:6]) for n in known), default=0) + 1:06d}-{run}"
            p, fs = _fs(self.spark, f"{self.path}/_runs/{name}")
            fs.mkdirs(p)
        return name

    def stored(self, days=None) -> DataFrame:
        """Stored rows with their partition columns, of all days or of those listed."""
        names = [n for n in _children(self.spark, self.path) if n.startswith("day=")]
        if days is not None:
            days = sorted(days)

            def holds(name):
                first, _, last = unquote(name[4:]).partition("~")
                i = bisect_left(days, first)
                return i < len(days) and days[i] <= (last or first)
            names = [n for n in names if holds(n)]
        if not names:
            return self.spark.createDataFrame([], self._stored)
        rows = (self.spark.read.schema(self._stored).option("basePath", self.path)
                .parquet(*[f"{self.path}/{n}" for n in names]))
        if self.commits is None:
            return rows
        last, counts = self.commits.last(), F.lit(False)
        for name in _children(self.spark, f"{self.path}/_runs"):
            if name[7:] in last:
                counts = counts | ((F.col("run") == name) & (F.col("batch_id") <= last[name[7:]]))
        return rows.filter(counts)

    def read(self) -> DataFrame:
        return self.stored().select(*self.schema.fieldNames())

    def latest(self, key) -> DataFrame:
        """Last write wins: the row of the latest micro-batch of the latest run per key."""
        return latest_documents(self.stored().drop("source", "day"), key, ("run", "batch_id"))

    def append(self, rows: DataFrame, batch_id, source="stream", run="stream", spans=()):
        """A replay brings the same rows, so it overwrites exactly the partitions of its first run. ``spans``: see
        :func:`spans_of`; days in none of them are folders of their own.

        Rebalancing by day keeps the file count low and still splits a day that is too large for one task.
        """
        day = self._day()
        for first, last in spans:
            if first < last:
                day = F.when(self._day().between(first, last), f"{first}~{last}").otherwise(day)
        (rows.select(*self.schema.fieldNames(), day.alias("day"), F.lit(source).alias("source"),
                     F.lit(self._run(run)).alias("run"), F.lit(batch_id).cast("long").alias("batch_id"))
         .hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*self.PARTITIONS, "batch_id").parquet(self.path))

    def insert_if_absent(self, rows: DataFrame, keys, batch_id, source="stream", order=None, run="stream"):
        """Only what this very micro-batch wrote before is left out of the comparison."""
        # as many days as the micro-batch touches, each once
        days = {r.day for r in rows.select(self._day().alias("day")).dropna().distinct().toLocalIterator()}
        own = (F.col("source") == source) & (F.col("run") == self._run(run)) & (F.col("batch_id") == batch_id)
        # what is stored grows with the micro-batches: it meets them in a shuffle, not by way of the driver
        target = self.stored(days).filter(~own).select(*self.schema.fieldNames()).hint("merge")
        self.append(absent_rows(target, rows, keys, order), batch_id, source, run, spans_of(days))


class RoutedLog:
    """Records by topic, a folder tree in place of a broker: ``topic=/run=/batch_id=``. A replay overwrites the parts of
    its micro-batch and nothing else; with ``commits`` only recorded micro-batches are read."""

    def __init__(self, spark, path, commits: Commits = None):
        self.spark, self.path, self.commits = spark, path.rstrip("/"), commits
        self.schema = "value string, topic string, run string, batch_id bigint"

    def write(self, records: DataFrame, batch_id, run="stream"):
        """``records``: topic and value. Records of no topic have no reader and are left out."""
        (records.filter("topic IS NOT NULL").select("value", "topic", F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch_id"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic", "run", "batch_id").parquet(self.path))

    def read(self, topic=None) -> DataFrame:
        if not any(n.startswith("topic=") for n in _children(self.spark, self.path)):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        if self.commits is not None:
            counts = F.lit(False)
            for run, batch in self.commits.last().items():
                counts = counts | ((F.col("run") == run) & (F.col("batch_id") <= batch))
            rows = rows.filter(counts)
        return rows if topic is None else rows.filter(F.col("topic") == topic)


@dataclass(frozen=True)
class SinkOptions:
    """Batching of external sinks. ``interval`` is the trigger of a stream that feeds one, see
    :func:`homestream.streaming.pipeline.start_external`. Retries are Spark task retries (spark.task.maxFailures)."""

    batch_size: int = 1000
    interval: str = "5 seconds"
    max_retries: int = 5
    parallelism: int = 4

    def jdbc(self):
        return {"batchsize": str(self.batch_size), "numPartitions": str(self.parallelism)}

    def index(self):
        return {"es.batch.size.entries": str(self.batch_size), "es.batch.write.retry.count": str(self.max_retries)}


# The row-at-a-time database sink and the bulk index sink.
ROW_SINK = SinkOptions(batch_size=1, interval="0 seconds", max_retries=5, parallelism=1)
INDEX_SINK = SinkOptions(batch_size=50, interval="5 seconds", max_retries=5, parallelism=4)


def write_jdbc(df: DataFrame, url, table, mode, options=SinkOptions(), **properties):
    """Database copy of a result: ``overwrite`` a merged keyed table (truncate, not drop) or ``append``
    the absent rows of a log. Needs the driver on the class path. Spark itself writes with at most
    ``parallelism`` connections; the tasks that compute the rows stay as they are."""
    (df.write.format("jdbc").mode(mode)
     .option("url", url).option("dbtable", table).option("truncate", "true")
     .options(**options.jdbc()).options(**properties).save())


def write_index(df: DataFrame, index, options=INDEX_SINK, **properties):
    """External document index, one document per doc_id. Needs the connector on the class path."""
    (df.write.format("org.elasticsearch.spark.sql").mode("append")
     .option("es.mapping.id", "doc_id").option("es.mapping.exclude", "doc_id")
     .options(**options.index()).options(**properties).save(index))


def write_console(df: DataFrame, prefix, trigger="5 seconds"):
    """Print a stream, each row under its prefix."""
    return (
        df.select(F.lit(prefix).alias("stream"), "*").writeStream.format("console")
        .option("truncate", "false").trigger(processingTime=trigger).start()
    )


def write_routed(df: DataFrame, topic_col="topic", value_col="value", path=None, **kafka):
    """Each record to the topic of its kind: a partitioned file tree, or the broker's own routing."""
    if path:
        df.write.mode("append").partitionBy(topic_col).parquet(path)
        return
    (df.select(F.col(topic_col).alias("topic"), F.col(value_col).alias("value"))
     .write.format("kafka").options(**kafka).save())
