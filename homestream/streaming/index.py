"""A document index that streams write to: last write wins per document, and a read costs base plus deltas.

Documents are dealt to hash buckets of their id. A micro-batch adds a delta, one folded row per document, in parts by
bucket. Deltas are numbered in the order in which they were first written. The base of a bucket is one row per document
up to some delta; compaction rewrites the buckets that have gathered much, each on its own, and a bucket's newest base
decides from which delta on a reader looks further. So neither a read nor a compaction goes over the whole history.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.operators.keyed import latest_documents
from homestream.streaming.sinks import Commits, _children, _fs

BUCKET, DELTA = "_bucket", "_delta"


class DocumentIndex:
    """Folders: ``delta/<number>-<run>-<batch>/_bucket=<b>`` and ``base/_bucket=<b>/<number of its last delta>``.

    A replay of a micro-batch writes its delta again under the same number; a bucket whose base holds the delta already
    looks past it, so replays change nothing, before a compaction and after. With ``commits`` the deltas of micro-batches
    that are not recorded are neither read nor compacted.
    """

    def __init__(self, spark, path, schema: T.StructType, doc_id="doc_id", buckets=16, commits: Commits = None):
        self.spark, self.path, self.schema, self.doc_id, self.buckets = spark, path.rstrip("/"), schema, doc_id, buckets
        self.commits = commits
        # fields that are files' own; the bucket and the delta are in the folder names
        self._stored = T.StructType([*schema.fields, T.StructField(DELTA, T.LongType())])

    def _deltas(self):
        """Number -> folder of every complete delta that counts."""
        last = None if self.commits is None else self.commits.last()
        out = {}
        for name in _children(self.spark, f"{self.path}/delta"):
            run, _, batch = name[13:].rpartition("-")
            if last is None or int(batch) <= last.get(run, -1):
                if "_SUCCESS" in _children(self.spark, f"{self.path}/delta/{name}"):
                    out[int(name[:12])] = name
        return out

    def _bases(self):
        """Bucket -> the delta that its newest complete base reaches to."""
        out = {}
        for folder in _children(self.spark, f"{self.path}/base"):
            done = [int(n) for n in _children(self.spark, f"{self.path}/base/{folder}")
                    if "_SUCCESS" in _children(self.spark, f"{self.path}/base/{folder}/{n}")]
            if done:
                out[int(folder.rpartition("=")[2])] = max(done)
        return out

    def write(self, docs: DataFrame, batch_id, run="stream", order=("window_start",)):
        """Add a micro-batch's documents, the last by ``order`` of each id."""
        mark = f"-{run}-{batch_id}"
        known = _children(self.spark, f"{self.path}/delta")
        name = next((n for n in known if n[12:] == mark), None) or f"{max((int(n[:12]) for n in known), default=0) + 1:012d}{mark}"
        bucket = F.pmod(F.xxhash64(self.doc_id), F.lit(self.buckets)).cast("int")
        (latest_documents(docs, self.doc_id, order).select(*self.schema.fieldNames(), bucket.alias(BUCKET), F.lit(int(name[:12])).cast("long").alias(DELTA))
         .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/delta/{name}"))

    def _parts(self, deltas, bases, buckets=None):
        """Folders of bases and of deltas that these don't hold, of all buckets or of some."""
        pick = range(self.buckets) if buckets is None else buckets
        out = [f"{self.path}/base/{BUCKET}={b}/{bases[b]}" for b in pick if b in bases]
        for n, name in deltas.items():
            have = {*_children(self.spark, f"{self.path}/delta/{name}")}
            out += [f"{self.path}/delta/{name}/{BUCKET}={b}" for b in pick if f"{BUCKET}={b}" in have and n > bases.get(b, -1)]
        return out

    def _folded(self, parts) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self._stored)
        rows = self.spark.read.schema(self._stored).parquet(*parts)
        body = [c for c in self._stored.fieldNames() if c != self.doc_id]
        # the number alone orders the fold: fixed width, so it stays a hash aggregate up to the bodies
        return rows.groupBy(self.doc_id).agg(F.max_by(F.struct(*body), DELTA).alias("_d")).select(
            *[F.col(c) if c == self.doc_id else F.col(f"_d.{c}").alias(c) for c in self._stored.fieldNames()])

    def read(self) -> DataFrame:
        """The newest row of each document."""
        return self._folded(self._parts(self._deltas(), self._bases())).select(*self.schema.fieldNames())

    def pending(self) -> dict:
        """Bucket -> number of deltas that its base doesn't hold."""
        deltas, bases = self._deltas(), self._bases()
        out = dict.fromkeys(range(self.buckets), 0)
        for n, name in deltas.items():
            for folder in _children(self.spark, f"{self.path}/delta/{name}"):
                b = int(folder.rpartition("=")[2]) if folder.startswith(BUCKET) else None
                out.update({b: out[b] + 1} if b is not None and n > bases.get(b, -1) else {})
        return out

    def compact(self, least=8):
        """New bases for the buckets with at least ``least`` deltas of their own, and removal of what nobody reads any
        more: bases before the last two of a bucket, and deltas that the older of these holds in every bucket.

        A delta of a micro-batch that isn't recorded yet ends the range: its number must not be passed.
        """
        deltas, bases = self._deltas(), self._bases()
        open_ = [int(n[:12]) for n in _children(self.spark, f"{self.path}/delta") if int(n[:12]) not in deltas]
        deltas = {n: name for n, name in deltas.items() if n < min(open_, default=n + 1)}
        if not deltas:
            return []
        due = [b for b, n in self.pending().items() if n >= least]
        for b in due:
            self._folded(self._parts(deltas, bases, [b])).write.mode("overwrite").parquet(f"{self.path}/base/{BUCKET}={b}/{max(deltas)}")
        self._sweep(deltas)
        return due

    def _sweep(self, deltas):
        held = []
        for b in range(self.buckets):
            done = sorted(int(n) for n in _children(self.spark, f"{self.path}/base/{BUCKET}={b}"))
            for old in done[:-2]:
                p, fs = _fs(self.spark, f"{self.path}/base/{BUCKET}={b}/{old}")
                fs.delete(p, True)
            held.append(done[-2] if len(done) > 1 else -1)
        for n, name in deltas.items():
            # the newest ones stay, so that a replay finds its number
            if n <= min(held) and n < max(deltas):
                p, fs = _fs(self.spark, f"{self.path}/delta/{name}")
                fs.delete(p, True)
