"""Token-id files: documents encoded by the tokenizers library, stored as rANS segments, read back.

Documents are range-partitioned by identifier and sorted within each part. Every part writes segments: the
ids of consecutive whole documents (``SEGMENT`` ids or one longer document), coded by :mod:`rans`, beside
the documents' identifiers and lengths. A file is a Parquet file of segments, so it lives in any store that
Spark writes to, and a lost task leaves nothing half-written. A segment decodes alone; its position among
all ids follows from the sum of the parts before it, a table with one row per part.

Null and empty texts have only the end id. A null identifier comes first; repeated identifiers are
documents of their own, in the order of a hash of their texts' beginnings, then of the texts. Other columns aren't read. An empty table
makes a file without segments.
"""

import os
from functools import lru_cache

from pyspark.sql import DataFrame, Window, functions as F

from homestream.llm.bytebpe import LONGEST, plain, words_of
from homestream.llm.common import shared_folder

SEGMENT = 2_000_000
#: Remembered words above which a task starts anew. Those above LONGEST letters are not remembered.
WORDS = 600_000
END = 2
SEGMENTS = "part int, segment int, first bigint, n bigint, doc_ids array<bigint>, lengths array<bigint>, data binary"


class Encoder:
    """The library's ids of texts as packed little-endian 32-bit integers. It sees each word once.

    New words go to the library as one text. Each starts with its only white space, a space or a line
    feed, and so with the only token of its own that does: there the ids are cut.
    """

    def __init__(self, path):
        import numpy as np
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # a task has one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.known = {}
        self.sign = {c: self._ids(c).tobytes() for c in ",."}
        size = self.library.get_vocab_size()
        self.opens = np.array([(self.library.id_to_token(i) or "")[:1] in ("\u0120", "\u010a") for i in range(size)])

    def _ids(self, text):
        import numpy as np
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words):
        import numpy as np
        known = self.known
        # letters and one sign after them are separate pre-tokens
        signed = [w for w in words if w[-1:] in (",", ".") and w[:-1].isalpha()]
        fresh = list({*words}.difference(signed).union(w[:-1] for w in signed).difference(known))
        if fresh:
            ids = self._ids("".join(map(plain, fresh)))
            cut = np.flatnonzero(self.opens[ids]) * 4
            data = ids.tobytes()
            if len(cut) != len(fresh):
                known.update((w, self._ids(plain(w)).tobytes()) for w in fresh)
            else:
                known.update(zip(fresh, [data[s:e] for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(data)])]))
        known.update((w, known[w[:-1]] + self.sign[w[-1]]) for w in signed)

    def encode(self, texts) -> list:
        import numpy as np
        known = self.known
        if len(known) > WORDS:
            known.clear()
        cut = [words_of(t) for t in texts]
        both = [ws for ws in cut if ws is not None]
        # a space at the end of a text follows nothing that could be cut off
        known.setdefault("", self._ids(" ").tobytes())
        new = set().union(*both).difference(known)
        long = {w: self._ids(plain(w)).tobytes() for w in new if len(w) > LONGEST}
        if len(new) > len(long):
            self._learn(new.difference(long))
        get = (lambda w: long[w] if w in long else known[w]) if long else known.__getitem__
        # a first word follows no space
        first = iter(self.library.encode_batch_fast([ws[0] for ws in both], add_special_tokens=False))
        return [self._ids(t).tobytes() if ws is None
                else b"".join([np.array(next(first).ids, "<u4").tobytes(), *map(get, ws[1:])]) for ws, t in zip(cut, texts)]


@lru_cache(maxsize=2)
def encoder(path):
    """One per Python worker: tasks that follow each other keep the words seen."""
    return Encoder(path)


def write_ids(df: DataFrame, target: str, tokenizer: str, doc_id="doc_id", text="text", end_id=END, partitions=None) -> None:
    """Encode every text, append ``end_id``, and write segments in ascending order of ``doc_id``."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from homestream.llm import rans
        pid, tail = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        at, count, total, ids, lengths, packed = 0, 0, 0, [], [], []
        names = [f.split()[0] for f in SEGMENTS.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def segment():
            data = rans.pack(rans.encode(np.frombuffer(b"".join(packed), "<u4")))
            row = [pid, count, at, total, ids, lengths, data]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        encode = encoder(tokenizer).encode
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                for i, data in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids.append(i)
                    lengths.append(len(data) // 4 + 1)
                    packed += data, tail
                    total += lengths[-1]
                    if total >= SEGMENT:
                        yield segment()
                        at, count, total, ids, lengths, packed = at + total, count + 1, 0, [], [], []
        if ids:
            yield segment()

    # ties of an identifier by a hash of their texts' beginnings, then the texts: a hot identifier is cut, and runs agree
    (df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
     .withColumn("h", F.xxhash64(F.substring("text", 1, 64))).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
     .select("doc_id", "text").mapInArrow(run, SEGMENTS).write.parquet(target))


def read_ids(spark, source: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; ids are packed 32-bit little-endian integers."""
    files = spark.read.schema(SEGMENTS).parquet(source)
    # one row per part, so bounded by the number of partitions that wrote
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from homestream.llm import rans
        for b in batches:
            for row in b.to_pylist():
                ids = rans.decode(rans.unpack(row["data"])).tobytes()
                stops = np.cumsum(row["lengths"])
                starts = stops - row["lengths"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"] + row["base"], pa.int64()),
                     pa.array([ids[4 * s:4 * e] for s, e in zip(starts.tolist(), stops.tolist())], pa.binary())],
                    ["doc_id", "start", "ids"])

    return (files.join(F.broadcast(base), "part").select("base", "first", "doc_ids", "lengths", "data")
            .mapInArrow(run, "doc_id bigint, start bigint, ids binary"))


def token_files(df: DataFrame, tokenizer: str, doc_id="doc_id", text="text", target=None) -> DataFrame:
    """Write the files and read them back: (doc_id, start, ids)."""
    spark = df.sparkSession
    target = target or shared_folder(spark, "token-ids")
    write_ids(df, target, tokenizer, doc_id, text)
    return read_ids(spark, target)
