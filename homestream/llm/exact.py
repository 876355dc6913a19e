"""Exact duplicates by a content sort.

Texts are equal when identical after deleting white space ([\\x20\\x09-\\x0D]). The normalised bytes are
range-partitioned by splitters that Spark samples, sorted externally within each partition (Spark's sort
spills), and neighbours are compared in full. One task never needs a whole group: the range key is (first
bytes, digest, identifier), so splitters also cut through a hot group, and its pieces are joined again
from the first and last run of each partition. Only these pieces are compared across partitions: at most
two per partition, so the table of them has a size bound and is broadcast.

Of equal texts the row with the most code points in the original text stays, then the smallest identifier
(a null identifier counts as the largest). Null counts as the empty text. Repeated identifiers are rows of
their own: each gets the group's ``keep_id``, and ``kept`` is true where it equals the row's own. Other
columns, whatever their names, aren't read. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame, functions as F

from homestream.llm.common import kept_rows, small, text_of, utf8, written

#: Fixed value: the deleted characters.
WHITE = bytes(range(9, 14)) + b" "
#: Bytes of the normalised text in the range key; the sort itself compares all of them.
PREFIX = 16
ROWS = "doc_id bigint, chars bigint, norm binary, head binary, sha binary"
RUNS = ("doc_id bigint, sha binary, run bigint, keep_id bigint, keep_chars bigint, size bigint, edge int, "
        "norm binary")
BIG = (1 << 63) - 1


def _normalise(batches):
    """Arrow batches of (doc_id, text) to rows with normalised bytes, prefix and digest."""
    from hashlib import sha256

    import pyarrow as pa
    import pyarrow.compute as pc
    for b in small(batches):
        norm = [t.translate(None, WHITE) for t in utf8(b.column(1))]
        chars = pc.fill_null(pc.utf8_length(b.column(1)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), chars, pa.array(norm, pa.binary()), pa.array([n[:PREFIX] for n in norm], pa.binary()),
             pa.array([sha256(n).digest() for n in norm], pa.binary())],
            ["doc_id", "chars", "norm", "head", "sha"])


def _runs(batches):
    """Sorted rows to runs of equal neighbours. A run keeps its identifiers only; the text of just the
    current run is held. ``edge``: 1 for the partition's first run, 2 for its last, 3 for both."""
    import pyarrow as pa
    from pyspark import TaskContext
    pid = TaskContext.get().partitionId()
    names = [f.split()[0] for f in RUNS.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    out, state = [[] for _ in names], {"no": 0}

    def close(run, edge):
        ids, norm, sha, best = run
        keep = -best[1] if best[1] > -BIG else None
        n = len(ids)
        cols = (ids, [sha] * n, [(pid << 33) + state["no"]] * n, [keep] * n, [best[0]] * n, [n] * n, [edge] * n,
                # the text goes along once per edge run, to be compared across partitions
                [norm] + [None] * (n - 1) if edge else [None] * n)
        for o, c in zip(out, cols):
            o.extend(c)
        state["no"] += 1

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names)
        for o in out:
            o.clear()
        return batch

    run, first = None, True
    for b in small(batches):
        for i, chars, norm, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                       b.column(2).to_pylist(), b.column(4).to_pylist()):
            mine = (chars, -(BIG if i is None else i))
            if run is not None and norm == run[1]:
                run[0].append(i)
                run[3] = max(run[3], mine)
            else:
                if run is not None:
                    close(run, int(first))
                    first = False
                run = [[i], norm, sha, mine]
        if len(out[0]) >= 10_000:
            yield flush()
    if run is not None:
        close(run, 2 + first)
        yield flush()


def exact_duplicates(df: DataFrame, doc_id="doc_id", text="text", partitions=None) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    runs = written(
        rows.mapInArrow(_normalise, ROWS).repartitionByRange(n, "head", "sha", "doc_id")
        .sortWithinPartitions("head", "sha", "norm").mapInArrow(_runs, RUNS), "exact-runs")

    # pieces of one group that splitters cut apart: compared in full, by their texts
    pieces = runs.filter(F.col("norm").isNotNull()).select("run", "norm", "keep_id", "keep_chars", "size")
    best = F.struct(F.col("keep_chars").alias("c"), F.col("keep_id").isNotNull().alias("k"), (-F.col("keep_id")).alias("i"))
    whole = pieces.groupBy("norm").agg(
        F.collect_list("run").alias("runs"), F.max(best).alias("b"), F.sum("size").alias("_size"))
    mended = whole.filter(F.size("runs") > 1).select(
        F.explode("runs").alias("run"), (-F.col("b.i")).alias("_keep"), "_size", F.lit(True).alias("_cut"))
    keep = F.when(F.col("_cut"), F.col("_keep")).otherwise(F.col("keep_id"))
    return runs.drop("norm").join(F.broadcast(mended), "run", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("_size", "size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(df: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """The rows of ``df`` that stay, one of each group of equal texts, all columns.

    Decided by identifier and text, so neither a repeated identifier nor a row repeated whole keeps a copy or loses a
    text. Of rows that share the kept identifier the one with the most code points stays, then the greatest text.
    """
    found = exact_duplicates(df, doc_id, text)
    decided = written(found.groupBy("doc_id", "text_sha256").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("kept").alias("stays")), "exact-decisions")
    whole = text_of(text)
    # the same normalised bytes as above, by built-in functions
    sha = F.sha2(F.translate(whole, WHITE.decode(), "").cast("binary"), 256)
    return kept_rows(df, decided, {"doc_id": F.col(doc_id).cast("long"), "text_sha256": sha},
                     F.struct(F.char_length(whole), whole))
