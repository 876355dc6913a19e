"""Target-distribution importance resampling: documents that look like a target corpus are drawn more often.

Features are all runs of 1 to 2 words, hashed into ``BUCKETS`` buckets by CRC-32. Two arrays of bucket counts,
one of the corpus and one of the target, give an array of gains; a document's weight is the floored mean of
the gains of its features. Random keys of the extreme-value kind turn the draw without replacement into a
selection of the highest scores (weight plus noise that depends on the identifier alone).

The selection never sorts what it can discard. Candidates lie in a written table, sorted within its parts. A
round asks every part for the middle of its keys that are still open and for their number; the median of these
medians, weighted by the numbers, has at least a quarter of all open keys on either side. Counting the keys up
to it settles on which side the cutoff lies and discards the other one for good. What a round gathers is a row
for each part of the table, whatever the number of documents; the last ``FEW`` open keys are gathered and sorted.
Only winners are sorted as a whole, by a range shuffle, and numbered from their parts' sizes.

Null and empty texts have no features, weight 0, and are never drawn. A null identifier is the empty text for
the noise and comes last among ties; rows that repeat an identifier are drawn for themselves, and ties of all
columns are rows alike, of which as many are drawn as fit. Without a target every gain compares with nothing
seen. An empty table gives an empty result. Other columns pass through with ``keep``, but those named like an
output are replaced.
"""

from pyspark.sql import DataFrame, Window, functions as F, types as T

from homestream.llm.common import utf8, written

BUCKETS, SEED, MIN_WORDS, SHARE = 10_000, 7, 20, 25
#: Open keys that are few enough to be gathered and sorted.
FEW = 10_000
#: Fixed value: A-Z lower-cased; every ASCII character but letters and digits separates words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
OUT = {"n_words": T.LongType(), "n_features": T.LongType(), "weight": T.LongType(), "score": T.LongType()}
#: Ascending keys: the best come first.
KEY = ("_k0", "_k1", "_k2")


def buckets(text: bytes):
    """(number of words, bucket of every feature) of UTF-8 text."""
    import numpy as np
    from zlib import crc32
    words = text.translate(TABLE).split()
    n = len(words)
    ones = list(map(crc32, words))
    # a CRC continues: that of two words from that of the first
    twos = map(crc32, [b" " + w for w in words[1:]], ones)
    out = np.empty(max(0, 2 * n - 1), np.int64)
    out[:n] = ones
    out[n:] = np.fromiter(twos, np.int64, max(0, n - 1))
    return n, out % BUCKETS


def bucket_counts(df: DataFrame, text="text"):
    """Features of each bucket over all texts: BUCKETS numbers, whatever the input's size."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in utf8(b.column(0)):
                total += np.bincount(buckets(t)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    rows = (df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(corpus, target):
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of every bucket."""
    import numpy as np
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id) -> int:
    """The identifier's extreme-value noise in thousandths, floored."""
    from hashlib import sha256
    from math import floor, log
    h = int(sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, target: DataFrame, doc_id="doc_id", text="text", target_text="text", keep=None) -> DataFrame:
    """Adds n_words, n_features, weight and score to every row."""
    gain = gains(bucket_counts(df, text), bucket_counts(target, target_text))
    shared = df.sparkSession.sparkContext.broadcast(gain)       # BUCKETS numbers
    names = [c for c in (keep or df.columns) if c not in OUT and c != "rank"]
    rows = df.select(*names, F.col(doc_id).cast("string").alias("_rs_id"), F.col(text).cast("string").alias("_rs_text"))

    def run(batches):
        import pyarrow as pa
        gain = shared.value
        for b in batches:
            made = []
            for i, t in zip(b.column(len(names)).to_pylist(), utf8(b.column(len(names) + 1))):
                n, at = buckets(t)
                weight = int(gain[at].sum()) // len(at) if n else 0
                made.append((n, len(at), weight, weight + noise(i)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], *[pa.array(c, pa.int64()) for c in (zip(*made) if made else [[]] * len(OUT))]], [*names, *OUT])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-2], *[T.StructField(n, t) for n, t in OUT.items()]]))


def _keyed(df: DataFrame, doc_id) -> DataFrame:
    """KEY columns: score downwards, identifier upwards (null last), and features, so that equal keys are rows alike."""
    return df.withColumns({
        "_k0": -F.col("score"), "_k1": F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)), "_k2": F.col("n_features")})


def _bound(key, strictly):
    """Condition: a row's key is below ``key`` (or equal to it unless ``strictly``). The first part is pushed to the scan."""
    a, b, c = (F.col(k) for k in KEY)
    last = (c < key[2]) if strictly else (c <= key[2])
    return (a <= key[0]) & ((a < key[0]) | (b < key[1]) | ((b == key[1]) & last))


def _above(key):
    a, b, c = (F.col(k) for k in KEY)
    return (a >= key[0]) & ((a > key[0]) | (b > key[1]) | ((b == key[1]) & (c > key[2])))


def _middles(table: DataFrame, low, high):
    """(key, number) of every part of the table: its middle open key and how many are open.

    A part is what one task reads, so its keys, three numbers each, are bounded by the session's split size.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        k = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort(k[::-1])
        mid = order[(len(order) - 1) // 2]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int64()) for v in (*[int(c[mid]) for c in k], len(order))], [*KEY, "n"])

    open_ = table if low is None else table.filter(_above(low))
    open_ = open_ if high is None else open_.filter(_bound(high, True))
    return [((r[0], r[1], r[2]), r[3]) for r in open_.select(*KEY).mapInArrow(run, "_k0 bigint, _k1 bigint, _k2 bigint, n bigint").collect()]


def weighted_median(middles):
    """The key at which half of the open keys' parts, weighted by their numbers, are reached."""
    total, run = sum(n for _, n in middles), 0
    for key, n in sorted(middles):
        run += n
        if 2 * run >= total:
            return key


def cutoff(table: DataFrame, wanted: int, few=FEW):
    """The ``wanted``-th smallest key of the table (1-based), exactly."""
    low = high = None      # open keys lie strictly between
    skipped = 0            # keys up to low
    while True:
        middles = _middles(table, low, high)
        left = sum(n for _, n in middles)
        if left <= few:
            rows = table if low is None else table.filter(_above(low))
            rows = rows if high is None else rows.filter(_bound(high, True))
            keys = sorted(map(tuple, rows.select(*KEY).collect()))
            return keys[wanted - skipped - 1]
        pivot = weighted_median(middles)
        open_ = table if low is None else table.filter(_above(low))
        below, same = open_.filter(_bound(pivot, False)).agg(
            F.count(F.when(_bound(pivot, True), 1)), F.count(F.when(~_bound(pivot, True), 1))).first()
        if wanted <= skipped + below:
            high = pivot
        elif wanted <= skipped + below + same:
            return pivot
        else:
            low, skipped = pivot, skipped + below + same


def drawn(rows: DataFrame, doc_id="doc_id", min_words=MIN_WORDS, share=SHARE, few=FEW) -> DataFrame:
    """Adds ``rank`` to scored rows: 1, 2, ... for the floor(share * N / 100) best of the N rows with enough words."""
    names = [c for c in rows.columns if c not in ("rank", *KEY)]
    table = written(_keyed(rows.select(*names), doc_id).sortWithinPartitions(*KEY), "resample-scores")
    fit = table.filter(F.col("n_words") >= min_words)
    wanted = fit.count() * share // 100
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return table.select(*names, none)
    last = cutoff(fit, wanted, few)
    won = (F.col("n_words") >= min_words) & _bound(last, False)
    # written, so that a row keeps its place
    best = written(table.filter(won).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
                   .withColumn("_at", F.monotonically_increasing_id()), "resample-winners")
    part = F.shiftright("_at", 33)
    sizes = best.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each part of the winners, so bounded by the number of partitions
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    place = F.col("_first") + F.col("_at") - F.shiftleft(part, 33) + 1
    ranked = best.join(F.broadcast(first), part == F.col("_part")).withColumn("_place", place)
    # of rows alike at the cutoff only as many as fit
    return ranked.select(*names, F.when(F.col("_place") <= wanted, F.col("_place")).alias("rank")).unionByName(
        table.filter(~F.coalesce(won, F.lit(False))).select(*names, none))


def resample(df: DataFrame, target: DataFrame, doc_id="doc_id", text="text", target_text="text", keep=None,
             min_words=MIN_WORDS, share=SHARE) -> DataFrame:
    """Every row with n_words, n_features, weight, score and rank (null: not drawn)."""
    return drawn(scored(df, target, doc_id, text, target_text, keep or df.columns), doc_id, min_words, share)
