"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words (runs of letters, of digits, of other signs, case kept) fall into ``BUCKETS`` buckets by CRC-32. A
bucket's index vector is sparse and ternary, drawn once from a fixed seed. Its word vector is the sum of
the index vectors of all words within ``NEAR`` places of its occurrences in all documents: integers, so the
sum over tasks is exact and the same in any order. Pooling a document gives mean and spread of the vectors
of its words, the share of its commonest buckets and its length. The network (one hidden layer, numpy) is
fitted on a bounded sample of labelled rows; a temperature fitted on a part of that sample which the
network didn't see turns its output into probabilities.

The word vectors use the texts of all documents and no label. The sample holds at most ``SAMPLE`` labelled
rows, those with the smallest hash of the identifier. Null and empty texts are scored like any other, from
zero features. Without labels of both kinds the score is the share of label 1 (0.5 without any label).
Labels with a null identifier or label don't teach; repeated label rows teach repeatedly. An empty table
gives an empty result. Columns named like an output are replaced; the others pass through on request.
"""

import re

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.llm.bytebpe import Memory
from homestream.llm.common import folds_of, utf8

BUCKETS, DIM, NONZERO, NEAR, SEED = 2048, 48, 6, 2, 20_240_607
SAMPLE, HIDDEN, STEPS = 12_000, 24, 600
WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
#: Words of one slice of a task's texts; co-occurrence counts are 32-bit and emptied between slices.
SLICE = 2_000_000


def index_vectors():
    """The ternary index vector of every bucket: NONZERO places of DIM, half +1 and half -1."""
    import numpy as np
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIM), np.int8)
    places = rng.random((BUCKETS, DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, np.tile([1, -1], NONZERO // 2).astype(np.int8)[None].repeat(BUCKETS, 0), axis=1)
    return out


def _bucket_memory():
    from zlib import crc32
    return Memory(lambda w: crc32(w) % BUCKETS)


def word_vectors(df: DataFrame, text="text"):
    """BUCKETS x DIM word vectors over all texts. What is gathered has this size, whatever the input's."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa
        get, counts, held, n = _bucket_memory().__getitem__, np.zeros(BUCKETS * BUCKETS, np.int64), [], 0
        index = index_vectors().astype(np.int64)
        sums = np.zeros((BUCKETS, DIM), np.int64)

        def add():
            words = np.concatenate(held)
            counts[:] = 0
            for gap in range(1, NEAR + 1):
                a, b = words[:-gap], words[gap:]
                # documents are set apart by BUCKETS
                ok = (a < BUCKETS) & (b < BUCKETS)
                if gap == 2:
                    ok &= words[1:-1] < BUCKETS
                counts[:] += np.bincount(a[ok] * BUCKETS + b[ok], minlength=BUCKETS * BUCKETS)
            square = counts.reshape(BUCKETS, BUCKETS).astype(np.float64)
            # whole numbers below 2**53, so the products are exact
            sums[:] += np.rint((square + square.T) @ index.astype(np.float64)).astype(np.int64)

        for batch in batches:
            for t in utf8(batch.column(0)):
                found = WORD.findall(t)
                held.append(np.fromiter(map(get, found), np.int64, len(found)))
                held.append(np.array([BUCKETS], np.int64))
                n += len(found)
                if n >= SLICE:
                    add()
                    held, n = [], 0
        if held:
            add()
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(sums.reshape(-1)[cell])], ["cell", "value"])

    cells = (df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "cell int, value bigint")
             .groupBy("cell").agg(F.sum("value").alias("value")).toArrow())
    out = np.zeros(BUCKETS * DIM)
    out[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
    out = out.reshape(BUCKETS, DIM)
    seen = np.abs(out).sum(1) > 0
    if seen.any():
        out[seen] /= np.linalg.norm(out[seen], axis=1, keepdims=True)
        out[seen] -= out[seen].mean(0)   # what all words share says nothing
    return out


def pooled(texts, vectors, get):
    """Features of UTF-8 texts: mean and spread of the word vectors, shares of common buckets, length."""
    import numpy as np
    squares = vectors ** 2
    out = np.zeros((len(texts), 2 * DIM + 4))
    for i, t in enumerate(texts):
        found = WORD.findall(t)
        n = len(found)
        if n:
            share = np.bincount(np.fromiter(map(get, found), np.int64, n), minlength=BUCKETS) / n
            mean = share @ vectors
            top = np.sort(share)[::-1]
            out[i] = [*mean, *np.sqrt(np.maximum(share @ squares - mean ** 2, 0)), top[0], top[:5].sum(),
                      (share * share).sum(), np.log1p(n)]
    return out


class Network:
    """Standardised features -> tanh layer -> logit / temperature."""

    def __init__(self, prior):
        self.prior, self.weights = prior, None

    def fit(self, x, y):
        import numpy as np
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(x))
        x, y = x[order], y[order]
        cut = max(1, len(x) // 5)
        calib, xs = x[:cut], x[cut:]
        ys = y[cut:]
        if len({*ys.tolist()}) < 2:
            return self
        self.mean, self.std = xs.mean(0), xs.std(0) + 1e-6
        xs = (xs - self.mean) / self.std
        w = [rng.normal(0, xs.shape[1] ** -0.5, (xs.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        moment, spread = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for step in range(1, STEPS + 1):
            pick = rng.integers(0, len(xs), min(512, len(xs)))
            a, b = xs[pick], ys[pick]
            h = np.tanh(a @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - b) / len(a)
            dh = np.outer(d, w[2]) * (1 - h * h)
            for k, g in enumerate((a.T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], np.array([d.sum()]))):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                spread[k] = 0.99 * spread[k] + 0.01 * g * g
                w[k] -= 0.02 * (moment[k] / (1 - 0.9 ** step)) / (np.sqrt(spread[k] / (1 - 0.99 ** step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        z, yc = self.logits(calib), y[:cut]
        loss = {t: float(np.mean(np.logaddexp(0, z / t) - yc * z / t)) for t in np.geomspace(0.25, 8, 41)}
        self.temperature = float(min(loss, key=loss.get))
        return self

    def logits(self, x):
        import numpy as np
        w = self.weights
        return np.clip(np.tanh((x - self.mean) / self.std @ w[0] + w[1]) @ w[2] + w[3], -60, 60) / self.temperature

    def scores(self, x):
        import numpy as np
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-self.logits(x)))


def labelled_sample(labels: DataFrame, doc_id="doc_id", quality="quality", fold=None, size=SAMPLE) -> DataFrame:
    """(doc_id, label) of at most ``size`` labelled rows, those with the smallest hash."""
    rows = labels.select(F.col(doc_id).cast("long").alias("_id"), (F.col(quality).cast("double") > 0.5).cast("double").alias("_y")).dropna()
    if fold is not None:
        rows = rows.filter(fold(F.col("_id")))
    return rows.orderBy(F.xxhash64("_id"), "_id", "_y").limit(size)


def fit(df: DataFrame, sample: DataFrame, doc_id="doc_id", text="text"):
    """(vectors, network): word vectors over all of ``df``, network over the sample's documents."""
    import numpy as np
    vectors = word_vectors(df, text)
    shared = df.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        import pyarrow as pa
        get = _bucket_memory().__getitem__
        for b in batches:
            x = pooled(utf8(b.column(2)), shared.value, get)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    rows = (df.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
            .join(F.broadcast(sample), F.col("_doc") == F.col("_id"))    # at most SAMPLE narrow rows
            .select("_doc", "_y", "_text").mapInArrow(run, "id bigint, y double, x array<double>")
            .toArrow())
    shared.unpersist()
    if not rows.num_rows:
        return vectors, Network(0.5)
    # one fixed order, so that the fit is the same each time
    rows = rows.sort_by([("id", "ascending"), ("y", "ascending")])
    y = rows.column("y").to_numpy()
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(len(y), -1)
    return vectors, Network(float(y.mean())).fit(x, y)


def score(df: DataFrame, model, text="text", keep=None) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5)."""
    names = [c for c in (keep or df.columns) if c not in ("score", "predicted")]
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*names, F.col(text).cast("string").alias("_quality_text"))

    def run(batches):
        import pyarrow as pa
        (vectors, network), get = shared.value, _bucket_memory().__getitem__
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                s = network.scores(pooled(utf8(b.column(len(names))), vectors, get))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("int32"), pa.int32())], [*names, "score", "predicted"])

    return rows.mapInArrow(run, T.StructType([
        *rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def classify(df: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", keep=None, folds=3, held=1) -> DataFrame:
    """Fit on the labels outside the held-out fold (crc32 of the identifier, modulo) and score every row."""
    sample = labelled_sample(labels, fold=lambda i: F.pmod(F.crc32(i.cast("string").cast("binary")), F.lit(folds)) != held)
    out = score(df, fit(df, sample, doc_id, text), text, keep)
    return out.withColumn("held_out", folds_of(doc_id, folds) == held)
