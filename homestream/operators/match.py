"""Nearest-match join: each probe vector against a gallery, nearest neighbour within a tolerance.

Two exact plans with the same answer:

* A gallery that passes the size check is broadcast as one matrix; probes stream past it in Arrow
  batches with no shuffle at all.
* A larger gallery is cut into bounded blocks of vectors that lie close together: cell of the nearest
  pivot, ring of distance to it. By the triangle inequality a probe can only match in blocks whose
  ring reaches within the tolerance of the probe's own pivot distance, so only these (probe, block)
  meetings are shuffled. Each meeting yields at most one row per probe, its best in that block, and
  the best of all blocks is an aggregate that combines map-side. A block travels once; only one that a sample
  of the probes shows to attract very many gets copies, over which its visitors are dealt.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.operators.timeline import cols
from homestream.session import cut_lineage

# Recognition settings.
TOLERANCE = 0.5
UNKNOWN = "Unknown"

BROADCAST_BYTES = 64 << 20 # vectors and names of a gallery that travels whole
BLOCK_ROWS = 8_192         # gallery vectors per block
PROBE_ROWS = 65_536        # probes that meet one copy of a block
SAMPLE = 64                # one in so many probes tells how many visit each block
PIVOTS = 128
RINGS = 8
_SLACK = 1e-9              # covers rounding in the bounds; never decides a match


def _matrix(column):
    import numpy as np
    import pyarrow as pa
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _squares(q, g):
    import numpy as np
    return (q * q).sum(1)[:, None] + (g * g).sum(1)[None, :] - 2.0 * (q @ g.T)


def _best(q, g):
    """Per row of q: index of the nearest row of g (the lowest on ties) and its distance.

    The matrix product only shortlists; the shortlist is measured by plain differences, so rounding
    in the product cannot pick a wrong neighbour.
    """
    import numpy as np
    best_d = np.full(len(q), np.inf)
    best_i = np.full(len(q), -1, dtype=np.int64)
    for start in range(0, len(g), 4096):
        part = g[start:start + 4096]
        for a in range(0, len(q), 1024):
            qa = q[a:a + 1024]
            sq = _squares(qa, part)
            scale = 1.0 + (qa * qa).sum(1) + (part * part).sum(1).max()
            near = sq <= (sq.min(1) + _SLACK * scale)[:, None]
            rows, hits = np.nonzero(near)
            for s in range(0, len(rows), 65_536):
                r, h = rows[s:s + 65_536], hits[s:s + 65_536]
                exact = np.sqrt(((qa[r] - part[h]) ** 2).sum(1))
                order = np.lexsort((h, exact, r))
                r, h, exact = r[order], h[order], exact[order]
                first = np.r_[True, r[1:] != r[:-1]]
                r, h, exact = r[first], h[first], exact[first]
                better = exact < best_d[a + r]
                best_d[a + r[better]] = exact[better]
                best_i[a + r[better]] = start + h[better]
    return best_i, best_d


def _result(keys, name, idx, distance):
    """Arrow batch (keys, name, gallery_idx, distance); all null where nothing matched."""
    import pyarrow as pa
    out = dict(keys)
    out["name"] = pa.array(name, pa.string())
    out["gallery_idx"] = pa.array(idx, pa.int64())
    out["distance"] = pa.array(distance, pa.float64())
    return pa.RecordBatch.from_pydict(out)


def _hits(batch, keys, vector, gallery, names, idx, tolerance, keep_all):
    """Best match per probe of one Arrow batch; unmatched probes only if ``keep_all``."""
    import numpy as np
    import pyarrow as pa
    column = batch.column(vector)
    known = np.asarray(column.is_valid())
    at, dist = np.full(batch.num_rows, -1, dtype=np.int64), np.full(batch.num_rows, np.inf)
    if known.any() and len(gallery):
        at[known], dist[known] = _best(_matrix(column.filter(pa.array(known))), gallery)
    ok = (at >= 0) & (dist <= tolerance)
    rows = np.arange(batch.num_rows) if keep_all else np.nonzero(ok)[0]
    take = pa.array(rows, pa.int64())
    return _result(
        {k: batch.column(k).take(take) for k in keys},
        [names[at[i]] if ok[i] else None for i in rows],
        [int(idx[at[i]]) if ok[i] else None for i in rows],
        [float(dist[i]) if ok[i] else None for i in rows],
    )


def nearest_match(probes: DataFrame, gallery: DataFrame, keys="probe_id", tolerance=TOLERANCE,
                  unknown=UNKNOWN, vector="encoding", broadcast_bytes=BROADCAST_BYTES,
                  block_rows=BLOCK_ROWS, probe_rows=PROBE_ROWS, sample=SAMPLE) -> DataFrame:
    """(keys, name, gallery_idx, distance, confidence): one row per probe.

    The nearest gallery row wins, ties go to the lowest ``gallery_idx``. Farther than ``tolerance``,
    or with an empty gallery, the probe is ``unknown`` with confidence 0. ``keys`` identify a probe.
    """
    keys = cols(keys)
    probes = probes.select(*keys, F.col(vector).alias("_vec"))
    gallery = gallery.filter(F.col(vector).isNotNull()).select("name", "gallery_idx", F.col(vector).alias("_vec"))

    if broadcast_bytes and _size(gallery) <= broadcast_bytes:
        found = _against_broadcast(probes, gallery.toArrow(), keys, tolerance)
    else:
        found = _against_blocks(probes, gallery, keys, tolerance, block_rows, probe_rows, sample)
    return found.select(
        *keys, F.coalesce("name", F.lit(unknown)).alias("name"), "gallery_idx", "distance",
        F.when(F.col("distance").isNotNull(), 1 - F.col("distance")).otherwise(0.0).alias("confidence"),
    )


def _size(gallery):
    """Bytes of a gallery in memory, from an aggregate: nothing is collected before it is known to fit."""
    row = F.size("_vec").cast("long") * 8 + F.coalesce(F.octet_length("name"), F.lit(0)) + 16
    return gallery.agg(F.sum(row)).first()[0] or 0


def _schema(probes, keys):
    return T.StructType([*[probes.schema[k] for k in keys], T.StructField("name", T.StringType()),
                         T.StructField("gallery_idx", T.LongType()), T.StructField("distance", T.DoubleType())])


def _against_broadcast(probes, head, keys, tolerance):
    import numpy as np
    head = head.sort_by("gallery_idx")
    vectors = _matrix(head.column("_vec"))
    names, idx = head.column("name").to_pylist(), head.column("gallery_idx").to_numpy()
    if len(vectors):                       # copies of a vector: the lowest index speaks for all
        _, first = np.unique(vectors, axis=0, return_index=True)
        first.sort()
        vectors, names, idx = vectors[first], [names[i] for i in first], idx[first]
    shared = probes.sparkSession.sparkContext.broadcast((vectors, names, idx))

    def run(batches):
        vectors, names, idx = shared.value
        for batch in batches:
            yield _hits(batch, keys, "_vec", vectors, names, idx, tolerance, keep_all=True)

    return probes.mapInArrow(run, _schema(probes, keys))


def _meetings(probes, gallery, keys, tolerance, block_rows, probe_rows, sample):
    """(probes by the blocks they visit, gallery rows by block), both with _block, _split and _slot; None for an empty
    gallery."""
    import numpy as np
    # copies of a vector fold into the one with the lowest index before anything else
    distinct = gallery.groupBy("_vec").agg(F.min(F.struct("gallery_idx", "name")).alias("_g")).select(
        "_vec", "_g.gallery_idx", "_g.name")

    # pivots: any choice is exact, a hash order spreads them; PIVOTS vectors at most
    pivots = _matrix(distinct.orderBy(F.xxhash64("gallery_idx"), "gallery_idx").limit(PIVOTS).select("_vec")
                     .toArrow().column("_vec"))
    if not len(pivots):
        return None

    def to_cell(batches):
        import pyarrow as pa
        for batch in batches:
            v = _matrix(batch.column("_vec"))
            cell, d = _best(v, pivots) if len(v) else (np.zeros(0, dtype=np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d)],
                names=[*batch.schema.names, "_cell", "_d"])

    placed = cut_lineage(distinct.mapInArrow(to_cell, T.StructType(
        [*distinct.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_d", T.DoubleType())])))

    # ring borders: one row per cell, at most PIVOTS rows
    cuts = [i / RINGS for i in range(1, RINGS)]
    borders = placed.groupBy("_cell").agg(F.percentile_approx("_d", cuts, 1000).alias("_cuts"))
    border_of = {r["_cell"]: [float(x) for x in r["_cuts"]] for r in borders.collect()}
    table = F.create_map(*[x for c, b in sorted(border_of.items())
                           for x in (F.lit(c), F.array(*[F.lit(v) for v in b]))])
    ringed = placed.withColumn("_ring", F.size(F.filter(table[F.col("_cell")], lambda b: b < F.col("_d"))))

    # rings that hold more than a block are split by hash; at most PIVOTS x RINGS rows
    stats = ringed.groupBy("_cell", "_ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("_d").alias("lo"), F.max("_d").alias("hi")).collect()
    cells = np.array([r["_cell"] for r in stats])
    lo, hi = np.array([r["lo"] for r in stats]), np.array([r["hi"] for r in stats])
    splits = np.array([-(-r["n"] // block_rows) for r in stats])
    ids = F.create_map(*[x for i, r in enumerate(stats)
                         for x in (F.lit(r["_cell"] * RINGS + r["_ring"]), F.array(F.lit(i), F.lit(int(splits[i]))))])
    entry = ids[F.col("_cell") * RINGS + F.col("_ring")]

    def to_blocks(batches):
        import pyarrow as pa
        for batch in batches:
            batch = batch.filter(batch.column("_vec").is_valid())
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                d = np.sqrt(np.maximum(_squares(_matrix(part.column("_vec")), pivots), 0.0))[:, cells]
                gap = np.maximum(np.maximum(d - hi, lo - d), 0.0)
                # some vector lies at distance `lo` from its pivot, so the nearest is within d + lo
                reach = np.minimum((d + lo).min(1), tolerance)[:, None]
                rows, hit = np.nonzero(gap <= reach + 1e-6)
                times = splits[hit]
                rows, hit = np.repeat(rows, times), np.repeat(hit, times)
                split = np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)
                for s in range(0, len(rows), 8192):
                    take = part.take(pa.array(rows[s:s + 8192]))
                    yield pa.RecordBatch.from_arrays(
                        [*take.columns, pa.array(hit[s:s + 8192].astype(np.int32)),
                         pa.array(split[s:s + 8192].astype(np.int32))],
                        names=[*take.schema.names, "_block", "_split"])

    layout = T.StructType([*probes.schema.fields, T.StructField("_block", T.IntegerType()), T.StructField("_split", T.IntegerType())])
    # how many probes visit each block, at most PIVOTS x RINGS rows; it only decides where rows go
    counted = (probes.filter(F.pmod(F.xxhash64(*keys), F.lit(sample)) == 0).mapInArrow(to_blocks, layout)
               .filter("_split = 0").groupBy("_block").count().collect())
    busy = {r["_block"]: -(-r["count"] * sample // probe_rows) for r in counted}
    busy = {b: n for b, n in busy.items() if n > 1}
    slots = F.lit(1)
    if busy:
        table = F.create_map(*[x for b, n in sorted(busy.items()) for x in (F.lit(b), F.lit(n))])
        slots = F.coalesce(F.try_element_at(table, F.col("_block")), F.lit(1))
    visits = probes.mapInArrow(to_blocks, layout).withColumn("_slot", F.pmod(F.xxhash64(*keys, F.lit(1)), slots).cast("int"))
    blocks = (
        ringed.withColumn("_e", entry)
        .select(F.col("_e")[0].alias("_block"), F.expr("cast(pmod(xxhash64(gallery_idx), _e[1]) as int)").alias("_split"),
                "gallery_idx", "name", "_vec")
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), slots - 1)))
    )
    return visits, blocks


def _against_blocks(probes, gallery, keys, tolerance, block_rows, probe_rows, sample):
    none = probes.select(*keys, F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("gallery_idx"),
                         F.lit(None).cast("double").alias("distance"))
    met = _meetings(probes, gallery, keys, tolerance, block_rows, probe_rows, sample)
    if met is None:
        return none
    visits, blocks = met

    def meet(left, right):
        import pyarrow as pa
        right = right.sort_by("gallery_idx")
        vectors = _matrix(right.column("_vec"))
        names, idx = right.column("name").to_pylist(), right.column("gallery_idx").to_numpy()
        batch = pa.Table.to_batches(left.combine_chunks())
        out = [_hits(b, keys, "_vec", vectors, names, idx, tolerance, keep_all=False) for b in batch]
        schema = pa.schema([*[left.schema.field(k) for k in keys], ("name", pa.string()),
                            ("gallery_idx", pa.int64()), ("distance", pa.float64())])
        return pa.Table.from_batches([b.cast(schema) for b in out], schema)

    group = ["_block", "_split", "_slot"]
    schema = _schema(probes, keys)
    matches = visits.groupBy(*group).cogroup(blocks.groupBy(*group)).applyInArrow(meet, schema)
    # a probe without any match keeps its row: the placeholder sorts behind every match
    every = matches.unionByName(none)
    best = F.min_by(F.struct("name", "gallery_idx", "distance"),
                    F.struct(F.coalesce("distance", F.lit(float("inf"))), "gallery_idx"))
    return every.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.name", "_b.gallery_idx", "_b.distance")
