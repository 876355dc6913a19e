"""Ordered per-key computations that survive a hot key.

``Window.partitionBy(key)`` puts a key's whole history into one task, however long it is. Here the
timeline of a key is cut into chunks (a time width, or a width of an integer order column). Rows are
shuffled by (key, chunk), so a key that owns a third of all rows spreads over many tasks. What a
chunk needs from the past is a constant-size carry, computed from one summary row per chunk: summaries
are reduced map-side where possible, scanned in chunk order per key, and joined back on (key, chunk).
The join finds the rows already partitioned and sorted by these columns.

Where a chunk's summary is its last row, rows are read and shuffled once: both branches keep the payload,
bundled by :func:`bundled`, up to the windows, so that the second exchange is the first one reused. (Left to
column pruning, the summary branch would be narrower and so a scan and a shuffle of its own.)

A join never pairs null keys. :func:`known_keys` leaves rows without a key out where the operator has
no use for them; :func:`with_key` wraps the key in a struct, which is never null, where they must stay.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from homestream.functions.columns import duration_micros
from homestream.session import cut_lineage

CHUNK = "_chunk"
KEY = "_key"
ROW = "_row"
FIRST_CHUNK = -(1 << 63)
DEFAULT_WIDTH = "1 hour"
DEFAULT_ROWS = 100_000


def cols(names):
    return [names] if isinstance(names, str) else list(names)


def chunk_column(df: DataFrame, order, chunk) -> Column:
    """Chunk number of a row, never null: a null order comes first. ``None`` keeps a key in one piece
    (small, bounded inputs only)."""
    if chunk is None:
        return F.lit(0).cast("long")
    first = cols(order)[0]
    dtype = df.schema[first].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        width = duration_micros(DEFAULT_WIDTH if isinstance(chunk, int) else chunk)
        number = F.floor(F.unix_micros(F.col(first).cast("timestamp")) / F.lit(width)).cast("long")
        return F.coalesce(number, F.lit(FIRST_CHUNK))
    if isinstance(dtype, T.IntegralType):
        width = chunk if isinstance(chunk, int) else DEFAULT_ROWS
        return F.coalesce(F.floor(F.col(first) / F.lit(width)).cast("long"), F.lit(FIRST_CHUNK))
    raise TypeError(f"cannot cut {first} of type {dtype.simpleString()} into chunks")


def known_keys(df: DataFrame, key) -> DataFrame:
    """Rows whose key is known. Both sides of the carry join filter alike, so that they can share one exchange."""
    for k in cols(key):
        df = df.filter(F.col(k).isNotNull())
    return df


def with_key(df: DataFrame, key) -> DataFrame:
    return df.withColumn(KEY, F.struct(*cols(key)))


def with_chunk(df: DataFrame, order, chunk) -> DataFrame:
    return df.withColumn(CHUNK, chunk_column(df, order, chunk))


def bundled(df: DataFrame, names, apart, *more) -> DataFrame:
    """``apart`` and ``more`` as they are, the rest of ``names`` in one struct, see :func:`unbundled`."""
    rest = [c for c in names if c not in apart]
    return df.select(*apart, *more, F.struct(*rest, F.lit(True).alias("_")).alias(ROW))


def unbundled(names, apart):
    return [F.col(c) if c in apart else F.col(ROW)[c].alias(c) for c in names]


NEXT = "_next"


def following(w) -> Column:
    """The bundle of the next row, as NEXT; null in the last row of a window."""
    return F.lead(ROW).over(w)


def keeps_bundle() -> Column:
    """True for every row. As it looks at NEXT, whatever later steps leave out, the row branch keeps the same
    columns as the summary branch and the two share their exchange."""
    return F.coalesce(F.col(NEXT)["_"], F.lit(True))


def spec(key, order, *more):
    return Window.partitionBy(*cols(key), *more).orderBy(*cols(order))


def before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def last_known(value: Column, w) -> Column:
    return F.last(value, ignorenulls=True).over(w)


def last_known_before(df: DataFrame, key, order, values: dict, chunk, seed: DataFrame = None) -> DataFrame:
    """Add, per named expression, its last non-null value strictly before the row.

    ``seed``: key columns and, by the same names, the values known before all rows. It needs chunks.
    """
    order = cols(order)
    rows = with_chunk(with_key(df, key), order, chunk).withColumns({f"_v_{n}": v for n, v in values.items()})
    rows = bundled(rows, df.columns, order, KEY, CHUNK, *[f"_v_{n}" for n in values])
    w = spec([KEY, CHUNK], order)
    local = rows.withColumns({n: last_known(F.col(f"_v_{n}"), before(w)) for n in values} | {NEXT: following(w)})
    out = [*unbundled(df.columns, order), *values]
    if chunk is None:
        return local.select(*out)

    tails = local.filter(F.col(NEXT).isNull()).select(KEY, CHUNK, *[F.coalesce(f"_v_{n}", n).alias(f"_t_{n}") for n in values])
    if seed is not None:
        # a chunk without number comes before all others
        tails = tails.unionByName(seed.select(F.struct(*cols(key)).alias(KEY), F.lit(None).cast("long").alias(CHUNK),
                                              *[F.col(n).alias(f"_t_{n}") for n in values]))
    earlier = before(spec(KEY, CHUNK))
    carry = tails.select(KEY, CHUNK, *[
        last_known(F.col(f"_t_{n}"), earlier).alias(f"_in_{n}") for n in values
    ])
    return (
        local.filter(keeps_bundle()).join(carry, [KEY, CHUNK], "left")
        .withColumns({n: F.coalesce(n, f"_in_{n}") for n in values})
        .select(*out)
    )


def carry_forward(df: DataFrame, key, order, values, chunk=DEFAULT_ROWS, seed: DataFrame = None) -> DataFrame:
    """Fill each null with the key's last non-null value; rows before the first value stay null. ``seed``: key columns
    and values known before all rows."""
    named = {f"_prev_{c}": F.col(c) for c in cols(values)}
    if seed is not None:
        seed = seed.select(*cols(key), *[F.col(c).alias(f"_prev_{c}") for c in cols(values)])
    filled = last_known_before(df, key, order, named, chunk, seed)
    return filled.withColumns(
        {c: F.coalesce(c, f"_prev_{c}") for c in cols(values)}
    ).drop(*named)


def number_rows(df: DataFrame, key, order, out, chunk=DEFAULT_WIDTH) -> DataFrame:
    """0-based position of each row in its key's timeline; (key, order) must be unique."""
    order = cols(order)
    rows = with_chunk(with_key(df, key), order, chunk)
    local = rows.withColumn(out, (F.row_number().over(spec([KEY, CHUNK], order)) - 1).cast("long"))
    if chunk is None:
        return local.select(*df.columns, out)
    sizes = rows.groupBy(KEY, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    skip = sizes.select(KEY, CHUNK, F.sum("_n").over(before(spec(KEY, CHUNK))).alias("_skip"))
    return (
        local.join(skip, [KEY, CHUNK], "left")
        .withColumn(out, F.col(out) + F.coalesce("_skip", F.lit(0)))
        .select(*df.columns, out)
    )


def number_all(df: DataFrame, order, out) -> DataFrame:
    """0-based position of each row in the whole table by ``order``, which must be unique.

    A range shuffle sorts, rows are numbered inside their parts, and each part adds the sizes of those before it: a
    table with one row for each partition.
    """
    at, part = "_at", F.shiftright("_at", 33)
    rows = cut_lineage(df.repartitionByRange(*cols(order)).sortWithinPartitions(*cols(order)).withColumn(at, F.monotonically_increasing_id()))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    place = F.col("_first") + F.col(at) - F.shiftleft(part, 33)
    return rows.join(F.broadcast(first), part == F.col("_part")).select(*df.columns, place.alias(out))
