"""Change detection: keep a device's first row and every row that differs from the last kept one.

Reference semantics with ``null_mode="sticky"``: two values differ only if both are known. The state
is the last *kept* row, so a null in it hides later changes of that field until another watched field
changes. ``null_mode="ignore"`` compares with the last known value instead.

Batch form. The steady fields (never null) cut a key's timeline into runs. Inside a run a row is kept
iff it opens the run, or the nullable field was known at the opening and differs from its last known
value. A plain ``lag`` is wrong as soon as nulls occur. All windows share one (key, chunk) exchange, which the
carries of earlier chunks reuse.
"""

from pyspark.sql import DataFrame, functions as F

from homestream.operators.timeline import (
    CHUNK, DEFAULT_WIDTH, NEXT, before, bundled, cols, following, keeps_bundle, known_keys, last_known,
    last_known_before, spec, unbundled, upto, with_chunk,
)
from homestream.functions.columns import differs
from homestream.operators.sticky import sticky_changes
from homestream.schemas import KINDS

ORDER = ("event_ts", "seq")


def changes_only(df: DataFrame, key, steady=(), nullable=None, order=ORDER, null_mode="sticky", chunk=DEFAULT_WIDTH) -> DataFrame:
    """Rows that change ``steady`` (fields never null here) or ``nullable``.

    Several nullable fields go to :func:`homestream.operators.sticky.sticky_changes`. A stream is filtered micro-batch by
    micro-batch, see :class:`homestream.streaming.changes.ChangeFilter`.
    """
    if df.isStreaming:
        raise ValueError("on a stream, apply streaming.changes.ChangeFilter to its micro-batches")
    watch = [*cols(steady), *(cols(nullable) if nullable else [])]
    if null_mode == "ignore":
        return changes_of_known(df, key, watch, order, chunk)
    if nullable and len(cols(nullable)) > 1:
        return sticky_changes(df, key, watch, order, chunk)[0]
    nullable = cols(nullable)[0] if nullable else None
    if null_mode != "sticky":
        raise ValueError("null_mode must be 'sticky' or 'ignore'")

    key, order = cols(key), cols(order)
    c, f = F.col("_c"), F.col("_f")
    rows = with_chunk(known_keys(df, key), order, chunk).withColumns({
        "_c": F.struct(*cols(steady)) if cols(steady) else F.struct(F.lit(1)),
        "_f": F.col(nullable) if nullable else F.lit(None).cast("string"),
    })
    apart = [*key, *[o for o in order if o not in key]]
    rows = bundled(rows, df.columns, apart, CHUNK, "_c", "_f")
    out = unbundled(df.columns, apart)
    w = spec([*key, CHUNK], order)
    past, now = before(w), upto(w)

    local = (
        rows.withColumn("_prev", F.lag("_c").over(w))
        .withColumn("_opens", F.col("_prev").isNull() | (F.col("_prev") != c))
        .withColumns({
            "_run": F.sum(F.when(F.col("_prev").isNotNull() & F.col("_opens"), 1).otherwise(0)).over(now),
            # struct-wrapped, so that a null at the opening is a value and not a gap
            "_f0": last_known(F.when(F.col("_opens"), F.struct(f.alias("v"))), now),
            "_pf": last_known(F.when(F.col("_opens") | f.isNotNull(), F.struct(f.alias("v"))), past),
            NEXT: following(w),
        })
    )
    f0 = F.col("_f0.v")
    pf = F.when(F.col("_opens"), F.lit(None)).otherwise(F.col("_pf.v"))
    inside = F.col("_opens") | (f0.isNotNull() & differs(pf, f))
    if chunk is None:
        return local.filter(inside).select(*out)

    carry = _carry(local.filter(F.col(NEXT).isNull()).select(
        *key, CHUNK, "_c", F.col("_run").alias("_run"), f0.alias("_f0"), F.coalesce(f, pf).alias("_lf"),
    ), key)
    continues = (F.col("_run") == 0) & F.coalesce(F.col("_c_in") == c, F.lit(False))
    kept = F.when(continues, F.col("_f_in").isNotNull() & differs(F.coalesce(pf, "_f_in"), f)).otherwise(inside)
    return local.filter(keeps_bundle()).join(carry, [*key, CHUNK], "left").filter(kept).select(*out)


def _carry(tails: DataFrame, key) -> DataFrame:
    """State left behind by all earlier chunks, from one tail row per (key, chunk).

    A chunk opens a run if it holds an inner run boundary or starts on another value than its
    predecessor ended on; otherwise the predecessor's run goes on through it.
    """
    w = spec(key, CHUNK)
    last_c = F.lag("_c").over(w)
    scanned = (
        tails.withColumn("_new", (F.col("_run") > 0) | last_c.isNull() | (last_c != F.col("_c")))
        .withColumns({
            "_s0": last_known(F.when(F.col("_new"), F.struct(F.col("_f0").alias("v"))), upto(w)),
            "_sl": last_known(
                F.when(F.col("_new") | F.col("_lf").isNotNull(), F.struct(F.col("_lf").alias("v"))), upto(w)),
        })
        .withColumn("_state", F.when(F.col("_s0.v").isNotNull(), F.col("_sl.v")))
    )
    return scanned.select(
        *key, CHUNK, F.lag("_c").over(w).alias("_c_in"), F.lag("_state").over(w).alias("_f_in"),
    ).filter(F.col("_c_in").isNotNull())


def changes_of_known(df: DataFrame, key, watch, order, chunk, known: DataFrame = None) -> DataFrame:
    """Rows with a known value that differs from the key's last known one. ``known``: key columns and last known values
    from before."""
    if known is not None:
        known = known_keys(known, key).select(*cols(key), *[F.col(c).alias(f"_known_{c}") for c in watch])
    prev = last_known_before(known_keys(df, key), key, order, {f"_known_{c}": F.col(c) for c in watch}, chunk, known)
    fresh = F.lit(False)
    for c in watch:
        fresh = fresh | (F.col(c).isNotNull() & ~F.coalesce(F.col(f"_known_{c}") == F.col(c), F.lit(False)))
    return prev.filter(fresh).select(*df.columns)


def device_changes(df: DataFrame, kind: str, order=ORDER, null_mode="sticky", chunk=DEFAULT_WIDTH):
    """Change filter of one device kind on its cleaned rows."""
    k = KINDS[kind]
    return changes_only(df, k.key, k.steady, k.watched_nullable, order, null_mode, chunk)


def with_last_change(changes: DataFrame, key, order=ORDER, out="last_change", refresh=True) -> DataFrame:
    """Time of the key's latest change, one row per key.

    ``refresh=False`` keeps the time of the first change only, as the door stream does.
    """
    ts = cols(order)[0]
    return changes.groupBy(*cols(key)).agg((F.max(ts) if refresh else F.min(ts)).alias(out))
