"""Streaming change detection, confirmation and carried results: the batch operators with a state between micro-batches.

Rows of one micro-batch are ordered by ``order``. Rows that arrive in a later one are compared as they arrive and never
re-sorted.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.operators import frames
from homestream.operators.changes import changes_of_known
from homestream.operators.keyed import coalesce_upsert
from homestream.operators.sticky import ORDER, sticky_changes
from homestream.operators.timeline import DEFAULT_ROWS, DEFAULT_WIDTH, cols, known_keys
from homestream.streaming.state import KeyedState

CHANGED = "_changed_at"


class ChangeFilter(KeyedState):
    """Rows that differ from the key's last kept row in any watched field, all of which may be null.

    The state is that row's watched fields (``null_mode="ignore"``: the last known values). ``last_change`` names an
    output column with the event time of the key's latest change (``refresh=False``: of its first).
    """

    def __init__(self, spark, path, rows: T.StructType, key, watch, order=ORDER, null_mode="sticky", chunk=DEFAULT_WIDTH,
                 last_change=None, refresh=True, **options):
        if null_mode not in ("sticky", "ignore"):
            raise ValueError("null_mode must be 'sticky' or 'ignore'")
        watch, order = cols(watch), [c for c in cols(order) if c in rows.fieldNames()]
        first = last_change and not refresh

        def step(batch, state):
            batch = known_keys(batch, key)
            if null_mode == "ignore":
                kept = changes_of_known(batch, key, watch, order, chunk, state)
                after = coalesce_upsert(state.select(*cols(key), *watch), batch, key, watch, order)
            else:
                kept, after = sticky_changes(batch, key, watch, order, chunk, state, self.hold)
            if first:
                # one row for each key: the time from before, else that of the earliest change at hand
                times = (state.select(*cols(key), CHANGED).unionByName(kept.select(*cols(key), F.col(order[0]).alias(CHANGED)))
                         .groupBy(*cols(key)).agg(F.min(CHANGED).alias(CHANGED)))
                after = after.join(times, cols(key), "left")
                kept = kept.join(times.withColumnRenamed(CHANGED, last_change), cols(key))
            elif last_change:
                kept = kept.withColumn(last_change, F.col(order[0]))
            return kept, after

        fields = [*watch, *([T.StructField(CHANGED, T.TimestampType())] if first else [])]
        super().__init__(spark, path, rows, key, fields, step, ts=order[0], **options)


class Confirmation(KeyedState):
    """First frame of each session at which the same name was confidently seen ``n`` times in a row.

    The state is the name a session is at, the length of its run, and whether it was confirmed. A confirmed session has
    ended: its later frames are left out until ``ttl`` of silence removes it, as any silent session.
    """

    def __init__(self, spark, path, rows: T.StructType, session="session", order=("frame_no",), n=frames.CONFIRMATIONS,
                 min_confidence=frames.MIN_CONFIDENCE, unknown=frames.UNKNOWN, chunk=DEFAULT_ROWS, **options):
        key = cols(session)

        def step(batch, state):
            batch = known_keys(batch, key)
            done, going = state.filter("done"), state.filter("not done")
            rows = batch.join(done.select(*key), key, "left_anti").select(batch.columns)
            found, after = frames.confirm_step(rows, key, order, n, min_confidence, unknown, chunk, going)
            after = (after.join(found.select(*key, F.lit(True).alias("_found")), key, "left")
                     .select(*key, "name", "length", F.col("_found").isNotNull().alias("done")))
            return found, after.unionByName(done.select(after.columns))

        fields = [T.StructField("name", T.StringType()), T.StructField("length", T.LongType()), T.StructField("done", T.BooleanType())]
        super().__init__(spark, path, rows, key, fields, step, **options)


class CarryForward(KeyedState):
    """Rows with each null filled with the session's last known value, also from earlier micro-batches."""

    def __init__(self, spark, path, rows: T.StructType, session, order, values, chunk=DEFAULT_ROWS, **options):
        key, values = cols(session), cols(values)

        def step(batch, state):
            return (frames.carry_forward(batch, key, order, values, chunk, state),
                    coalesce_upsert(state, known_keys(batch, key), key, values, order))

        super().__init__(spark, path, rows, key, values, step, **options)


def each_batch(state: KeyedState, write):
    """foreachBatch writer: ``write(output, batch_id)`` of each micro-batch, which is persisted meanwhile."""
    def run(batch: DataFrame, batch_id: int):
        batch = batch.persist()
        try:
            write(state.advance(batch, batch_id), batch_id)
        finally:
            state.release()
            batch.unpersist()
    return run
