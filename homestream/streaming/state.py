"""State per key between the micro-batches of a query, as a versioned table.

A micro-batch is worked off by a batch operator that spreads a busy key over many tasks, starts from the state and says
which state it leaves: a row for each key, whatever the number of its rows. The state's version carries the run and
batch id of the micro-batch, so a replay starts from the version before its own and writes the same one again. What a
task holds is a chunk of a key's timeline within one micro-batch; micro-batches are bounded by the source's limits.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.functions.columns import duration_micros
from homestream.operators.timeline import cols
from homestream.streaming.sinks import KeyedTable, run_of

SEEN = "_seen"


class KeyedState:
    """``step(rows, state) -> (output, state after)`` over micro-batches.

    ``fields``: the state's columns beside the key. With ``ttl`` a key that stays silent that long in event time is
    forgotten, and rows behind the watermark (latest event time of earlier micro-batches less ``watermark``) are late
    and left out; by default nothing is forgotten and no row is late.
    """

    def __init__(self, spark, path, rows: T.StructType, key, fields, step, ts="event_ts", ttl=None, watermark="1 second", commits=None):
        self.spark, self.key, self.step, self.ts = spark, cols(key), step, ts
        self.ttl = duration_micros(ttl) if ttl else None
        self.delay = duration_micros(watermark)
        times = [T.StructField(SEEN, T.TimestampType())] if ttl else []
        self.fields = [f if isinstance(f, T.StructField) else rows[f] for f in fields]
        self.schema = T.StructType([*[rows[k] for k in self.key], *self.fields, *times])
        self.table = KeyedTable(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in self.schema]), commits=commits)
        self._held = []

    def hold(self, df: DataFrame) -> DataFrame:
        """Persist a frame that both the output and the state of a micro-batch are worked out from."""
        self._held.append(df.persist())
        return self._held[-1]

    def release(self):
        """Call when the output of a micro-batch has been used."""
        while self._held:
            self._held.pop().unpersist()

    def _behind(self, seen: DataFrame, micros):
        """The latest event time in ``seen`` less ``micros``, as a literal; None before the first row."""
        last = seen.agg(F.max(F.unix_micros(SEEN))).first()[0]
        return None if last is None else F.timestamp_micros(F.lit(last - micros))

    def advance(self, batch: DataFrame, batch_id, run=None) -> DataFrame:
        """The output of a micro-batch; the state after it is written. Compute it from a persisted batch, and
        :meth:`release` what was held for it afterwards."""
        self.release()
        name, state = self.table.turn(run or run_of(batch), batch_id)
        names = [*self.key, *[f.name for f in self.fields]]
        if self.ttl:
            mark = self._behind(state, self.delay)
            batch = batch if mark is None else batch.filter(F.col(self.ts) >= mark)
        out, after = self.step(batch, state.select(*names))
        after = after.select(*names)
        if self.ttl:
            seen = (state.select(*self.key, SEEN).unionByName(batch.select(*self.key, F.col(self.ts).alias(SEEN)))
                    .groupBy(*self.key).agg(F.max(SEEN).alias(SEEN)))
            mark = self._behind(seen, self.delay + self.ttl)
            after = after.join(seen, self.key)
            after = after if mark is None else after.filter(F.col(SEEN) >= mark)
        self.table.write(after, name)
        return out
