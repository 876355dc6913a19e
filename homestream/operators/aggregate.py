"""Sliding windows with an aggregate of the caller's own.

An aggregate says how to start (``create``), take a reading in (``add``), join two accumulators (``merge``, the earlier
one first) and finish (``result``). Tasks keep one accumulator for each (id, pane) they meet, a pane being one slide; the
partial ones meet by (id, pane), and only pane totals are copied into the windows that cover them. Accumulators pass a
merging task one after the other in sorted order, so no task holds a group, and a hot device is spread by its panes.
"""

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.functions.columns import duration_micros

#: Accumulators that a task holds before it hands them on.
HELD = 50_000


@dataclass(frozen=True)
class Aggregate:
    """``add(accumulator, reading)`` gets a reading as a dict of ``fields``; accumulators may be anything that pickles.

    ``result`` returns a dict of the columns in ``schema``. A partial accumulator takes readings in their order: a reading
    that comes before one taken already starts a new one. Accumulators merge in the order of their first readings.
    """

    create: Callable[[], Any]
    add: Callable[[Any, dict], Any]
    merge: Callable[[Any, Any], Any]
    result: Callable[[Any], dict]
    schema: str
    fields: tuple = field(default=("id", "value", "name", "password", "timestamp"))


def _partial(aggregate, order):
    def run(batches):
        import pyarrow as pa
        held, done = {}, []

        def flush():
            rows = [*done, *((i, pane, at, acc) for (i, pane), (at, acc, _) in held.items())]
            held.clear()
            done.clear()
            return pa.RecordBatch.from_pylist([{"id": i, "pane": p, "at": at, "acc": pickle.dumps(acc)} for i, p, at, acc in rows], schema=kinds)

        for b in batches:
            kinds = pa.schema([b.schema.field("id"), b.schema.field("pane"), ("at", pa.struct([b.schema.field(o) for o in order])), ("acc", pa.binary())])
            b = pa.Table.from_batches([b]).sort_by([(o, "ascending") for o in order])
            ids, panes = b.column("id").to_pylist(), b.column("pane").to_pylist()
            at = b.select(list(order)).to_pylist()
            for i, pane, when, reading in zip(ids, panes, at, b.select(list(aggregate.fields)).to_pylist()):
                mark = tuple((x is not None, x) for x in when.values())
                old = held.get((i, pane))
                if old is not None and mark < old[2]:
                    done.append((i, pane, *old[:2]))     # a later batch brings an earlier reading
                    old = None
                held[i, pane] = (when, aggregate.add(aggregate.create(), reading), mark) if old is None else (old[0], aggregate.add(old[1], reading), mark)
            if len(held) + len(done) >= HELD:
                yield flush()
        if held:
            yield flush()
    return run


def _merged(df: DataFrame, by, finish, schema) -> DataFrame:
    """Accumulators sorted by ``by`` and first reading -> one row of each group, as ``finish(key, first, accumulator)``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        kinds, out, now, first, acc = to_arrow_schema(schema), [], None, None, None
        for b in batches:
            for r in b.to_pylist():
                key = tuple(r[c] for c in by)
                if key == now:
                    acc = finish.merge(acc, pickle.loads(r["acc"]))
                    continue
                if now is not None:
                    out.append(finish(now, first, acc))
                now, first, acc = key, r["at"], pickle.loads(r["acc"])
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out = []
        if now is not None:
            out.append(finish(now, first, acc))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return df.repartition(n, *by).sortWithinPartitions(*by, "at").mapInArrow(run, schema)


class _Pane:
    """Keeps a pane's accumulator for its windows."""

    def __init__(self, aggregate):
        self.merge = aggregate.merge

    def __call__(self, key, first, acc):
        return {"id": key[0], "pane": key[1], "at": first, "acc": pickle.dumps(acc)}


class _Window:
    def __init__(self, aggregate):
        self.merge, self.result = aggregate.merge, aggregate.result

    def __call__(self, key, first, acc):
        return {"id": key[0], "window_start": key[1], **self.result(acc)}


def sliding_aggregate(df: DataFrame, aggregate: Aggregate, ts="event_ts", order=None, size="2 minutes", slide="1 minute") -> DataFrame:
    """(id, window_start, window_end, the aggregate's columns) of every window that holds a reading.

    ``size`` is a multiple of ``slide``. Readings without time lie in no window.
    """
    order = list(order or ([ts, "seq"] if "seq" in df.columns else [ts]))
    size_us, slide_us = duration_micros(size), duration_micros(slide)
    if size_us % slide_us:
        raise ValueError("size must be a multiple of slide")
    fields = [c for c in aggregate.fields if c != "id"]
    rows = df.filter(F.col(ts).isNotNull()).select(
        "id", F.window(ts, slide).start.alias("pane"), *dict.fromkeys([*order, *fields]))
    partial = T.StructType([rows.schema["id"], T.StructField("pane", rows.schema["pane"].dataType),
                            T.StructField("at", rows.select(F.struct(*order).alias("at")).schema["at"].dataType), T.StructField("acc", T.BinaryType())])
    found = rows.mapInArrow(_partial(aggregate, order), partial)
    panes = _merged(found, ["id", "pane"], _Pane(aggregate), partial)
    offsets = F.array(*[F.expr(f"make_dt_interval(0, 0, 0, {-i * slide_us / 1e6:.6f})") for i in range(size_us // slide_us)])
    covered = panes.select("id", F.explode(F.transform(offsets, lambda o: F.col("pane") + o)).alias("window_start"), "at", "acc")
    made = T.StructType.fromDDL(aggregate.schema)
    schema = T.StructType([rows.schema["id"], T.StructField("window_start", rows.schema["pane"].dataType), *made.fields])
    out = _merged(covered, ["id", "window_start"], _Window(aggregate), schema)
    end = F.col("window_start") + F.expr(f"make_dt_interval(0, 0, 0, {size_us / 1e6:.6f})")
    return out.select("id", "window_start", end.alias("window_end"), *made.fieldNames())


def average() -> Aggregate:
    """The built-in average once more, in the shape of a caller's aggregate: sum, count and the first payload."""
    return Aggregate(
        create=lambda: None,
        add=lambda acc, r: (r["name"], r["password"], r["timestamp"], r["value"] or 0.0, int(r["value"] is not None)) if acc is None
        else (*acc[:3], acc[3] + (r["value"] or 0.0), acc[4] + int(r["value"] is not None)),
        merge=lambda a, b: (*a[:3], a[3] + b[3], a[4] + b[4]),
        result=lambda a: {"avg_value": a[3] / a[4] if a[4] else 0.0, "readings": a[4], "name": a[0], "password": a[1], "timestamp": a[2]},
        schema="avg_value double, readings bigint, name string, password string, timestamp string")
