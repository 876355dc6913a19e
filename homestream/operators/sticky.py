"""Change detection over any number of nullable fields, and with a state to start from.

The rule is that of :mod:`homestream.operators.changes` with ``null_mode="sticky"``: a row is kept iff some watched
field is known in it, known in the key's last kept row, and different; the kept row replaces the state whole, nulls
included; a key's first row is kept. With one nullable field windows can say that, with several no window form is known.

What a chunk of a key's timeline does to a state is a function that a few rows describe. Whatever the state, the chunk's
first kept row is one of its *entries*: its first row (no state yet), or for some field the first known value or the
first known value that differs from that one. From an entry on, the kept rows don't depend on the state any more. So a
task reads a chunk once, follows each entry to the end, and emits the rows that some entry keeps, marked with those
entries, and one summary: the entries' places and the states they end in. Summaries are composed along the key in the
order of the chunks, from the state given, and tell each chunk its entry. Rows meet it by (key, chunk).

No task holds more than a chunk. Summaries pass one after the other.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.operators.timeline import CHUNK, DEFAULT_WIDTH, cols, known_keys, with_chunk

ORDER = ("event_ts", "seq")


def _hit(old, new):
    return any(a is not None and b is not None and a != b for a, b in zip(old, new))


def entries_of(rows):
    """Places of a chunk's entries: its first row, and two for each field (None: there is none)."""
    places = [0]
    for field in zip(*rows):
        first = next((i for i, v in enumerate(field) if v is not None), None)
        places += [first, None if first is None else next(
            (i for i, v in enumerate(field[first:], first) if v is not None and v != field[first]), None)]
    return places


def follow(rows, places):
    """Bit mask of the entries that keep each row, and the place each entry ends at (None for no entry)."""
    masks, path, ends = [0] * len(rows), {}, [None] * len(places)
    for e, start in enumerate(places):
        if start is None:
            continue
        at, kept = start, []
        while at is not None and at not in path:
            kept.append(at)
            old = rows[at]
            at = next((i for i in range(at + 1, len(rows)) if _hit(old, rows[i])), None)
        # from here on the way is known
        end = kept[-1] if at is None else path[at][1]
        for place, after in zip(kept, [*kept[1:], at]):
            path[place] = after, end
        at = start
        while at is not None:
            masks[at] |= 1 << e
            at = path[at][0]
        ends[e] = end
    return masks, ends


def chosen(state, firsts, places):
    """The entry that a state (None: none yet) enters a chunk by; None if the chunk keeps nothing."""
    if state is None:
        return 0
    best = None
    for i, (old, first) in enumerate(zip(state, firsts)):
        e = 1 + 2 * i if old != first else 2 + 2 * i
        if old is not None and places[e] is not None and (best is None or places[e] < places[best]):
            best = e
    return best


def _value_type(df, watch):
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in watch])


def _read_chunks(df: DataFrame, key, watch, order) -> DataFrame:
    """Rows sorted by (key, chunk, order) -> marked rows and one summary row for each (key, chunk).

    A row's columns lie in ``_row``; a summary row has ``_firsts``, ``_places`` and ``_ends``.
    """
    values = _value_type(df, watch)
    schema = T.StructType([
        *[df.schema[k] for k in key], T.StructField(CHUNK, T.LongType()), T.StructField("_row", df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType),
        T.StructField("_mask", T.LongType()), T.StructField("_firsts", values), T.StructField("_places", T.ArrayType(T.LongType())),
        T.StructField("_ends", T.ArrayType(values))])
    names = df.columns

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        kinds = to_arrow_schema(schema)
        row_type = kinds.field("_row").type
        as_row = lambda r: dict(zip(watch, r))

        def close(parts, starts):
            """Whole chunks, all at once: a batch of the rows that some entry keeps, and one of the summaries."""
            table = pa.Table.from_batches(parts)
            rows = list(zip(*[table.column(c).to_pylist() for c in watch]))
            at, marks, told = [], [], {"_firsts": [], "_places": [], "_ends": []}
            for lo, hi in zip(starts, [*starts[1:], table.num_rows]):
                chunk = rows[lo:hi]
                places = entries_of(chunk)
                masks, ends = follow(chunk, places)
                at += [i for i, m in enumerate(masks, lo) if m]
                marks += [m for m in masks if m]
                told["_firsts"].append(as_row([None if p is None else chunk[p][i] for i, p in enumerate(places[1::2])]))
                told["_places"].append(places)
                told["_ends"].append([None if e is None else as_row(chunk[e]) for e in ends])
            of = [*key, CHUNK]
            whole = lambda picked, c: picked.column(c).combine_chunks()
            kept, first = (table.take(pa.array(x, pa.int64())).combine_chunks() for x in (at, starts))
            row = pa.StructArray.from_arrays([whole(kept, c).cast(f.type) for c, f in zip(names, row_type)], fields=list(row_type))
            yield pa.RecordBatch.from_arrays(
                [*[whole(kept, c).cast(kinds.field(c).type) for c in of], row, pa.array(marks, pa.int64()),
                 *[pa.nulls(len(at), kinds.field(c).type) for c in told]], schema=kinds)
            yield pa.RecordBatch.from_arrays(
                [*[whole(first, c).cast(kinds.field(c).type) for c in of], *[pa.nulls(len(starts), kinds.field(c).type) for c in ("_row", "_mask")],
                 *[pa.array(v, kinds.field(c).type) for c, v in told.items()]], schema=kinds)

        # ``held``: what came so far of the chunks in it, of which only the last may go on
        held, starts, now, n = [], [], None, 0
        for b in batches:
            new = []
            for i, mark in enumerate(zip(*[b.column(c).to_pylist() for c in (*key, CHUNK)])):
                if mark != now:
                    new.append(i)
                    now = mark
            if new and n + new[-1]:
                last = new.pop()
                yield from close([*held, b.slice(0, last)], [*starts, *[n + i for i in new]])
                held, starts, n = [b.slice(last)], [0], b.num_rows - last
            else:
                held, starts, n = [*held, b], [*starts, *new], n + b.num_rows
        if n:
            yield from close(held, starts)

    return df.mapInArrow(run, schema)


def _compose(summaries: DataFrame, key, watch, values) -> DataFrame:
    """Summaries and start states (chunk null) sorted by (key, chunk) -> the entry of each (key, chunk), and in a row
    without chunk the state that each key ends in."""
    schema = T.StructType([*[summaries.schema[k] for k in key], T.StructField(CHUNK, T.LongType()), T.StructField("_entry", T.IntegerType()),
                           T.StructField("_state", values)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        kinds = to_arrow_schema(schema)
        now = state = None
        out = []
        as_row = lambda s: None if s is None else dict(zip(watch, s))
        for b in batches:
            for r in b.to_pylist():
                mark = tuple(r[k] for k in key)
                if mark != now:
                    if now is not None:
                        out.append({**dict(zip(key, now)), CHUNK: None, "_entry": None, "_state": as_row(state)})
                    now, state = mark, None
                if r[CHUNK] is None:
                    state = tuple(r["_firsts"][c] for c in watch)
                    continue
                e = chosen(state, [r["_firsts"][c] for c in watch], r["_places"])
                if e is not None:
                    state = tuple(r["_ends"][e][c] for c in watch)
                    out.append({**dict(zip(key, mark)), CHUNK: r[CHUNK], "_entry": e, "_state": None})
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out = []
        if now is not None:
            out.append({**dict(zip(key, now)), CHUNK: None, "_entry": None, "_state": as_row(state)})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return summaries.mapInArrow(run, schema)


def sticky_changes(df: DataFrame, key, watch, order=ORDER, chunk=DEFAULT_WIDTH, state: DataFrame = None, keep=lambda found: found):
    """(kept rows, state of every key after them). Watched fields may all be null.

    ``state``: key columns and watched fields of each key's last kept row. The rows are read and shuffled once: both
    frames come from the same exchange. ``keep`` may persist what was found in the chunks, which three readers share.
    Rows without a key are left out.
    """
    key, watch, order = cols(key), cols(watch), [c for c in cols(order) if c in df.columns]
    names = df.columns
    values = _value_type(df, watch)
    rows = with_chunk(known_keys(df, key), order, chunk)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keep(_read_chunks(rows.repartition(n, *key, CHUNK).sortWithinPartitions(*key, CHUNK, *order), key, watch, order))
    summaries = found.filter(F.col("_places").isNotNull()).select(*key, CHUNK, "_firsts", "_places", "_ends")
    if state is not None:
        summaries = summaries.unionByName(known_keys(state, key).select(
            *key, F.lit(None).cast("long").alias(CHUNK), F.struct(*watch).cast(values).alias("_firsts"),
            F.lit(None).cast("array<bigint>").alias("_places"), F.lit(None).cast(T.ArrayType(values)).alias("_ends")))
    composed = _compose(summaries.repartition(n, *key).sortWithinPartitions(*key, CHUNK), key, watch, values)
    # one row for each chunk: as many as the time is long, so they are not for a broadcast
    entry = composed.filter(F.col(CHUNK).isNotNull()).select(*key, CHUNK, "_entry").hint("shuffle_hash")
    kept = (found.filter(F.col("_mask").isNotNull()).select(*key, CHUNK, "_row", "_mask").join(entry, [*key, CHUNK])
            .filter(F.col("_mask").bitwiseAND(F.expr("shiftleft(1L, _entry)")) != 0)
            .select(*[F.col("_row")[c].alias(c) for c in names]))
    after = composed.filter(F.col(CHUNK).isNull()).select(*key, *[F.col("_state")[c].alias(c) for c in watch])
    return kept, after
