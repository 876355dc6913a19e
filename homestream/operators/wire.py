"""Wire frames: magic byte, 4-byte schema id, then the record in Avro binary.

All device records are flat unions of null and string or null and float, so a whole Arrow batch is
coded at once with array arithmetic: the cursor of every row advances field by field, and no Python
statement runs per row.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.operators.clean import REASON
from homestream.schemas import KINDS

HEADER = 5


def schema_id(value):
    """Bytes 2-5 of a frame as a big-endian number; null when the frame is shorter than its header."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.length(c) >= HEADER, F.conv(F.hex(F.substring(c, 2, 4)), 16, 10).cast("bigint"))


class _Cursor:
    """Reading position of every frame of a batch inside one shared byte buffer."""

    def __init__(self, column):
        import numpy as np
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.bytes = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.pos = offsets[:-1].astype(np.int64)
        self.end = offsets[1:].astype(np.int64)
        self.ok = np.asarray(column.is_valid()) & (self.end - self.pos >= HEADER)
        self.pos = self.pos + HEADER

    def _fail(self, bad):
        self.ok &= ~bad

    def byte(self, where):
        """Next byte of the rows in ``where``; rows at their end become bad."""
        import numpy as np
        self._fail(where & (self.pos >= self.end))
        live = where & self.ok
        out = np.zeros(len(self.pos), dtype=np.int64)
        out[live] = self.bytes[self.pos[live]]
        self.pos[live] += 1
        return out

    def varint(self, where):
        import numpy as np
        value = np.zeros(len(self.pos), dtype=np.int64)
        more = where & self.ok
        for shift in range(0, 35, 7):
            if not more.any():
                break
            b = self.byte(more)
            value |= np.where(more, (b & 0x7F) << shift, 0)
            more = more & self.ok & (b & 0x80 != 0)
        self._fail(more)
        return (value >> 1) ^ -(value & 1)

    def present(self):
        """Union branch: 0 is null, 1 is the value, anything else is a bad frame."""
        import numpy as np
        branch = self.varint(np.ones(len(self.pos), dtype=bool))
        self._fail((branch != 0) & (branch != 1))
        return self.ok & (branch == 1)

    def span(self, where, length):
        """Start of ``length`` bytes; rows that do not have them become bad."""
        import numpy as np
        size = np.where(where, length, 0)
        self._fail(where & ((size < 0) | (self.pos + size > self.end)))
        start = self.pos.copy()
        self.pos = np.where(self.ok & where, self.pos + size, self.pos)
        return start


def _gather(data, start, size):
    """Concatenate data[start:start+size] of all rows."""
    import numpy as np
    total = int(size.sum())
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
    return data[at]


def _strings(cur, mask, start, size):
    import numpy as np
    import pyarrow as pa
    size = np.where(mask & cur.ok, size, 0)
    data = _gather(cur.bytes, start, size)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    raw = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    try:
        text = raw.cast(pa.large_string())
    except pa.ArrowInvalid:    # not UTF-8: replace what cannot be read, as the JVM decoder does
        text = pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.large_string())
    return pa.compute.if_else(pa.array(mask & cur.ok), text.cast(pa.string()), pa.scalar(None, pa.string()))


def _decode_column(column, fields):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401  (pa.compute)
    cur = _Cursor(column)
    parts = []
    for _, is_float in fields:
        mask = cur.present()
        size = np.full(len(mask), 4, dtype=np.int64) if is_float else cur.varint(mask)
        parts.append((is_float, mask, cur.span(mask, size), size))
    out = []
    for is_float, mask, start, size in parts:
        live = mask & cur.ok
        if is_float:
            values = np.zeros(len(mask), dtype=np.float32)
            values[live] = _gather(cur.bytes, start[live], size[live]).view("<f4")
            out.append(pa.array(values, mask=~live))
        else:
            out.append(_strings(cur, mask, start, size))
    return out, cur.ok


def _fields(kind):
    return [(f.name, isinstance(f.dataType, T.FloatType)) for f in KINDS[kind].schema]


def decode_frames(df: DataFrame, kind: str, value_col="value", on_error="quarantine") -> DataFrame:
    """Replace a binary frame column by the record's fields.

    Quarantine keeps an unreadable frame (empty, short, truncated, unknown branch) together with its
    schema id and a reason; ``drop`` leaves it out, ``fail`` raises. Bytes after the record are ignored.
    """
    fields = _fields(kind)
    rest = [c for c in df.columns if c != value_col]
    keep = on_error == "quarantine"
    schema = T.StructType([df.schema[c] for c in rest] + KINDS[kind].schema.fields + (
        [T.StructField(REASON, T.StringType()), T.StructField("frame", T.BinaryType())] if keep else []))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            column = batch.column(value_col).cast(pa.binary())
            decoded, ok = _decode_column(column, fields)
            if on_error == "fail" and not ok.all():
                raise ValueError(f"{int((~ok).sum())} unreadable frames of kind {kind}")
            columns = [batch.column(c) for c in rest] + decoded
            names = rest + [n for n, _ in fields]
            if keep:
                reason = np.where(ok, None, "frame")
                columns += [pa.array(reason, pa.string()),
                            pa.compute.if_else(pa.array(ok), pa.scalar(None, pa.binary()), column)]
                names += [REASON, "frame"]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out.filter(pa.array(ok)) if on_error == "drop" else out

    out = df.mapInArrow(run, schema)
    return out.withColumn("schema_id", schema_id("frame")) if keep else out


def _varints(n):
    """Zigzag varints of non-negative numbers: (n, 5) bytes and how many of them are used."""
    import numpy as np
    z = n.astype(np.uint64) << np.uint64(1)
    out = np.zeros((len(n), 5), dtype=np.uint8)
    used = np.ones(len(n), dtype=np.int64)
    for i in range(5):
        rest = z >> np.uint64(7)
        out[:, i] = (z & np.uint64(0x7F)).astype(np.uint8) | np.where(rest > 0, 0x80, 0).astype(np.uint8)
        used = np.where(rest > 0, i + 2, used)
        z = rest
    return out, np.minimum(used, 5)


def encode_frames(df: DataFrame, kind: str, schema_id: int, value_col="value") -> DataFrame:
    """Replace a record's fields by its wire frame (inverse of :func:`decode_frames`)."""
    fields = _fields(kind)
    names = [n for n, _ in fields]
    rest = [c for c in df.columns if c not in names]
    header = b"\x00" + int(schema_id).to_bytes(4, "big")
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(value_col, T.BinaryType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            n = batch.num_rows
            # pieces in field order: (bytes of all rows, start per row, size per row)
            pieces = [(np.frombuffer(header, np.uint8), np.zeros(n, np.int64), np.full(n, HEADER))]
            for name, is_float in fields:
                column = batch.column(name)
                known = np.asarray(column.is_valid())
                pieces.append((np.array([0, 2], np.uint8), known.astype(np.int64), np.ones(n, np.int64)))
                if is_float:
                    raw = np.asarray(column.fill_null(0.0)).astype("<f4").view(np.uint8)
                    pieces.append((raw, np.arange(n) * 4, np.where(known, 4, 0)))
                    continue
                text = column.cast(pa.large_string()).cast(pa.large_binary())
                offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + n + 1]
                data = text.buffers()[2]
                data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
                size = np.where(known, offsets[1:] - offsets[:-1], 0)
                code, used = _varints(size)
                pieces.append((code.ravel(), np.arange(n) * 5, np.where(known, used, 0)))
                pieces.append((data, offsets[:-1].astype(np.int64), size))
            sizes = np.stack([s for _, _, s in pieces], axis=1).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes.sum(1))])
            place = ends[:-1, None] + np.cumsum(sizes, axis=1) - sizes
            buffer = np.zeros(int(ends[-1]), dtype=np.uint8)
            for j, (data, start, _) in enumerate(pieces):
                size = sizes[:, j]
                run_no = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                buffer[np.repeat(place[:, j], size) + run_no] = data[np.repeat(start, size) + run_no]
            frames = pa.Array.from_buffers(
                pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buffer)]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], frames], names=rest + [value_col])

    return df.select(*rest, *names).mapInArrow(run, schema)
