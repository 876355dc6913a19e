"""Keyed tables as pure merges: (target, incoming) -> target. Writers only persist the result.

Every merge first folds the incoming rows per key with aggregates that combine map-side, so a hot key
costs one row per task in the shuffle, and only then meets the target in one equi-join.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from homestream.functions.columns import speed_value, status_flag
from homestream.operators.timeline import cols

ORDER = ("event_ts", "seq")


def _at(order):
    """A single order column stays bare: fixed-width buffers keep the aggregate hash-based."""
    order = cols(order)
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def fold_changes(changes: DataFrame, key, values, order) -> DataFrame:
    """Per key, each column's last non-null value: what a row-by-row COALESCE upsert would leave."""
    at = _at(order)
    return changes.groupBy(*cols(key)).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in values]
    )


def coalesce_upsert(target: DataFrame, changes: DataFrame, key, values, order=ORDER) -> DataFrame:
    """Insert unseen keys; for known keys each column becomes COALESCE(new, old)."""
    key = cols(key)
    new = fold_changes(changes, key, values, order).select(*key, *[F.col(c).alias(f"_new_{c}") for c in values])
    return (
        target.join(new, key, "full_outer")
        .select(*key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])
        .select(*target.columns)
    )


def absent_rows(target: DataFrame, rows: DataFrame, keys, order=None) -> DataFrame:
    """The rows an insert-if-absent would add, in target layout.

    Duplicates inside ``rows`` are settled by ``order`` (first wins). A row with a null in its key
    equals no other row, so it is always added.
    """
    keys = cols(keys)
    rest = [c for c in target.columns if c not in keys]
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    # One pass: rows with a known key fold per key; the others fold only with their own copies, counted
    # per partition so that no count grows with the input, and are repeated afterwards.
    apart = F.when(unknown, F.struct(F.spark_partition_id().alias("_p"), *rest)).alias("_apart")
    first = rows.select(*keys, *rest, apart, *([_at(order).alias("_at")] if rest else [])).groupBy(*keys, "_apart").agg(
        F.count(F.lit(1)).alias("_n"), *[F.min_by(c, "_at").alias(c) for c in rest])
    values = [F.when(unknown, F.col(f"_apart.{c}")).otherwise(F.col(c)).alias(c) if c in rest else F.col(c)
              for c in target.columns]
    return (
        first.join(target.select(*keys), keys, "left_anti")      # a null equals nothing, so it stays
        .select(*values, F.explode(F.sequence(F.lit(1), F.when(unknown, F.col("_n")).otherwise(1))).alias("_copy"))
        .drop("_copy")
    )


def insert_if_absent(target: DataFrame, rows: DataFrame, keys, order=None) -> DataFrame:
    return target.unionByName(absent_rows(target, rows, keys, order))


def latest_documents(docs: DataFrame, doc_id="doc_id", order=("window_start",)) -> DataFrame:
    body = [c for c in docs.columns if c != doc_id and c not in cols(order)]
    return (
        docs.groupBy(doc_id).agg(F.max_by(F.struct(*body), _at(order)).alias("_d"))
        .select(doc_id, *[F.col(f"_d.{c}").alias(c) for c in body])
    )


def index_latest(target: DataFrame, docs: DataFrame, doc_id="doc_id", order=("window_start",)) -> DataFrame:
    """Last write wins per document id; incoming documents replace stored ones.

    One fold over both: a stored document is older than any incoming one, so the incoming rows are worked out once.
    """
    order = cols(order)
    body = [c for c in target.columns if c != doc_id]
    stored = target.select(doc_id, F.lit(False).alias("_new"), *[F.lit(None).cast(docs.schema[o].dataType).alias(f"_o_{o}") for o in order], *body)
    new = docs.select(doc_id, F.lit(True).alias("_new"), *[F.col(o).alias(f"_o_{o}") for o in order], *body)
    latest = stored.unionByName(new).groupBy(doc_id).agg(
        F.max_by(F.struct(*body), F.struct("_new", *[f"_o_{o}" for o in order])).alias("_d"))
    return latest.select(*[F.col(c) if c == doc_id else F.col(f"_d.{c}").alias(c) for c in target.columns])


def fan_rows(changes: DataFrame) -> DataFrame:
    return changes.select(
        F.col("id_fan").alias("device_id"), F.lit(None).cast("string").alias("name"),
        status_flag(F.col("bbc_fan")).alias("status"), F.lit(None).cast("string").alias("location"),
        speed_value(F.col("bbc_control_fan")).alias("speed"), *_order_of(changes),
    )


def lock_rows(changes: DataFrame) -> DataFrame:
    return changes.select(
        F.col("id_door").alias("device_id"), F.lit(None).cast("string").alias("name"),
        status_flag(F.col("bbc_servo")).alias("status"), F.lit(None).cast("string").alias("location"),
        F.col("bbc_password").alias("password"), *_order_of(changes),
    )


def light_rows(changes: DataFrame) -> DataFrame:
    return changes.select(
        F.col("id_led").alias("device_id"), F.lit(None).cast("string").alias("name"),
        status_flag(F.col("bbc_led")).alias("status"), F.lit(None).cast("string").alias("location"),
        *_order_of(changes),
    )


def control_rows(changes: DataFrame, key: str) -> DataFrame:
    """Audit rows of one change stream; control_time is the raw wire string."""
    return changes.select(
        F.col(key).alias("device_id"), F.col("bbc_name").alias("username"),
        F.col("timestamp").alias("control_time"),
    )


def control_events(fan: DataFrame, door: DataFrame, led: DataFrame) -> DataFrame:
    return (
        control_rows(fan, "id_fan")
        .unionByName(control_rows(door, "id_door"))
        .unionByName(control_rows(led, "id_led"))
    )


def _order_of(df):
    return [c for c in ORDER if c in df.columns]
