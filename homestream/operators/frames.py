"""Frame streams: sampling, boxes, labels, confirmation of a repeated name, carried results."""

from pyspark.sql import DataFrame, functions as F

from homestream.operators.timeline import (
    CHUNK, DEFAULT_ROWS, carry_forward as _carry_forward, cols, known_keys, last_known, spec, upto, with_chunk,
)

# Recognition settings.
UNKNOWN = "Unknown"
MIN_CONFIDENCE = 0.5
CONFIRMATIONS = 7
FRAME_SKIP = 2
BOX_FACTOR = 2


def sample_frames(df: DataFrame, every=FRAME_SKIP, frame="frame_no") -> DataFrame:
    """The recogniser looks at every n-th frame only, counted from 0."""
    return df.filter(F.col(frame) % every == 0)


def rescale_boxes(df: DataFrame, factor=BOX_FACTOR) -> DataFrame:
    """Bring boxes found on the shrunken frame back to full size, as (left, top, right, bottom)."""
    sides = ("left", "top", "right", "bottom")
    rest = [c for c in df.columns if c not in sides]
    return df.select(*rest, *[(F.col(s) * factor).alias(s) for s in sides])


def label_text(df: DataFrame, out="label") -> DataFrame:
    """Overlay text 'name (0.00)'. DecimalFormat rounds the exact binary value, printf of the JVM does not."""
    shown = F.call_function("format_number", F.col("confidence").cast("double"), F.lit("0.00"))
    return df.withColumn(out, F.concat(F.col("name"), F.lit(" ("), shown, F.lit(")")))


def confident_only(df: DataFrame, min_confidence=MIN_CONFIDENCE, unknown=UNKNOWN) -> DataFrame:
    """Named rows strictly above the threshold."""
    return df.filter((F.col("name") != unknown) & (F.col("confidence") > min_confidence))


def carry_forward(df: DataFrame, session, order, values, chunk=DEFAULT_ROWS, state: DataFrame = None) -> DataFrame:
    """Frames that were not looked at show the last result of their session; ``state``: results from before."""
    return _carry_forward(df, session, order, values, chunk, state)


def confirm_runs(df: DataFrame, session="session", order=("frame_no",), n=CONFIRMATIONS,
                 min_confidence=MIN_CONFIDENCE, unknown=UNKNOWN, chunk=DEFAULT_ROWS) -> DataFrame:
    """First frame per session at which the same name was confidently seen n times in a row.

    Unknown and unsure frames neither count nor break a run. One row per confirmed session.
    """
    return confirm_step(df, session, order, n, min_confidence, unknown, chunk)[0]


def confirm_step(df: DataFrame, session="session", order=("frame_no",), n=CONFIRMATIONS, min_confidence=MIN_CONFIDENCE,
                 unknown=UNKNOWN, chunk=DEFAULT_ROWS, state: DataFrame = None):
    """(:func:`confirm_runs`, the name and run length that each session ends on), from the same in ``state``: session
    columns, name and length."""
    session, order = cols(session), cols(order)
    rows = with_chunk(known_keys(confident_only(df, min_confidence, unknown), session), order, chunk)
    rows = rows.select(*session, *order, "name", CHUNK)
    w = spec([*session, CHUNK], order)
    now = upto(w)
    local = (
        rows.withColumn("_prev", F.lag("name").over(w))
        .withColumn("_opens", F.col("_prev").isNull() | (F.col("_prev") != F.col("name")))
        .withColumn("_rn", F.row_number().over(w))
        .withColumns({
            "_run": F.sum(F.when(F.col("_prev").isNotNull() & F.col("_opens"), 1).otherwise(0)).over(now),
            "_len": F.col("_rn") - last_known(F.when(F.col("_opens"), F.col("_rn")), now) + 1,
            "_tail": F.lead(F.lit(1)).over(w).isNull(),
        })
    )
    # carry: which name the earlier chunks ended on, and how long that run already is
    ws = spec(session, CHUNK)
    last_name = F.lag("name").over(ws)
    tails = (
        _with_seed(local.filter("_tail").select(*session, CHUNK, "name", "_run", F.col("_len").cast("long").alias("_len")), session, state)
        .withColumn("_new", (F.col("_run") > 0) | last_name.isNull() | (last_name != F.col("name")))
        .withColumn("_total", F.sum("_len").over(upto(ws)))
        .withColumn("_base", last_known(F.when(F.col("_new"), F.col("_total") - F.col("_len")), upto(ws)))
    )
    carry = tails.select(
        *session, CHUNK, last_name.alias("_in_name"),
        F.lag(F.col("_total") - F.col("_base")).over(ws).alias("_in_len"),
    ).filter(F.col("_in_name").isNotNull())
    goes_on = (F.col("_run") == 0) & F.coalesce(F.col("_in_name") == F.col("name"), F.lit(False))
    reached = (
        local.join(carry, [*session, CHUNK], "left")
        .withColumn("_count", F.col("_len") + F.when(goes_on, F.col("_in_len")).otherwise(0))
        .filter(F.col("_count") == n)
    )
    last = F.max_by(F.struct("name", (F.col("_total") - F.col("_base")).alias("length")), F.struct(F.col(CHUNK).isNotNull(), CHUNK))
    after = tails.groupBy(*session).agg(last.alias("_t")).select(*session, "_t.name", "_t.length")
    return (
        reached.groupBy(*session).agg(F.min(F.struct(*order, "name")).alias("_t"))
        .select(*session, *[F.col(f"_t.{c}").alias(c) for c in [*order, "name"]])
    ), after


def _with_seed(tails: DataFrame, session, state):
    """The state of a session as the run of a chunk without number, which comes before all others."""
    if state is None:
        return tails
    return tails.unionByName(state.select(
        *session, F.lit(None).cast("long").alias(CHUNK), "name", F.lit(0).cast("long").alias("_run"), F.col("length").alias("_len")))


def trigger_messages(triggers: DataFrame, session="session", unknown=UNKNOWN) -> DataFrame:
    """Each trigger sends the name and then resets the feed."""
    steps = F.explode(F.array(
        F.struct(F.lit(1).alias("step"), F.col("name").alias("payload")),
        F.struct(F.lit(2).alias("step"), F.lit(unknown).alias("payload")),
    ))
    return triggers.select(*cols(session), steps.alias("m")).select(*cols(session), "m.step", "m.payload")


def detection_outcome(sessions: DataFrame, triggers: DataFrame, session="session", unknown=UNKNOWN) -> DataFrame:
    """What a detection session answers: the confirmed name, or Unknown when it never was."""
    key = cols(session)
    return (
        sessions.select(*key).distinct()
        .join(triggers.select(*key, "name"), key, "left")
        .select(*key, F.coalesce("name", F.lit(unknown)).alias("name"))
    )
