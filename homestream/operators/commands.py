"""Spoken commands: transcript -> (action, target, speed) -> (feed, payload)."""

from pyspark.sql import DataFrame, functions as F

# The command language (NFC text) and the feeds it drives.
SPEED_WORDS = "tốc độ quạt"
SPEED_PATTERN = r"(?U)tốc độ quạt\s*(\D*)\s*(\d+)"
PHRASES = (
    ("bật quạt", "on", "fan"),
    ("tắt quạt", "off", "fan"),
    ("bật đèn", "on", "light"),
    ("tắt đèn", "off", "light"),
)
FEED_OF = {"fan": "BBC_FAN", "light": "BBC_LED"}
SPEED_FEED = "BBC_CONTROL_FAN"


def _let(value, body):
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def _command(text):
    """struct(action, target, speed) of a transcript, all null when it holds no command."""
    def decide(c):
        speed = F.when((c.n > 0) & (c.n < 100), c.n.cast("int"))
        action, target = F.when(speed.isNotNull(), "set_speed"), F.when(speed.isNotNull(), F.lit(None).cast("string"))
        for phrase, verb, thing in PHRASES:
            heard = c.said.contains(phrase)
            action, target = action.when(heard, verb), target.when(heard, thing)
        return F.struct(action.alias("action"), target.alias("target"), speed.alias("speed"))

    spoken = _let(F.lower(text), lambda said: F.struct(
        said.alias("said"),
        F.when(said.contains(SPEED_WORDS), F.regexp_extract(said, SPEED_PATTERN, 2).try_cast("bigint")).alias("n")))
    return _let(spoken, decide)


def parse_commands(df: DataFrame, text="text") -> DataFrame:
    """Add ``action``, ``target`` and ``speed``; all null when the transcript holds no command.

    A speed outside 1..99 is no speed command, but the phrases may still match.
    """
    return df.withColumn("_c", _command(F.col(text))).select(*df.columns, "_c.action", "_c.target", "_c.speed")


def route_commands(commands: DataFrame) -> DataFrame:
    """Feed and payload of each command; rows without a command are left out.

    The rows are dropped by a generator, not a filter: a filter would be pushed below the parser and
    have every transcript parsed twice.
    """
    def route(c):
        switch = c.action.isin("on", "off")
        feed = F.when(c.action == "set_speed", SPEED_FEED)
        for thing, name in FEED_OF.items():
            feed = feed.when(switch & (c.target == thing), name)
        payload = F.when(c.action == "set_speed", c.speed.cast("string")).when(c.action == "on", "1").otherwise("0")
        return F.struct(feed.alias("feed"), payload.alias("payload"))

    routed = F.filter(F.transform(F.array(F.struct("action", "target", "speed")), route), lambda r: r.feed.isNotNull())
    return commands.select("*", F.inline(routed))
