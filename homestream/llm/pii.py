"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Main path: built-in functions only. Base kinds (email, ip, card, phone) stay whatever their score; the
kinds added by the method (iban, confirmed by mod 97, and ssn, proposed by its shape alone) stay only with
a score of ``ACCEPT`` or more, so a bare ssn-shaped number needs a word such as "social security" nearby.

Null and empty texts have no spans. Equal rows give equal results; every other column passes through.
An empty table gives an empty table. A column named like ``out`` is replaced.
"""

from pyspark.sql import Column, DataFrame, functions as F

from homestream.llm.common import text_of
from homestream.llm.spans import count_of, joined, spans_of, with_matches

#: Kinds in the order of their listing, base kinds first.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")

#: Possessive, and started only where a run of the leading class starts or the last match ended (\G): the
#: same leftmost matches as the plain forms in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
#: Words that speak for a kind, lower case.
CONTEXT = {
    "email": r"mail|contact|write|reach|address",
    "ip": r"\bip\b|address|host|server|client",
    "card": r"card|credit|visa|master|payment|pay",
    "phone": r"phone|call|tel|mobile|fax|contact",
    "iban": r"iban|account|bank|transfer",
    "ssn": r"ssn|social|security|insurance",
}
#: Score by shape, by a confirmed checksum, and for context; a span of an added kind needs ACCEPT.
SHAPE = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.3}
CONFIRMED = {"email": 0.0, "ip": 0.0, "card": 0.4, "phone": 0.0, "iban": 0.4, "ssn": 0.0}
NEARBY, ACCEPT = 0.2, 0.5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn check of a string of digits: every second digit from the right counts doubled, less 9 above 9."""
    chars = F.split(F.reverse(number), "")
    terms = F.transform(chars, lambda c, i: F.when(
        i % 2 == 1, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def mod97(value: Column) -> Column:
    """ISO 7064 mod 97-10: first four characters to the end, letters as 10 to 35, remainder 1."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4)), "")

    def step(rest, c):
        letter = F.ascii(c) >= 65
        return F.when(letter, (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + c.cast("int")) % 97)

    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind):
    def small(value):
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(
            r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))

    def nearby(context):
        return F.lower(context).rlike(CONTEXT[kind])

    return {
        "email": lambda v, p, c: F.lit(True),
        "ip": lambda v, p, c: small(v),
        "card": lambda v, p, c: F.when(F.length(digits(v)).between(14, 19), luhn(digits(v))).otherwise(False),
        "phone": lambda v, p, c: F.length(digits(v)).between(10, 15),
        "iban": lambda v, p, c: mod97(v),
        "ssn": lambda v, p, c: nearby(c),
    }[kind]


def _score(s: Column) -> Column:
    def pick(values):
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), s["kind"])

    near = F.lit(False)
    for kind, words in CONTEXT.items():
        near = near | ((s["kind"] == kind) & F.lower(s["context"]).rlike(words))
    return F.least(F.lit(1.0), pick(SHAPE) + pick(CONFIRMED) + F.when(near, NEARBY).otherwise(0.0))


def find_pii(df: DataFrame, text="text", out="pii", keep=None) -> DataFrame:
    """Adds ``out``: array of (start, ord, end, kind, value, score) by start, then kind; ends are exclusive.

    ``keep`` limits the other columns that pass through (all by default).
    """
    names = [c for c in (keep or df.columns) if c != out]
    t = F.col("_pii_text")
    digit = t.rlike("[0-9]")
    rules = {
        "email": (PATTERNS["email"], t.contains("@")),
        "ip": (PATTERNS["ip"], digit & t.contains(".")),
        "card": (PATTERNS["card"], t.rlike("[0-9](?:[ -]?[0-9]){13}")),
        "phone": (PATTERNS["phone"], t.rlike(r"\+[0-9]")),
        "iban": (PATTERNS["iban"], t.rlike("[A-Z]{2}[0-9]{2}")),
        "ssn": (PATTERNS["ssn"], t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    }
    base = df.select(*names, text_of(text).alias("_pii_text"))
    found = with_matches(base, t, rules, "_pii_").select(*names, F.concat(*[
        spans_of(k, i, _valid(k), "_pii_") for i, k in enumerate((*BASE, *ADDED))]).alias("_pii_all"))
    scored = F.transform(F.array_sort("_pii_all"), lambda s: F.struct(
        s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["value"].alias("value"), _score(s).alias("score")))
    return found.select(*names, F.filter(
        scored, lambda s: (s["ord"] < len(BASE)) | (s["score"] >= ACCEPT)).alias(out))


def digest(df: DataFrame, doc_id="doc_id", pii="pii") -> DataFrame:
    """One row per document: counts, hash of the base spans, all spans."""
    spans = F.col(pii)
    base = F.filter(spans, lambda s: s["ord"] < len(BASE))
    return df.select(
        doc_id, *[count_of(spans, k).alias(f"n_{k}") for k in (*BASE, *ADDED)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))
