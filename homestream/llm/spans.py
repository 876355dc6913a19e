"""Match positions by built-in functions: no Python touches a text.

``regexp_extract_all`` gives the matches and ``split`` with the same pattern the gaps between them. The
sum of the lengths before a match is its position, and the gaps around a match are its context. Lengths are
code points. Patterns use possessive quantifiers: Java runs these without recursion, so a very long match
can't exhaust the stack.
"""

from pyspark.sql import Column, DataFrame, functions as F

#: Code points of context kept on either side of a match.
AROUND = 48


def with_matches(df: DataFrame, text: Column, rules: dict, prefix="_m_", group=None) -> DataFrame:
    """Per rule, the matches and gaps of its pattern. ``rules``: kind -> (pattern, cheap condition).

    The texts that fail the condition are never searched. ``group`` names, per kind, a group to extract
    beside the whole match.
    """
    none = F.expr("cast(array() as array<string>)")
    out = df.withColumns({
        f"{prefix}{k}": F.when(cond, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none)
        for k, (p, cond) in rules.items()})
    for k, (p, _) in rules.items():
        some = F.size(f"{prefix}{k}") > 0
        extra = {f"{prefix}gap_{k}": F.when(some, F.split(text, p, -1)).otherwise(none)}
        if group and k in group:
            extra[f"{prefix}part_{k}"] = F.when(
                some, F.regexp_extract_all(text, F.lit(p), F.lit(group[k]))).otherwise(none)
        out = out.withColumns(extra)
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: an expression used inside a lambda would be anew for each element."""
    return F.transform(F.array(value), body)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def sums_before(numbers: Column, levels=3) -> Column:
    """Per element of an array, the sum of those before it.

    A fold that gathers an array copies it at every step. So the array is cut into blocks, the blocks into blocks, and
    only the smallest ones are summed from their start for each element: n elements cost ``levels`` * n ** (1 + 1 / levels)
    additions.
    """
    if levels == 1:
        return F.transform(numbers, lambda x, i: _sum(F.slice(numbers, F.lit(1), i)))

    def cut(array):
        size = F.greatest(F.ceil(F.pow(F.size(array), F.lit((levels - 1) / levels))).cast("int"), F.lit(1))
        count = F.ceil(F.size(array) / size).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda b: F.slice(array, b * size + 1, size))
        return _let(blocks, lambda all_: _let(
            _let(F.transform(all_, _sum), lambda sums: sums_before(sums, 1)),
            lambda starts: F.flatten(F.transform(all_, lambda block, b: F.transform(
                sums_before(block, levels - 1), lambda x: x + F.get(starts, b))))))

    return _let(numbers, cut)


def spans_of(kind: str, order: int, valid, prefix="_m_", part=False) -> Column:
    """The matches of a kind that pass ``valid(value, part, context)``, with positions, in text order.

    A match starts after all gaps and matches before it and its own gap; one that fails only moves the others on.
    """
    m, gap = F.col(f"{prefix}{kind}"), F.col(f"{prefix}gap_{kind}")
    zipped = F.arrays_zip(
        m.alias("m"), gap.alias("g"), F.slice(gap, 2, F.greatest(F.size(m), F.lit(1))).alias("a"),
        (F.col(f"{prefix}part_{kind}") if part else m).alias("p"))
    names = ["m", "g", "a", "p"]
    zipped = F.transform(zipped, lambda z: F.struct(*[z[n].alias(n) for n in names]))
    # the last gap has no match of its own
    zipped = F.filter(zipped, lambda z: z["m"].isNotNull())

    def span(z, before):
        start = before + F.char_length(z["g"])
        context = F.concat(F.right(z["g"], F.lit(AROUND)), F.lit(" "), F.left(z["a"], F.lit(AROUND)))
        return F.struct(
            start.alias("start"), F.lit(order).alias("ord"), (start + F.char_length(z["m"])).alias("end"), F.lit(kind).alias("kind"),
            z["m"].alias("value"), z["p"].alias("part"), context.alias("context"))

    def found(matches):
        lengths = F.transform(matches, lambda z: (F.char_length(z["g"]) + F.char_length(z["m"])).cast("long"))
        return _let(sums_before(lengths), lambda before: F.transform(matches, lambda z, i: span(z, F.get(before, i))))

    return F.filter(_let(zipped, found), lambda s: valid(s["value"], s["part"], s["context"]))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined, in the order of the array."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
