"""Quality rules by line labelling: a linear-chain conditional random field marks content and boilerplate.

Counting rules come first: a document of fewer than ``MIN_WORDS`` words fails, and one in which over 30 in 100
words lie in windows of ``WINDOW`` words found twice or more. For the others each line with a word is described
by shares of its signs, its words and its repetitions, cut into bins. The field has two states; Viterbi decoding
finds the best sequence of states over all lines of a text, and the document stays if at least half of its words
lie in lines marked as content.

The field is fitted by maximum likelihood (forward and backward sums, numpy) on at most ``SAMPLE`` labelled
documents with at most ``LINES`` lines each. Labels speak of documents, so lines start with the label of their
document; after a first fit, lines that the field firmly holds for the other state change over as long as
their document's majority stands, and the fit is repeated. Without labels of both kinds every line is content.

Null and empty texts have no words and fail. Equal rows get equal results; a line counts as a copy of an earlier
one within its text only. Labels with a null identifier or label don't teach. An empty table gives an empty
result. Columns named like an output are replaced; the others pass through.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.llm.common import folds_of, utf8
from homestream.llm.quality import labelled_sample

MIN_WORDS, WINDOW, REPEATED, CONTENT = 20, 8, 30, 0.5
SAMPLE, LINES, STEPS, ROUNDS, FIRM = 3000, 200, 150, 2, 0.9
#: Bytes of text that are measured side by side.
SLICE = 4_000_000
#: Classes of bytes: white space, continuation bytes, and what the features count.
WHITE, MORE, UPPER, LOWER, DIGIT, SYMBOL, LOUD, POINT, OTHER, HIGH = range(10)
FEATURES = ("words", "length", "symbols", "upper", "loud", "digits", "points", "ends", "copy", "stutter", "repeated", "signs")
BINS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUT = {**{c: T.LongType() for c in COUNTS}, "base_failed": T.BooleanType(), "content_share": T.DoubleType(), "kept": T.BooleanType()}


def _classes():
    import numpy as np
    out = np.full(256, OTHER, np.uint8)
    out[128:192], out[192:] = MORE, HIGH
    for chars, c in ((b" \t\n\x0b\x0c\r", WHITE), (bytes(range(65, 91)), UPPER), (bytes(range(97, 123)), LOWER),
                     (bytes(range(48, 58)), DIGIT), (b"#*$%&|<>", SYMBOL), (b"!?", LOUD), (b".,;:", POINT)):
        out[list(chars)] = c
    return out


def repeated_words(ids, doc):
    """True for each word in a window of WINDOW words that its document holds twice or more.

    Windows are compared by a hash first; those that share one are compared word for word.
    """
    import numpy as np
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
    key = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(WINDOW):
        key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + ids[j:n + j].astype(np.uint64)
    key = key[whole]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    some = np.zeros(len(key), bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    at = whole[some]
    marks = np.zeros(len(ids) + 1, np.int64)
    if len(at):
        rows = np.column_stack([doc[at], *[ids[at + j] for j in range(WINDOW)]])
        _, of, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        at = at[count[of.reshape(-1)] > 1]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + WINDOW, -1)
    return np.cumsum(marks)[:-1] > 0


def measure(texts):
    """(counts per text, document of each line with a word, its words, its features) of UTF-8 texts."""
    import numpy as np
    n = len(texts)
    data = b"".join(t + b"\n" for t in texts)
    raw = np.frombuffer(data, np.uint8)
    kind = _classes()[raw]
    white = kind == WHITE
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    doc = np.repeat(np.arange(n), [t.count(b"\n") + 1 for t in texts]) if n else np.zeros(0, np.int64)

    def each(mask):
        return np.add.reduceat(mask.view(np.uint8), starts, dtype=np.int64) if n else np.zeros(0, np.int64)

    count = {c: each(kind == c) for c in (WHITE, MORE, UPPER, LOWER, DIGIT, SYMBOL, LOUD, POINT, OTHER)}
    size = np.diff(np.concatenate((starts, [len(raw)]))) if n else np.zeros(0, np.int64)
    chars = size - count[WHITE] - count[MORE]
    words = each(~white & np.concatenate(([True], white[:-1]))) if n else np.zeros(0, np.int64)

    found = data.split()
    number = {w: i for i, w in enumerate({*found})}
    ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
    line_of = np.repeat(np.arange(len(words)), words)
    twice = repeated_words(ids, doc[line_of] if len(line_of) else line_of)
    stutter = np.concatenate(([False], (ids[1:] == ids[:-1]) & (line_of[1:] == line_of[:-1])))[:len(ids)]

    lines = data.split(b"\n")[:-1]
    names = {x: i for i, x in enumerate({*lines})}
    key = doc * max(1, len(names)) + np.fromiter(map(names.__getitem__, lines), np.int64, len(lines))
    first = np.zeros(len(lines), bool)
    first[np.unique(key, return_index=True)[1]] = True
    copy = ~first & (words > 0)

    def total(values):
        return np.bincount(doc, values, minlength=n).astype(np.int64)

    per_line = lambda mask: np.bincount(line_of, mask, minlength=len(words))
    again = per_line(twice)
    counts = [total(words), total(chars), total(count[SYMBOL]), total(copy), total(again)]
    some = np.maximum(words, 1)
    last = raw[np.maximum(ends - 1, 0)]
    x = np.column_stack([
        np.log1p(words), chars / some, count[SYMBOL] / some, count[UPPER] / np.maximum(count[UPPER] + count[LOWER], 1),
        count[LOUD] / some, count[DIGIT] / np.maximum(chars, 1), count[POINT] / some, np.isin(last, list(b".!?:\"'")),
        copy, per_line(stutter) / some, again / some, count[OTHER] / some])
    keep = words > 0
    return np.column_stack(counts), doc[keep], words[keep], x[keep]


class Field:
    """Two states, 1 for content. Scores: of state 1 by the bins of a line's features, of steps, and of the start."""

    def __init__(self, edges=None):
        import numpy as np
        self.edges = edges
        self.weights = np.zeros((len(FEATURES), len(BINS) + 1))
        self.step, self.start, self.fitted = np.zeros((2, 2)), np.zeros(2), False

    def binned(self, x):
        import numpy as np
        return np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)])

    def emission(self, bins):
        return sum(self.weights[f, bins[:, f]] for f in range(len(FEATURES)))

    def viterbi(self, x):
        """States of the lines of one text."""
        import numpy as np
        if not self.fitted:
            return np.ones(len(x), np.int8)
        (s00, s01), (s10, s11) = self.step.tolist()
        back = []
        score = self.emission(self.binned(x)).tolist()
        a, b = self.start[0], self.start[1] + score[0]
        for e in score[1:]:
            back.append((b + s10 > a + s00, b + s11 >= a + s01))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + e
        states, now = [int(b >= a)], int(b >= a)
        for came in reversed(back):
            now = int(came[now])
            states.append(now)
        return np.array(states[::-1], np.int8)

    def marginals(self, score, sizes):
        """Probabilities of state 1 and of each pair of states, sequences side by side (longest first, padded)."""
        import numpy as np
        n, width = score.shape
        node = np.zeros((n, width, 2))
        node[:, :, 1] = score
        fore, back = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        fore[:, 0] = self.start + node[:, 0]
        active = [int((sizes > t).sum()) for t in range(width)]
        for t in range(1, width):
            k = active[t]
            fore[:k, t] = np.logaddexp(fore[:k, t - 1, 0, None] + self.step[0], fore[:k, t - 1, 1, None] + self.step[1]) + node[:k, t]
        for t in range(width - 2, -1, -1):
            k = active[t + 1]
            ahead = back[:k, t + 1] + node[:k, t + 1]
            back[:k, t] = np.logaddexp(self.step[:, 0] + ahead[:, 0, None], self.step[:, 1] + ahead[:, 1, None])
        whole = np.logaddexp(*fore[np.arange(n), sizes - 1].T)
        p1 = np.exp(fore[:, :, 1] + back[:, :, 1] - whole[:, None])
        ahead = back[:, 1:] + node[:, 1:]
        pair = np.exp(fore[:, :-1, :, None] + self.step + ahead[:, :, None, :] - whole[:, None, None, None])
        return p1, pair

    def fit(self, sequences, labels):
        """Maximum likelihood by Adam steps; ``sequences``: bins of each text's lines, ``labels``: a state of each line."""
        import numpy as np
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        sizes = np.array([len(sequences[i]) for i in order])
        n, width = len(order), int(sizes[0])
        bins, y = np.zeros((n, width, len(FEATURES)), np.int64), np.zeros((n, width))
        for r, i in enumerate(order):
            bins[r, :sizes[r]], y[r, :sizes[r]] = sequences[i], labels[i]
        real = np.arange(width) < sizes[:, None]
        steps = real[:, 1:]
        flat = bins[real]
        seen = np.array([[(y[:, :-1] == a) & (y[:, 1:] == b) & steps for b in (0, 1)] for a in (0, 1)]).sum((2, 3))
        params = [self.weights, self.step, self.start]
        moment, spread = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for turn in range(1, STEPS + 1):
            score = np.zeros((n, width))
            score[real] = self.emission(flat)
            p1, pair = self.marginals(score, sizes)
            over = (p1 - y)[real]
            grad_w = np.stack([np.bincount(flat[:, f], over, minlength=len(BINS) + 1) for f in range(len(FEATURES))])
            grad_step = (pair * steps[:, :, None, None]).sum((0, 1)) - seen
            grad_start = np.array([(1 - p1[:, 0] - (1 - y[:, 0])).sum(), (p1[:, 0] - y[:, 0]).sum()])
            for k, g in enumerate((grad_w, grad_step, grad_start)):
                g = g / len(over) + 1e-4 * params[k]
                moment[k] = 0.9 * moment[k] + 0.1 * g
                spread[k] = 0.99 * spread[k] + 0.01 * g * g
                params[k] -= 0.1 * (moment[k] / (1 - 0.9 ** turn)) / (np.sqrt(spread[k] / (1 - 0.99 ** turn)) + 1e-8)
        self.fitted = True
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return [p1[back[i], :len(sequences[i])] for i in range(n)]


def settled(p1, words, label):
    """States of a text's lines: its label, but for lines firmly of the other state while its majority stands."""
    import numpy as np
    states = np.full(len(p1), label, np.int8)
    other = p1 < 1 - FIRM if label else p1 > FIRM
    for i in sorted(np.flatnonzero(other), key=lambda i: p1[i] if label else -p1[i]):
        states[i] = 1 - label
        if 2 * words[states == label].sum() <= words.sum():
            states[i] = label
            break
    return states


def learnt(rows) -> Field:
    """The field of (label, words, features) of sampled documents."""
    import numpy as np
    rows = [(int(y), np.asarray(w), np.asarray(x)) for y, w, x in rows if len(w)]
    if len({y for y, _, _ in rows}) < 2:
        return Field()
    every = np.concatenate([x for _, _, x in rows])
    field = Field([np.unique(np.quantile(every[:, f], BINS)) for f in range(len(FEATURES))])
    bins = [field.binned(x) for _, _, x in rows]
    labels = [np.full(len(w), y, np.int8) for y, w, _ in rows]
    for _ in range(ROUNDS):
        p1 = field.fit(bins, labels)
        labels = [settled(p, w, y) for p, (y, w, _) in zip(p1, rows)]
    return field


def fit(df: DataFrame, sample: DataFrame, doc_id="doc_id", text="text") -> Field:
    """The field learnt from the sample's documents: (``_id``, ``_y``), a row of each label.

    What is gathered has at most SAMPLE documents of at most LINES lines; longer ones don't teach.
    """
    import numpy as np

    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids, ys, hs, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), utf8(b.column(3))
            rows = []
            for i, y, h, t in zip(ids, ys, hs, texts):
                if t.count(b"\n") >= LINES:
                    continue
                _, _, words, x = measure([t])
                rows.append((i, y, h, words.tolist(), x.reshape(-1).tolist()))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())))],
                ["id", "y", "h", "words", "x"])

    rows = (df.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
            .join(F.broadcast(sample), F.col("_doc") == F.col("_id"))      # at most SAMPLE narrow rows
            .select("_doc", "_y", F.xxhash64("_text").alias("_h"), "_text")
            .mapInArrow(run, "id bigint, y double, h bigint, words array<bigint>, x array<double>")
            # repeated identifiers may bring more rows than the sample has
            .orderBy(F.xxhash64("id"), "id", "h", "y").limit(SAMPLE).collect())
    return learnt([(r.y, r.words, np.array(r.x).reshape(-1, len(FEATURES))) for r in rows])


def judge(df: DataFrame, field: Field, text="text", keep=None, states=False) -> DataFrame:
    """Adds the counts, base_failed, content_share (of words) and kept; ``states`` adds an array of True for content
    and False for boilerplate, one for each line with a word."""
    more = {"line_content": T.ArrayType(T.BooleanType())} if states else {}
    names = [c for c in (keep or df.columns) if c not in OUT and c not in more]
    shared = df.sparkSession.sparkContext.broadcast(field)
    rows = df.select(*names, F.col(text).cast("string").alias("_rule_text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        field = shared.value
        for b in batches:
            texts = utf8(b.column(len(names)))
            part = np.cumsum([0, *map(len, texts)])[:-1] // SLICE
            for s in np.unique(part):
                pick = np.flatnonzero(part == s)
                counts, doc, words, x = measure([texts[i] for i in pick])
                cut = np.searchsorted(doc, np.arange(len(pick) + 1))
                share, marked = np.zeros(len(pick)), []
                for i, (lo, hi) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
                    found = field.viterbi(x[lo:hi]) if hi > lo else np.zeros(0, np.int8)
                    if hi > lo:
                        share[i] = words[lo:hi][found == 1].sum() / words[lo:hi].sum()
                    if states:
                        marked.append(found.astype(bool).tolist())
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEATED * counts[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(int(pick[0]), len(pick)).columns[:-1], *[pa.array(c) for c in counts.T], pa.array(failed),
                     pa.array(share), pa.array(~failed & (share >= CONTENT)), *([pa.array(marked, pa.list_(pa.bool_()))] if states else [])],
                    [*names, *OUT, *more])

    fields = [T.StructField(n, t) for n, t in (OUT | more).items()]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *fields]))


def apply_rules(df: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", keep=None, folds=3, held=1, states=False) -> DataFrame:
    """Fit on labels outside the held-out fold (crc32 of the identifier, modulo) and judge every row."""
    sample = labelled_sample(labels, fold=lambda i: folds_of("_id", folds) != held, size=SAMPLE)
    return judge(df, fit(df, sample, doc_id, text), text, keep, states)
