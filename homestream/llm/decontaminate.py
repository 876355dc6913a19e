"""Benchmark decontamination by training suffix arrays.

Documents are shards: a task takes the words of about ``SHARD`` bytes of text as one array of numbers, sorts its
suffixes by their first ``WINDOW`` words, and searches every suffix of the benchmark in it by bisection, all of them
side by side in numpy. The range found holds all locations of a window, whole items for those shorter than ``WINDOW``.
Only suffixes that start like a benchmark suffix (first two words, or the first word of a one-word item) are sorted:
no other can be found. Documents never leave their partition and are read once.

From each location at which a match can begin, the longest verbatim match with any item follows: the benchmark's own
suffix array gives, as a range, the suffixes that agree so far; ``WINDOW`` words at a time the range is narrowed by
bisection to those that go on like the document, and when none does, the neighbours of the document's words in the
last range share most of them. Where every occurrence of a window in the benchmark follows the window found one word
earlier, no match begins.

The benchmark is packed by a Spark job into blocks of about ``BLOCK`` bytes of text (or one longer item): its words
numbered, its suffixes sorted, a row each in the shared folder. The driver hands on one row after the other, each its
own broadcast, and holds no other; a task goes through the blocks one after the other for each shard and holds one.

Null and empty documents have no words and are never hit. Items without words find nothing. Repeated item
rows count once; a null item_id is named by the empty string. Copies of a document are each reported. Columns pass
through unless named like an output. An empty benchmark hits nothing; an empty table gives an empty result.
"""

import pickle

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.llm.common import utf8, written

WINDOW, SHARD, BLOCK = 10, 8_000_000, 4_000_000
#: A-Z lower-cased; every ASCII character but letters and digits separates words.
TABLE = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
MATCH = T.StructType([T.StructField("item", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("item_at", "doc_at", "words")]])
OUT = {"n_words": T.LongType(), "n_hit": T.LongType(), "longest": T.LongType(),
       "items": T.ArrayType(T.StringType()), "matches": T.ArrayType(MATCH)}


class _Zero(dict):
    def __missing__(self, key):
        return 0


def suffix_array(words):
    """Starts of all suffixes of an array of numbers in order; a suffix that ends comes first."""
    import numpy as np
    n, step = len(words), 1
    rank = np.unique(words, return_inverse=True)[1].reshape(-1) + 1
    while True:
        key = rank * (n + 2) + np.concatenate((rank[step:], np.zeros(min(step, n), np.int64)))[:n]
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], key[order[1:]] != key[order[:-1]])))
        if not n or rank[order[-1]] == n:
            return order
        step *= 2


class Suffixes:
    """The test suffixes of a block. Windows are numbered in the order of the suffix array, then the short items.

    ``low`` and ``high`` bound a window's place among suffixes cut to ``window`` words, two word numbers to a 64-bit
    column; a window shorter than that is a range of columns.
    """

    def __init__(self, items, window=WINDOW):
        import numpy as np
        self.window = window
        self.number = _Zero()
        texts = [(name, [self.number.setdefault(w, len(self.number) + 1) for w in text.translate(TABLE).split()])
                 for name, text in sorted({*items})]
        self.names = np.array(sorted({name for name, _ in texts}), object)
        at = {name: i for i, name in enumerate(self.names)}
        long = [(at[name], w) for name, w in texts if len(w) >= window]
        # texts one after the other, each ended by -1, and room to look ahead
        body = [x for _, w in long for x in (*w, -1)]
        self.body = np.array(body + [-1] * 2 * window, np.int64)
        sizes = np.array([len(w) for _, w in long], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        order = suffix_array(self.body[:len(body)])
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        of = np.repeat(np.arange(len(long)), sizes + 1)
        ends = begin + sizes
        # suffixes of at least a window, sorted; the item and the place of each
        self.suffix = order[ends[of[order]] - order >= window] if len(long) else order
        self.item = np.array([name for name, _ in long], np.int64)[of[self.suffix]]
        self.place = self.suffix - begin[of[self.suffix]]
        rows = self.body[self.suffix[:, None] + np.arange(window)]
        new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))[:len(rows)]
        self.first = np.append(np.flatnonzero(new), len(rows))     # a window's range of suffixes
        wide, top = window + window % 2, (1 << 31) - 1
        full = rows[new]

        brief = {}
        for name, w in texts:
            if 0 < len(w) < window:
                brief.setdefault(tuple(w), set()).add(at[name])
        short = list(brief)
        self.sizes = np.array([window] * len(full) + [len(w) for w in short], np.int64)
        low, high = np.zeros((len(self.sizes), wide), np.int64), np.full((len(self.sizes), wide), top, np.int64)
        low[:len(full), :window] = high[:len(full), :window] = full
        for i, w in enumerate(short, len(full)):
            low[i, :len(w)] = high[i, :len(w)] = w
        self.low, self.high = _packed(low), _packed(high)
        self.pairs = np.unique(np.concatenate((full[:, 0] << 31 | full[:, 1] if window > 1 else full[:, 0][:0],
                                               np.array([w[0] << 31 | w[1] for w in short if len(w) > 1], np.int64))))
        self.ones = np.unique(np.array([w[0] for w in short if len(w) == 1] + (full[:, 0].tolist() if window == 1 else []), np.int64))

        # the items that hold a window: those of its suffixes, each once
        window_of = np.cumsum(new) - 1
        held = np.unique(window_of * max(1, len(self.names)) + self.item)
        which = held // max(1, len(self.names))
        more = [(i, n) for i, w in enumerate(short, len(full)) for n in sorted(brief[w])]
        self.of = np.concatenate((held % max(1, len(self.names)), np.array([n for _, n in more], np.int64)))
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(
            np.concatenate((which, np.array([i for i, _ in more], np.int64))), minlength=len(self.sizes)))))
        # the one window that precedes all occurrences of a window, else -1
        by_place = np.full(len(self.body), -1, np.int64)
        by_place[self.suffix] = window_of
        came = by_place[np.maximum(self.suffix - 1, 0)]
        came[self.place == 0] = -1
        lowest, highest = (f.reduceat(came, self.first[:-1]) if len(full) else came for f in (np.minimum, np.maximum))
        self.after = np.where(lowest == highest, lowest, -1)

    def packed(self) -> bytes:
        """Plain arrays and a plain dictionary, which any worker can read."""
        return pickle.dumps(vars(self) | {"number": dict(self.number)}, 5)

    @classmethod
    def unpacked(cls, data):
        self = cls.__new__(cls)
        vars(self).update(pickle.loads(data))
        self.number = _Zero(self.number)
        return self


def _packed(rows):
    return rows[:, 0::2] << 31 | rows[:, 1::2]


def _isin(values, table):
    import numpy as np
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _bisected(lo, hi, below):
    """Per range [lo, hi), its first place that isn't ``below(rows, places)``."""
    import numpy as np
    lo, hi = lo.copy(), hi.copy()
    while len(rows := np.flatnonzero(lo < hi)):
        mid = (lo[rows] + hi[rows]) // 2
        less = below(rows, mid)
        lo[rows[less]], hi[rows[~less]] = mid[less] + 1, mid[~less]
    return lo


def _before(x, y, also=False):
    """Per row, whether x comes before y in the order of their columns; ``also``: or equals it."""
    import numpy as np
    differ = x != y
    first, rows = differ.argmax(1), np.arange(len(x))
    return (x[rows, first] < y[rows, first]) | (~differ.any(1) & also)


def _bisect(columns, rows, right):
    """Per row, how many sorted suffixes are below it (``right``: not above it)."""
    import numpy as np
    return _bisected(np.zeros(len(rows), np.int64), np.full(len(rows), len(columns), np.int64),
                     lambda r, mid: _before(columns[mid], rows[r], right))


def _spread(lo, hi):
    """The numbers of all ranges [lo, hi), and the range of each."""
    import numpy as np
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


def extended(test: Suffixes, a, window_at, start):
    """Per place in ``start``, the longest match with any suffix: (rank of the suffix, words).

    ``a``: the documents' words with room behind them; ``window_at``: the full window found at each place, or -1.
    """
    import numpy as np
    w, depth = test.window, test.window
    lo, hi = test.first[window_at[start]], test.first[window_at[start] + 1]
    best, words = lo.copy(), np.full(len(start), depth, np.int64)
    active = np.arange(len(start))
    while len(active):
        l, h, p = lo[active], hi[active], start[active] + depth
        go = window_at[p]
        # those that go on with the same window again: their rest lies between its first and last suffix
        on = np.flatnonzero(go >= 0)
        l2, h2 = l.copy(), l.copy()
        if len(on):
            bottom, top = (test.rank[test.suffix[x]] for x in (test.first[go[on]], test.first[go[on] + 1] - 1))
            rest = lambda at: test.rank[test.suffix[at] + depth]
            l2[on] = _bisected(l[on], h[on], lambda r, mid: rest(mid) < bottom[r])
            h2[on] = _bisected(l[on], h[on], lambda r, mid: rest(mid) <= top[r])
        end = np.flatnonzero(h2 <= l2)
        if len(end):
            # the neighbours of the document's words share most of them
            mine = a[p[end][:, None] + np.arange(w)]
            theirs = lambda at: test.body[test.suffix[at][:, None] + depth + np.arange(w)]
            at = _bisected(l[end], h[end], lambda r, mid: _before(theirs(mid), mine[r]))
            share = lambda k: np.cumprod(theirs(k) == mine, axis=1).sum(1)
            left, right = np.maximum(at - 1, l[end]), np.minimum(at, h[end] - 1)
            n_left, n_right = share(left), share(right)
            best[active[end]] = np.where(n_left >= n_right, left, right)
            words[active[end]] = depth + np.maximum(n_left, n_right)
        on = np.flatnonzero(h2 > l2)
        lo[active[on]], hi[active[on]] = l2[on], h2[on]
        active = active[on]
        depth += w
    return best, words


def search(test: Suffixes, texts):
    """Per text: number of words, bool array of hit words, names of the items found, matches (item's name, word in it,
    word in the text, length)."""
    import numpy as np
    words = b" | ".join(t.translate(TABLE) for t in [*texts, b""]).split()   # a bar between documents, none in a word
    a = np.fromiter(map(test.number.__getitem__, words), np.int64, len(words))
    bars = np.flatnonzero(np.fromiter((w == b"|" for w in words), bool, len(words))) if len(texts) else np.zeros(0, np.int64)
    del words
    n, w = len(a), test.window
    a = np.concatenate((a, np.zeros(2 * w + 2, np.int64)))
    start = np.flatnonzero(a[:n])
    start = start[_isin(a[start] << 31 | a[start + 1], test.pairs) | _isin(a[start], test.ones)]
    marks = np.zeros(n + 1, np.int64)
    doc = item = m_doc = np.zeros(0, np.int64)
    matches = [np.zeros(0, np.int64)] * 4
    if len(start):
        suffix = _packed(a[start[:, None] + np.arange(w + w % 2)])
        if w % 2:
            suffix[:, -1] &= ~((1 << 31) - 1)
        order = np.lexsort(suffix.T[::-1])
        start, suffix = start[order], suffix[order]
        lo, hi = _bisect(suffix, test.low, False), _bisect(suffix, test.high, True)
        rank, of = _spread(lo, np.maximum(lo, hi))
        at = start[rank]
        marks += np.bincount(at, minlength=n + 1) - np.bincount(at + test.sizes[of], minlength=n + 1)
        which_doc = np.searchsorted(bars, at)
        pair = np.unique(which_doc * len(test.sizes) + of)
        doc, found = pair // max(len(test.sizes), 1), pair % max(len(test.sizes), 1)
        which, back = _spread(test.ends[found], test.ends[found + 1])
        pair = np.unique(doc[back] * len(test.names) + test.of[which])
        doc, item = pair // max(len(test.names), 1), pair % max(len(test.names), 1)

        # matches: short items are whole, the others are followed from where one can begin
        full = test.sizes[of] == w
        window_at = np.full(n + 2 * w + 2, -1, np.int64)
        window_at[at[full]] = of[full]
        places = np.flatnonzero(window_at >= 0)
        earlier = np.where(places > 0, window_at[places - 1], -1)
        after = test.after[window_at[places]]
        places = places[(after < 0) | (after != earlier)]
        best, length = extended(test, a, window_at, places)
        brief = np.flatnonzero(~full)
        m_at = np.concatenate((places, at[brief]))
        matches = [np.concatenate(x) for x in (
            (test.item[best], test.of[test.ends[of[brief]]]), (test.place[best], np.zeros(len(brief), np.int64)),
            (places, at[brief]), (length, test.sizes[of[brief]]))]
        m_doc = np.searchsorted(bars, m_at)
        order = np.lexsort((matches[3], m_at))
        matches, m_doc = [x[order] for x in matches], m_doc[order]
    hit = np.cumsum(marks)[:n] > 0
    found, begin = [], 0
    cut, m_cut = (np.searchsorted(x, np.arange(len(texts) + 1)) for x in (doc, m_doc))
    for i, end in enumerate(bars.tolist()):
        mine = slice(m_cut[i], m_cut[i + 1])
        found.append((end - begin, hit[begin:end], test.names[item[cut[i]:cut[i + 1]]].tolist(), [*zip(
            test.names[matches[0][mine]].tolist(), matches[1][mine].tolist(), (matches[2][mine] - begin).tolist(), matches[3][mine].tolist())]))
        begin = end + 1
    return found


def blocks_of(benchmark: DataFrame, item_id="item_id", text="text", size=BLOCK, window=WINDOW) -> DataFrame:
    """(block, data): the packed test suffixes of blocks of about ``size`` bytes, written to the shared folder."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                             F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "utf-8").alias("data")).distinct()
    total = items.agg(F.sum(F.octet_length("data"))).first()[0] or 0

    def pack(rows):
        import pyarrow as pa
        test = Suffixes([*zip(rows.column("item").to_pylist(), rows.column("data").to_pylist())], window)
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "data": pa.array([test.packed()], pa.binary())})

    block = F.pmod(F.xxhash64("item", "data"), F.lit(max(1, -(-total // size)))).alias("block")
    return written(items.select(block, "item", "data").groupBy("block").applyInArrow(pack, "block bigint, data binary"), "benchmark-blocks")


def _loaded(blocks):
    """The blocks one after the other; where there are several, a worker keeps none of them."""
    for b in blocks:
        yield Suffixes.unpacked(b.value)
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)


def find_leaks(df: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text", keep=None,
               window=WINDOW, block=BLOCK) -> DataFrame:
    """Adds n_words, n_hit (words inside a found window), items, matches (the longest verbatim match from each word where
    one can begin: item, item_at, doc_at, words) and longest (the longest of them, in words)."""
    context = df.sparkSession.sparkContext
    names = [c for c in (keep or df.columns) if c not in OUT and c != "_text"]
    blocks = [context.broadcast(bytes(row.data)) for row in blocks_of(benchmark, item_id, item_text, block, window).toLocalIterator()]
    blocks = blocks or [context.broadcast(Suffixes([], window).packed())]
    rows = df.select(*names, F.col(text).cast("string").alias("_text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        tests = [*_loaded(blocks)] if len(blocks) == 1 else None
        for b in batches:
            texts = utf8(b.column(len(names)))
            part = np.cumsum([0, *map(len, texts)])[:-1] // SHARD
            for s in np.unique(part):
                pick = np.flatnonzero(part == s)
                shard, all_ = [texts[i] for i in pick], [None] * len(pick)
                for test in tests or _loaded(blocks):
                    for i, (n, hit, items, matches) in enumerate(search(test, shard)):
                        was = all_[i] or (n, np.zeros(n, bool), [], [])
                        all_[i] = n, was[1] | hit if hit.any() else was[1], was[2] + items, was[3] + matches
                made = [[n for n, *_ in all_], [int(h.sum()) for _, h, *_ in all_], [max((x[3] for x in m), default=0) for *_, m in all_],
                        [sorted({*i}) for _, _, i, _ in all_], [[dict(zip(MATCH.names, x)) for x in sorted(m, key=lambda x: x[2:])] for *_, m in all_]]
                kinds = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.list_(pa.struct([(f, pa.string() if f == "item" else pa.int64()) for f in MATCH.names]))]
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(int(pick[0]), len(pick)).columns[:-1], *[pa.array(v, t) for v, t in zip(made, kinds)]], [*names, *OUT])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, t) for n, t in OUT.items()]]))


def decontaminate(df: DataFrame, benchmark: DataFrame, text="text", **options) -> DataFrame:
    """The rows of ``df`` without a benchmark window, all columns."""
    names = df.columns
    inner = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    found = find_leaks(inner, benchmark, f"_c{names.index(text)}", **options).filter(F.col("n_hit") == 0)
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def digest(found: DataFrame, doc_id="doc_id") -> DataFrame:
    ids = F.array_join(F.array_sort(F.array_distinct("items")), ",")
    return found.select(
        doc_id, "n_words", "n_hit", F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")
