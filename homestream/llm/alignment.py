"""Alignment of two tokenizers by merge-path partitioning.

Tokenizer A sees a space and the text, tokenizer B the text (it adds the space itself), so both cut the same bytes.
Their ascending token ends are merged: where both end, a group ends; between two neighbouring ends lies one pair of
tokens that overlap, a link. The merge of a task's documents is cut by diagonals: the i-th diagonal is the line on
which i * ``PIECE`` ends of A and B together have been passed, and a binary search on it finds how many of them are
A's. So each piece has the same work whatever the documents' lengths, knows where it starts in both lists, and emits
its links and the groups it ends without the others. A group that began in an earlier piece is stitched together from
the group ends of all pieces in order.

Counts over the corpus: documents are taken in chunks of about ``CHUNK`` bytes (or one longer document). A chunk is
written as one row: its documents' results, its distinct id pairs with the number of its documents that hold them,
and for each document the pairs it holds. Only (chunk, pair) rows are shuffled to count pairs, and again to bring the
counts back to their chunk; a frequent pair costs a row for each chunk, not for each link. The highest count of each
id of A is a table bounded by A's vocabulary.

Texts that are null or empty, or whose joined token bytes differ from a space and the text (B decodes U+2581 as a
space), have no tokens: zeros and an empty string. Rows that repeat an identifier, null included, are documents of
their own and count as such. Other columns aren't read. An empty table gives an empty result.
"""

from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.llm.bytebpe import LONGEST, REMEMBERED, plain, words_of
from homestream.llm.common import shared_folder
from homestream.llm.token_files import Encoder

CHUNK, PIECE = 2_000_000, 8192
CHUNKS = ("chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
          "groups_sha256 array<string>, groups array<string>, pairs binary, held binary, ends binary, of binary, times binary")
OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def diagonals(a, b, at):
    """Per entry of ``at``, how many of that many smallest ends are A's; of equal ends A's comes first.

    All binary searches run side by side: on a diagonal, an end of A is passed if it doesn't exceed the end of B
    that would be passed in its place.
    """
    import numpy as np
    lo, hi = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        passed = a[np.minimum(mid, len(a) - 1)] <= b[np.clip(at - 1 - mid, 0, len(b) - 1)]
        lo, hi = np.where(open_ & passed, mid + 1, lo), np.where(open_ & ~passed, mid, hi)
    return lo


def piece(a, b, i0, i1, j0, j1):
    """Links and groups that end in a piece: (A's token, B's token) of each, as two pairs of arrays."""
    import numpy as np
    came = max(a[i0 - 1] if i0 else 0, b[j0 - 1] if j0 else 0)
    both = np.concatenate((a[i0:i1], b[j0:j1]))
    order = np.argsort(both, kind="stable")
    ends, of_a = both[order], order < i1 - i0
    new = ends > np.concatenate(([came], ends[:-1]))
    done_a, done_b = i0 + np.cumsum(of_a), j0 + np.cumsum(~of_a)
    # an end that was there before is B's, and A's was passed just before it
    return (done_a - of_a)[new], (done_b - ~of_a)[new], done_a[~new] - 1, done_b[~new] - 1


def merged(a, b, size=PIECE):
    """(A's and B's token of each link, A's and B's last token of each group) of two ascending lists of ends."""
    import numpy as np
    at = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    i = diagonals(a, b, at)
    j = at - i
    parts = [piece(a, b, *cut) for cut in zip(i.tolist(), i[1:].tolist(), j.tolist(), j[1:].tolist())]
    return [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4


class Plain(Encoder):
    """A's ids; the strings of special tokens inside a text are plain text."""

    def __init__(self, path):
        super().__init__(path)
        self.library.encode_special_tokens = True


class Slots(dict):
    """word -> its number; ``fresh`` gathers the words that were given one."""

    def __init__(self, known=()):
        super().__init__(known)
        self.fresh, self.size = [], len(self)

    def __missing__(self, word):
        slot = self[word] = self.size
        self.size += 1
        self.fresh.append(word)
        return slot


def ragged(first, n):
    """Positions of runs of ``n`` entries that start at ``first``, one run after the other."""
    import numpy as np
    stops = np.cumsum(n)
    return np.arange(stops[-1] if len(n) else 0) + np.repeat(first - (stops - n), n)


def per_run(values, n):
    """Sums of runs of ``n`` values that lie one after the other."""
    import numpy as np
    return np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(n)))])


class Side:
    """One tokenizer's ids of numbered words, gathered in one array."""

    def __init__(self, tokens):
        import numpy as np
        # of the vocabulary: bytes of all tokens, their number per token, where each token's start
        self.every, self.sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array(list(map(len, tokens)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = self.first = self.n = np.zeros(0, np.int64)

    def of(self, slots):
        """The ids of words one after the other, and their number per word."""
        n = self.n[slots]
        return self.ids[ragged(self.first[slots], n)], n

    def put(self, slots, ids, n):
        import numpy as np
        more = np.zeros(max(0, slots.max(initial=-1) + 1 - len(self.n)), np.int64)
        self.first, self.n = np.concatenate((self.first, more)), np.concatenate((self.n, more))
        self.first[slots], self.n[slots] = len(self.ids) + np.cumsum(n) - n, n
        self.ids = np.concatenate((self.ids, ids))

    def keep(self, slots):
        """Forget all words but these, which are numbered anew in this order."""
        import numpy as np
        self.ids, self.n = self.of(slots)
        self.first = np.cumsum(self.n) - self.n

    def spells(self, ids, n, texts):
        """Per text, given as bytes, whether its tokens' joined bytes are the text."""
        import numpy as np
        sizes, lengths = self.sizes[ids], np.array(list(map(len, texts)), np.int64)
        same = per_run(sizes, n) == lengths
        token = np.repeat(same, n)
        made = self.every[ragged(self.starts[ids[token]], sizes[token])]
        want = np.frombuffer(b"".join([t for t, ok in zip(texts, same.tolist()) if ok]), np.uint8)
        at = np.flatnonzero(same)
        same[at[np.searchsorted(np.cumsum(lengths[at]), np.flatnonzero(made != want), "right")]] = False
        return same


class Words:
    """The ids of both tokenizers for texts.

    Texts with single spaces and line feeds as their only white space are cut into words once, for A and B alike: neither
    joins anything over those. Each word has a number, under which both sides hold its ids: a text's words are looked up
    once, then all ids are gathered side by side. The libraries see each word once, many at a time; letters with a sign
    after them are the letters' ids and the sign's, if neither tokenizer joins the two. Other texts go to each library on
    their own. Beyond ``REMEMBERED`` words the half that was used most stays; long words and whole texts aren't held.
    """

    def __init__(self, a_path, b_path):
        import numpy as np

        from homestream.llm.pieces import Pieces
        from homestream.llm.token_counts import byte_symbols
        self.a, self.pieces = Plain(a_path), Pieces(b_path)
        self.joins_lines = "\n" in self.pieces.chars
        sp = self.pieces.library
        self.line, self.skip = self.pieces.word("\n"), len(sp.encode("\n"))
        back = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        vocab = self.a.library.get_vocab()
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            # the content of a special token stands for itself
            a_bytes[i] = b"".join(map(back.__getitem__, token)) if all(c in back for c in token) else token.encode()
        b_bytes = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
                   for i in range(sp.get_piece_size())]
        self.sides = [Side(a_bytes), Side(b_bytes)]
        self.signs = self._signs()
        self.slots, self.uses, self.spelt = Slots(), np.zeros(0, np.int64), np.zeros(0, bool)
        for white in ("", "\n"):
            # each on its own: side by side with others A would join them
            self.slots[white]
            self._learn()

    def _signs(self):
        """sign -> its id of A and of B after letters, for signs that no piece of B joins to a letter before them."""
        joined = {y for t in self.pieces.ids for x, y in zip(t, t[1:]) if x.isalpha()}
        out = {}
        for c in {",", "."}.difference(joined):
            a, b = self.a._ids(c).tolist(), self.pieces.word(c)
            if len(a) == len(b) == 1:
                out[c] = a[0], b[0]
        return out

    def _a(self, words):
        """A's ids of words that follow a space or start with a line feed, one after the other, and their number per word."""
        import numpy as np
        ids = self.a._ids("".join(map(plain, words)))
        cut = np.flatnonzero(self.a.opens[ids])
        if len(cut) == len(words):
            return ids, np.diff(cut, append=len(ids))
        each = [self.a._ids(plain(w)) for w in words]
        return np.concatenate(each), np.array(list(map(len, each)), np.int64)

    def _b(self, words):
        """The same of B."""
        import numpy as np

        from homestream.llm.pieces import MARK
        out = [None] * len(words)
        usual = [i for i, w in enumerate(words) if w and MARK not in w and "\0" not in w]
        for i, ids in zip(usual, self.pieces.library.encode([words[i] for i in usual])):
            # the library puts a space mark in front of a line feed: both are cut off, the line feed put back
            out[i] = self.line + ids[self.skip:] if words[i][0] == "\n" else ids
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = self.line + self.pieces.word(w[1:]) if w[:1] == "\n" else self.pieces.word(MARK + w)
        n = np.array(list(map(len, out)), np.int64)
        return np.fromiter(chain.from_iterable(out), np.int64, n.sum()), n

    def _learn(self):
        """Both sides' ids of the words that were given numbers, and whether they spell the word."""
        import numpy as np
        number = self.slots.__getitem__

        def numbers(words):
            return np.fromiter(map(number, words), np.int64, len(words))

        signed = [w for w in self.slots.fresh if type(w) is str and w[-1:] in self.signs and w[:-1].isalpha()]
        stems = numbers([w[:-1] for w in signed])   # may be fresh themselves
        fresh, self.slots.fresh = self.slots.fresh, []
        if not fresh:
            return
        self.uses, self.spelt = (np.concatenate((x, np.zeros(len(fresh), x.dtype))) for x in (self.uses, self.spelt))
        apart = {*signed}
        words = [w for w in fresh if type(w) is str and w not in apart]
        if words:
            self._put(numbers(words), [self._a(words), self._b(words)], [plain(w).encode() for w in words])
        for whole in (w for w in fresh if type(w) is tuple):
            text = " " + whole[0]
            made = [(np.array(ids, np.int64), np.array([len(ids)])) for ids in (self.a._ids(text), self.pieces.whole(whole[0]))]
            self._put(numbers([whole]), made, [text.encode()])
        if signed:
            at = numbers(signed)
            for k, side in enumerate(self.sides):
                ids, n = side.of(stems)
                side.put(at, np.insert(ids, np.cumsum(n), [self.signs[w[-1]][k] for w in signed]), n + 1)
            self.spelt[at] = self.spelt[stems]
        for w in fresh:
            if type(w) is tuple or len(w) > LONGEST:
                del self.slots[w]

    def _put(self, slots, made, texts):
        self.spelt[slots] = True
        for side, (ids, n) in zip(self.sides, made):
            self.spelt[slots] &= side.spells(ids, n, texts)
            side.put(slots, ids, n)

    def _forget(self):
        import numpy as np
        if self.slots.size <= REMEMBERED and max(len(s.ids) for s in self.sides) <= 16 * REMEMBERED:
            return
        self.uses[:2] = np.iinfo(np.int64).max   # white space stays, under its numbers
        held = np.sort(np.fromiter(self.slots.values(), np.int64, len(self.slots)))
        stay = held[np.argsort(-self.uses[held], kind="stable")[:REMEMBERED // 2]]
        stay = stay[self.uses[stay] > 1]
        new = np.full(self.slots.size, -1)
        new[stay] = np.arange(len(stay))
        new = new.tolist()
        self.slots = Slots((w, new[s]) for w, s in self.slots.items() if new[s] >= 0)
        self.uses, self.spelt = self.uses[stay] // 2, self.spelt[stay]
        for side in self.sides:
            side.keep(stay)

    def encode(self, texts):
        """((ids, their number per text) of each side: A's of a space and the text, B's of the text), and whether each
        of a text's words is spelt by its tokens."""
        import numpy as np
        self._forget()
        words, n = [], []
        for t in texts:
            ws = None if self.joins_lines else words_of(" " + t)
            words += [(t,)] if ws is None else ws[1:]
            n.append(1 if ws is None else len(ws) - 1)
        slots, n = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words)), np.array(n, np.int64)
        self._learn()
        self.uses += np.bincount(slots, minlength=len(self.uses))
        spelt = per_run(self.spelt[slots], n) == n
        return [(ids, per_run(k, n)) for ids, k in (side.of(slots) for side in self.sides)], spelt


class Aligner:
    def __init__(self, a_path, b_path):
        import numpy as np
        self.words = Words(a_path, b_path)
        self.a_size, self.b_size = (side.sizes for side in self.words.sides)
        # each id as text with what may follow it, filled up with zeros
        self.label = np.array([f"{i}{end}" for tokens, ends in ((self.a_size, ",|"), (self.b_size, ",;")) for end in ends for i in range(len(tokens))], "S")

    def tokens(self, texts):
        """(A's ids, their number per text, B's ids, their number per text); none of texts whose joined token bytes
        differ from a space and the text."""
        import numpy as np
        some = [i for i, t in enumerate(texts) if t]
        sides, same = self.words.encode([texts[i] for i in some])
        if len(odd := np.flatnonzero(~same)):
            # words' bytes may differ and yet join to the text
            whole, hit = [(" " + texts[some[i]]).encode() for i in odd.tolist()], ~same
            same[odd] = np.logical_and(*[side.spells(ids[np.repeat(hit, n)], n[odd], whole) for side, (ids, n) in zip(self.words.sides, sides)])
        out = []
        for ids, n in sides:
            total = np.zeros(len(texts), np.int64)
            total[some] = n * same
            out += ids if same.all() else ids[np.repeat(same, n)], total
        return out

    def chunk(self, texts, groups=False):
        """Results of a chunk's documents: the columns of CHUNKS after doc_id."""
        import numpy as np
        from hashlib import sha256
        n = len(texts)
        a, n_a, b, n_b = self.tokens(texts)
        # ends over all documents one after the other: where a document ends, both tokenizers end
        link_a, link_b, last_a, last_b = merged(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        doc_of = np.repeat(np.arange(n), n_a)
        link_doc = doc_of[link_a]
        n_links, n_groups = np.bincount(link_doc, minlength=n), np.bincount(doc_of[last_a], minlength=n)

        # stitched groups: their tokens in order, A's before B's, each with the sign that follows it
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        coded = np.empty(len(a) + len(b), np.int64)
        close_a, close_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        close_a[last_a] = close_b[last_b] = True
        coded[np.arange(len(a)) + np.repeat(last_b + 1 - in_b, in_a)] = a + close_a * len(self.a_size)
        coded[np.arange(len(b)) + np.repeat(last_a + 1, in_b)] = 2 * len(self.a_size) + b + close_b * len(self.b_size)
        stops = np.cumsum(n_a + n_b)
        marks, kept = [], []
        for lo, hi in zip((stops - n_a - n_b).tolist(), stops.tolist()):
            g = self.label[coded[lo:hi]].tobytes().translate(None, b"\0")[:-1]
            marks.append(sha256(g).hexdigest() if g else "")
            kept.append(g.decode() if groups else None)

        pairs, at = np.unique(a[link_a] << 32 | b[link_b], return_inverse=True)
        held, times = np.unique(link_doc * max(1, len(pairs)) + at.reshape(-1), return_counts=True)
        doc, of = np.divmod(held, max(1, len(pairs)))
        return [n_a, n_b, n_groups, n_links, marks, kept, pairs.astype("<i8").tobytes(),
                np.bincount(of, minlength=len(pairs)).astype("<i4").tobytes(),
                np.searchsorted(doc, np.arange(n + 1)).astype("<i8").tobytes(), of.astype("<i4").tobytes(), times.astype("<i4").tobytes()]


@lru_cache(maxsize=1)
def aligner(a_path, b_path):
    """One per Python worker: tasks that follow each other keep the words seen."""
    return Aligner(a_path, b_path)


def write_chunks(df: DataFrame, a_path, b_path, target, doc_id="doc_id", text="text", groups=False, chunk=CHUNK) -> None:
    """Tokenise and align every text, a row for each chunk of documents."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        work, pid = aligner(a_path, b_path).chunk, TaskContext.get().partitionId()
        longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
        types = [pa.int64(), *[longs] * 5, texts, texts, *[pa.binary()] * 5]
        count, ids, held, size = 0, [], [], 0

        def row():
            made = [(pid << 33) + count, ids, *work(held, groups)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, types)], names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and size + len(t or "") > chunk:
                    yield row()
                    count, ids, held, size = count + 1, [], [], 0
                ids.append(i)
                held.append(t)
                size += len(t or "")
        if held:
            yield row()

    (df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
     .mapInArrow(run, CHUNKS).write.option("compression", "zstd").parquet(target))


def pair_counts(chunks: DataFrame):
    """((chunk, pair) rows, (pair, count, best) of every id pair): in how many documents a pair is linked, and whether
    that is the highest count of its A id."""
    def spread(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for chunk, pairs, held in zip(*[c.to_pylist() for c in b.columns]):
                p, n = np.frombuffer(pairs, "<i8"), np.frombuffer(held, "<i4").astype(np.int64)
                for lo in range(0, len(p), 100_000):
                    part = p[lo:lo + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(n[lo:lo + 100_000])], ["chunk", "pair", "n"])

    rows = chunks.select("chunk", "pairs", "held").mapInArrow(spread, "chunk bigint, pair bigint, n bigint")
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    return rows.select("chunk", "pair"), counts


def align(df: DataFrame, a_path, b_path, doc_id="doc_id", text="text", groups=False, chunk=CHUNK) -> DataFrame:
    """One row per row of ``df``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with
    ``groups`` the groups as text too."""
    spark = df.sparkSession
    target, counted = shared_folder(spark, "aligned-chunks"), shared_folder(spark, "pair-counts")
    write_chunks(df, a_path, b_path, target, doc_id, text, groups, chunk)
    chunks = spark.read.schema(CHUNKS).parquet(target)
    rows, counts = pair_counts(chunks)
    counts.write.parquet(counted)
    counts = spark.read.schema(counts.schema).parquet(counted)
    a_id = F.shiftright("pair", 32)
    # one row for each id of A, so bounded by its vocabulary
    best = counts.groupBy(a_id.alias("_a")).agg(F.max("count").alias("_best"))
    looked = counts.join(F.broadcast(best), a_id == F.col("_a")).select("pair", "count", (F.col("count") == F.col("_best")).alias("best"))
    known = rows.join(looked, "pair").select("chunk", "pair", "count", "best")
    per_doc = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * groups]
    schema = OUT + ", groups string" * groups
    names = [f.split()[0] for f in schema.split(", ")]

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        order = np.argsort(right.column("pair").to_numpy())
        count, top = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order].astype(np.int64)
        row = left.to_pylist()[0]
        ends, of, times = (np.frombuffer(row[c], t) for c, t in (("ends", "<i8"), ("of", "<i4"), ("times", "<i4")))
        times = times.astype(np.int64)
        out = {c: row[c] for c in per_doc}
        for name, value in (("n_best", top), ("count_sum", count)):
            run_ = np.concatenate(([0], np.cumsum(value[of] * times)))
            out[name] = run_[ends[1:]] - run_[ends[:-1]]
        kinds = {"groups_sha256": pa.string(), "groups": pa.string()}
        return pa.table({n: pa.array(out[n], kinds.get(n, pa.int64())) for n in names})

    wide = chunks.select("chunk", *per_doc, "ends", "of", "times")
    return wide.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, schema)
