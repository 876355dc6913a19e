"""SentencePiece BPE by a prefix table.

The encoding of every prefix of a text ends in exactly one token. Going through the text once, an
Aho-Corasick automaton of all pieces gives the candidates that end at each character; the right one is the
only candidate compatible with the last token of the prefix before it, where two tokens are compatible if
merging their joined text by rank gives just these two. The ids are then read backwards from the table.
Compatibility is remembered per pair, encodings per word, both within a bound.

Text is cut where no piece can reach across: before a space mark that follows another character, and at
characters outside the vocabulary, which become byte tokens. Runs of several space marks are merged by rank
directly, because all their pieces share one score and the table needs distinct ranks. Decoding is the
library's.

For models with byte fallback, identity normalisation and a dummy prefix; others are refused. Null and
empty texts give only the end id. Other columns pass through, but those named like an output are replaced.
"""

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.llm.bytebpe import LONGEST, REMEMBERED, Memory

MARK = "▁"


class Lately(dict):
    """word -> work(word) like :class:`Memory` and as large, but in two halves: when the newer is full the older is
    forgotten, so that words that keep coming stay."""

    def __init__(self, work):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, word):
        found = self.older.get(word)
        if found is None:
            found = self.work(word)
            if len(word) > LONGEST:
                return found
        if 2 * len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class Pieces:
    def __init__(self, path):
        import ahocorasick
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in normal}
        self.ids = {t: i for i, t in self.text.items()}
        self.rank = {t: -sp.get_score(i) for t, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = {t for t in self.ids if len(t) == 1}
        if not all(map(sp.is_byte, self.bytes)) or any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("needs byte fallback, and pieces that hold the space mark only in front")
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.pairs = Memory(lambda ab: self.compatible(ab >> 32, ab & 0xFFFFFFFF))     # two ids as one number
        self.alone = Memory(lambda a: self.merged(self.text[a]) == [a])
        self.spines = {side: Memory(lambda a, side=side: self.spine(self.text[a], side)) for side in (0, 1)}
        self.splits = {}
        outside = "".join(map(re.escape, sorted(self.chars)))
        self.known = re.compile(f"[{outside}]+|[^{outside}]")
        for probe in ("a", " a  b", "\ta\n", "ﬁ ① Á"):
            if sp.encode(probe) != self.whole(probe):
                raise ValueError("the model normalises text or adds no dummy prefix")

    def merged(self, text, merges=None):
        """Ids of known characters, merged by rank, leftmost first among equals. ``merges`` gathers the parts of each merge."""
        part = list(text)
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        rank = self.rank
        heap = [(r, i, p + q) for i, (p, q) in enumerate(zip(part, part[1:])) if (r := rank.get(p + q)) is not None]
        heapify(heap)
        while heap:
            _, i, joined = heappop(heap)
            j = after[i]
            if part[i] is None or j < 0 or part[i] + part[j] != joined:
                continue
            if merges is not None:
                merges.append((part[i], part[j]))
            part[i], part[j] = joined, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(joined + part[k])) is not None:
                    heappush(heap, (r, i, joined + part[k]))
            h = before[i]
            if h >= 0 and (r := rank.get(part[h] + joined)) is not None:
                heappush(heap, (r, h, part[h] + joined))
        return [self.ids[p] for p in part if p is not None]

    def split(self, text):
        """The two parts that a piece is merged from last; None where its own text isn't merged to it, or where, somewhere
        in it, a piece ranks before one of its parts, so that ranks don't tell the order of its merges."""
        if text not in self.splits:
            merges = []
            found = self.merged(text, merges)
            parts = merges[-1] if len(found) == 1 else None
            if parts and any(len(p) > 1 and (self.rank[p] >= self.rank[text] or self.split(p) is None) for p in parts):
                parts = None
            self.splits[text] = parts
        return self.splits[text]

    def spine(self, text, side):
        """A piece and, down to a character, the parts on its left (0) or right (1) edge: (text, rank of the merge that
        made it, -1 for a character); None as in :meth:`split`."""
        out = []
        while len(text) > 1:
            out.append((text, self.rank[text]))
            parts = self.split(text)
            if parts is None:
                return None
            text = parts[side]
        return [*out, (text, -1)]

    def compatible(self, a, b):
        """Whether merging the joined text of two tokens gives just these two.

        It does unless a merge reaches across. The parts at the border are gone through backwards in time, from the whole
        tokens to characters: two that lie there side by side are merged if their joined text ranks before the merges
        that use them up (the one on the left goes first among equals).
        """
        if not (self.alone[a] and self.alone[b]):
            return False
        left, right = self.spines[1][a], self.spines[0][b]
        if left is None or right is None:
            return self.merged(self.text[a] + self.text[b]) == [a, b]
        rank, i, j, n, m = self.rank.get, 0, 0, len(left) - 1, len(right) - 1
        (x, made_x), (y, made_y) = left[0], right[0]
        until_x = until_y = float("inf")
        while True:
            r = rank(x + y)
            if r is not None and r < until_x and r <= until_y:
                return False
            if i == n and j == m:
                return True
            if made_x > made_y:
                i, until_x = i + 1, made_x
                x, made_x = left[i]
            else:
                j, until_y = j + 1, made_y
                y, made_y = right[j]

    def table(self, text):
        """Ids of known characters by the prefix table."""
        if MARK + MARK in text:
            return self.merged(text)
        last, size = [0] * (len(text) + 1), [0] * (len(text) + 1)
        pairs, alone = self.pairs, self.alone
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if size[end]:
                continue        # no second one is compatible
            at = end - length
            if pairs[last[at] << 32 | token] if at else alone[token]:
                last[end], size[end] = token, length
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def word(self, word):
        """Ids of text that starts a word, space marks in place."""
        out = []
        for run in self.known.findall(word):
            if run[0] in self.chars:
                out += self.table(run)
            else:
                out += [self.bytes[b] for b in run.encode()]
        return out

    def whole(self, text):
        return [i for w in words_of(text, "\n" in self.chars) for i in self.word(w)]


WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def words_of(text, joins_lines=False):
    """The text with its dummy prefix as independently encoded words, space marks in place."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or joins_lines:
        return WORDS.findall((MARK + text).replace(" ", MARK))
    out = []
    for i, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        if i:
            out.append("\n")
            if first:
                out.append(first)
        else:
            out.append(MARK + first)
        out += [MARK + w for w in rest]
    return out


class Coder:
    """Packed ids of whole texts; words are remembered."""

    def __init__(self, path):
        import numpy as np
        self.pieces = pieces = Pieces(path)
        self.memory = Lately(lambda w: np.array(pieces.word(w), "<i4").tobytes())
        self.joins_lines = "\n" in pieces.chars

    def encode(self, text) -> bytes:
        return b"".join(map(self.memory.__getitem__, words_of(text, self.joins_lines)))


@lru_cache(maxsize=2)
def coder(path):
    """One per Python worker: tasks that follow each other keep what was remembered."""
    return Coder(path)


def encode_decode(df: DataFrame, path: str, text="text", keep=None) -> DataFrame:
    """Adds ``ids`` (array of int, end id last) and ``decoded`` (the library's text of these ids).

    ``path``: model file, readable on every executor; ``keep``: the other columns that pass through.
    """
    names = [c for c in (keep or df.columns) if c not in ("ids", "decoded")]
    rows = df.select(*names, F.col(text).cast("string").alias("_piece_text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        code = coder(path)
        end = code.pieces.library.eos_id()
        tail, decode = np.array([end], "<i4").tobytes(), code.pieces.library.decode
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                packed = [(code.encode(t) if t else b"") + tail for t in b.column(len(names)).to_pylist()]
                offsets = np.cumsum([0, *map(len, packed)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                decoded = [decode(np.frombuffer(p, "<i4").tolist()) for p in packed]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, pa.array(decoded, pa.string())], [*names, "ids", "decoded"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(run, schema)


def digest(df: DataFrame) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256; drops ids and decoded."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.withColumns({
        "n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(ids.cast("binary"), 256),
        "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}).drop("ids", "decoded")
