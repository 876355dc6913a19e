"""Token counts without identifiers: byte-pair merging by a heap over a linked list.

A word's bytes are its first symbols. The heap yields the lowest-ranked adjacent pair (the leftmost of
equal ones), the pair becomes one symbol, and the two pairs around it are pushed. Every merge removes one
symbol: the count is initial symbols minus merges. Special strings inside a text count as one token each,
as the library's default handles them. Words are remembered per task, within a bound.

Null and empty texts have 0 bytes and 0 tokens. Equal rows give equal counts. Other columns pass through,
but those named like an output are replaced; an empty table gives an empty table.
"""

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, functions as F, types as T

from homestream.llm.bytebpe import PATTERN, SPECIAL, Memory, plain, words_of

LIMIT = 512


def byte_symbols():
    """The public byte-to-symbol rule: printable bytes stand for themselves, the others for 256, 257, ..."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in shown)
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Merges:
    """Ranks of a vocabulary file: pair of symbol numbers -> (rank, number of the joined symbol)."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.vocab = model["model"]["vocab"]
        self.single = [self.vocab.get(s) for s in byte_symbols()]
        self.pairs = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]

    def count(self, word: bytes) -> int:
        """Initial symbols minus merges."""
        symbol = [self.single[b] for b in word]
        n, pairs = len(symbol), self.pairs
        if n < 2:
            return n
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = [(hit[0], i, a, b, hit[1]) for i, (a, b) in enumerate(zip(symbol, symbol[1:]))
                if (hit := pairs.get((a, b)))]
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, joined = heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue    # one of the two has been merged meanwhile
            merges += 1
            symbol[i], symbol[j] = joined, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if hit := pairs.get((joined, symbol[k])):
                    heappush(heap, (hit[0], i, joined, symbol[k], hit[1]))
            h = before[i]
            if h >= 0 and (hit := pairs.get((symbol[h], joined))):
                heappush(heap, (hit[0], h, symbol[h], joined, hit[1]))
        return n - merges


class Counter:
    def __init__(self, path):
        import regex
        merges = Merges(path)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, merges.special)) or r"(?!)")
        self.token = Memory(lambda t: merges.count(t.encode()))
        # a word with its punctuation: the sum over its pre-tokens
        self.word = Memory(lambda w: self.uncut(plain(w)))

    def uncut(self, text):
        return sum(map(self.token.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        words = words_of(text)
        if words is not None:
            return self.uncut(words[0]) + sum(map(self.word.__getitem__, words[1:]))
        if SPECIAL not in text and not self.special.search(text):
            return self.uncut(text)
        return len(self.special.findall(text)) + sum(map(self.uncut, self.special.split(text)))


@lru_cache(maxsize=2)
def counter(path):
    """One per Python worker: tasks that follow each other keep what was remembered."""
    return Counter(path)


def count_tokens(df: DataFrame, path: str, text="text", keep=None, limit=LIMIT) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit. ``path``: vocabulary file, readable on every executor;
    ``keep``: the other columns that pass through."""
    names = [c for c in (keep or df.columns) if c not in ("n_bytes", "n_tokens", "over_limit")]
    rows = df.select(*names, F.col(text).cast("string").alias("_count_text"))

    def run(batches):
        import pyarrow as pa
        count = counter(path).count
        for b in batches:
            n = [count(t) if t else 0 for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n, pa.int64())], [*names, "n_tokens"])

    # the length in bytes travels beside the text and not with it to Python and back
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    with_bytes = rows.select(*names, F.coalesce(F.octet_length("_count_text").cast("long"), F.lit(0).cast("long")).alias("_bytes"), "_count_text")
    names = [*names, "_bytes"]
    out = with_bytes.mapInArrow(run, schema)
    return out.select(*names[:-1], F.col("_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
