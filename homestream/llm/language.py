"""Language identification by cross-parsing against suffix automata.

Per language, a suffix automaton of sampled labelled text accepts every substring of it. A document is parsed
into phrases, each the longest match from where the last one ended; the language that needs fewest phrases,
normalised by the logarithm of its automaton's text over the document's length, wins. Text is lower-cased, runs of
letters and their marks stay, whatever lies between them becomes one space, and phrases run across spaces.

Longest matches from left to right need no going back: the automaton is a table of (state, sign) -> (next state,
phrases ended). So a task parses many documents side by side in numpy, one sign of each at a step, and what is left
of the few longest ones sign by sign. Tables beyond ``TABLE`` cells (samples with thousands of different signs) stay
dictionaries; the counts are the same.

The sample holds, per language, the ``DOCS`` labelled rows with the smallest hash of identifier and text, of whose
signs ``CHARS`` are dealt out evenly: no document takes more than its share while others have text left. The automata
have a fixed size and travel as plain text. Everything else sees all rows and whole texts. A null text or one
without a letter is ``und`` with score 0, as is every text if there is nothing to learn from. Ties go to the smaller
language name. Labelled rows with a null or repeated identifier can teach; rows repeated whole teach once. Columns
named like an output are replaced; an empty table gives an empty result.
"""

from functools import lru_cache

import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from homestream.llm.common import folds_of

DOCS, CHARS, NONE = 48, 40_000, "und"
#: Cells of a language's table at most; documents below which a step isn't worth numpy; texts parsed side by side.
TABLE, FEW, BESIDE = 1 << 24, 24, 2000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class SuffixAutomaton:
    """All substrings of a text. Transitions lie in one dict: state * 2**21 + code point -> state."""

    def __init__(self, text):
        step, link, length = {}, [-1], [0]
        moves = [{}]
        last = 0
        for c in text:
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            moves.append({})
            p = last
            while p != -1 and c not in moves[p]:
                moves[p][c] = cur
                p = link[p]
            if p != -1:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    moves.append(dict(moves[q]))
                    while p != -1 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        for state, out in enumerate(moves):
            for c, to in out.items():
                step[state << 21 | ord(c)] = to
        self.step, self.states = step, len(moves)

    def table(self, signs):
        """Next state * 4 + phrases ended, by state and number of the sign; 0 is any sign not in ``signs``."""
        import numpy as np
        out = np.empty((self.states, len(signs) + 1), np.int32)
        open_ = np.arange(self.states) > 0
        out[:] = (open_ + 1)[:, None]
        for n, c in enumerate(signs, 1):
            if (to := self.step.get(ord(c))) is not None:
                out[:, n] = to * 4 + open_
        number = {ord(c): n for n, c in enumerate(signs, 1)}
        keys = np.fromiter(self.step, np.int64, len(self.step))
        at = np.fromiter(map(number.__getitem__, (keys & (1 << 21) - 1).tolist()), np.int64, len(keys))
        out[keys >> 21, at] = np.fromiter(self.step.values(), np.int64, len(keys)) * 4
        return out

    def phrases(self, text, state=0) -> int:
        """Number of longest matches that cover the text; an unknown character is a phrase of its own."""
        get, count = self.step.get, 0
        for c in map(ord, text):
            to = get(state << 21 | c)
            if to is None:
                count += state > 0
                to = get(c)
                if to is None:
                    count += 1
                    to = 0
            state = to
        return count + (state > 0)


def plain(text):
    """Letters and marks, lower case, a space between their runs and at either end; empty without a letter."""
    words = WORD.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


class Parser:
    """``samples``: ((language, text), ...)."""

    def __init__(self, samples):
        import numpy as np
        self.langs = [lang for lang, _ in samples]
        self.automata = [SuffixAutomaton(text) for _, text in samples]
        self.bits = np.log2([max(2, len(text)) for _, text in samples])
        signs = sorted({c for _, text in samples for c in text})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.width = len(signs) + 1
        self.tables = [a.table(signs).reshape(-1) if a.states * self.width <= TABLE else None for a in self.automata]

    def counts(self, texts):
        """Phrases of each text (rows) by each language's automaton."""
        import numpy as np
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        starts = np.cumsum(sizes) - sizes
        signs = self.number[np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le"), "<u4")]
        quick = [k for k, t in enumerate(self.tables) if t is not None]
        state, count = np.zeros((len(self.langs), len(texts)), np.int64), np.zeros((len(self.langs), len(texts)), np.int64)
        t, active = 0, int((sizes > 0).sum())
        while active >= FEW:
            sign = signs[starts[:active] + t]
            for k in quick:
                to = self.tables[k][state[k, :active] * self.width + sign]
                state[k, :active] = to >> 2
                count[k, :active] += to & 3
            t += 1
            while active and sizes[active - 1] <= t:
                active -= 1
        for k in quick:
            ended = sizes <= t
            count[k, ended] += state[k, ended] > 0
            for i in range(active):
                count[k, i] += self.automata[k].phrases(texts[order[i]][t:], int(state[k, i]))
        for k in {*range(len(self.langs))}.difference(quick):
            count[k] = [self.automata[k].phrases(texts[i]) for i in order]
        out = np.empty((len(texts), len(self.langs)), np.int64)
        out[order] = count.T
        return out

    def parse(self, texts):
        """(language, score) of each text."""
        import numpy as np
        made = [plain(t or "") for t in texts]
        if not self.langs:
            return [(NONE, 0.0)] * len(texts)
        out = []
        for text, total in zip(made, self.counts(made)):
            if not text:
                out.append((NONE, 0.0))
                continue
            bits = total * self.bits / len(text)
            best = min(range(len(bits)), key=lambda i: (bits[i], self.langs[i]))
            out.append((self.langs[best], float(1 / np.exp2(2 * (bits[best] - bits)).sum())))
        return out


@lru_cache(maxsize=1)
def parser(samples):
    """One per Python worker: automata are built once."""
    return Parser(samples)


def dealt(texts, room=CHARS):
    """The texts in their order, cut so that they fill ``room`` together and none exceeds an even share while another
    is cut."""
    take = {}
    for left, i in zip(range(len(texts), 0, -1), sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        take[i] = min(len(texts[i]), room // left)
        room -= take[i]
    return [t[:take[i]] for i, t in enumerate(texts)]


def sample_texts(df: DataFrame, doc_id="doc_id", text="text", lang="lang", fold=None):
    """((language, sample), ...) from DOCS rows of each language. A line feed, which no parsed text holds, parts them."""
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if fold is not None:
        rows = rows.filter(fold)
    language, digest = F.col(lang).cast("string").alias("_lang"), F.xxhash64(doc_id, text).alias("_h")
    # rows repeated whole fold first, then the smallest hashes: of each language's 64 slices, and of these
    key = rows.select(language, digest).distinct()
    sliced = Window.partitionBy("_lang", F.pmod("_h", F.lit(64))).orderBy("_h")
    whole = Window.partitionBy("_lang").orderBy("_h")
    few = (key.withColumn("_n", F.row_number().over(sliced)).filter(F.col("_n") <= DOCS)
           .withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= DOCS).drop("_n"))
    # CHARS code points of a text are as many as its language's sample can take; DOCS rows of a language come back
    picked = (rows.select(language, digest, F.substring(text, 1, CHARS).alias("_t"))
              .join(F.broadcast(few), ["_lang", "_h"]).groupBy("_lang", "_h").agg(F.min("_t").alias("_t")).collect())
    texts = {}
    for row in sorted(picked, key=lambda r: (r["_lang"], r["_h"])):
        if made := plain(row["_t"]):
            texts.setdefault(row["_lang"], []).append(made)
    return tuple((k, "\n".join(dealt(v))) for k, v in sorted(texts.items()))


def identify(df: DataFrame, samples, text="text", keep=None) -> DataFrame:
    """Adds lang_pred and score."""
    names = [c for c in (keep or df.columns) if c not in ("lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(samples)
    rows = df.select(*names, F.col(text).cast("string").alias("_lang_text"))

    def run(batches):
        import pyarrow as pa
        parse = parser(shared.value).parse
        for big in batches:
            for lo in range(0, big.num_rows, BESIDE):
                b = big.slice(lo, BESIDE)
                found = parse(b.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([
        *rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def predict(df: DataFrame, doc_id="doc_id", text="text", lang="lang", keep=None, folds=4, held=2) -> DataFrame:
    """Learn from rows outside the held-out fold (crc32 of the identifier, modulo), predict every row."""
    samples = sample_texts(df, doc_id, text, lang, folds_of(doc_id, folds) != held)
    return identify(df, samples, text, keep).withColumn("held_out", folds_of(doc_id, folds) == held)
