"""Alignment against a plain loop over the libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from homestream.llm import alignment
from homestream.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES, tokenizer
from homestream.llm.token_counts import byte_symbols
from tests.llm.test_operators import TEXTS, docs, empty


def both_tokens(texts):
    """[(ids and bytes of A, ids and bytes of B)] by the libraries; empty lists where they don't give the text."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer(BYTE_BPE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECE_BPE))
    back = {s: n for n, s in enumerate(byte_symbols())}
    out = []
    for t in texts:
        want = (" " + t).encode() if t else b""
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        pa = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
        pb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        out.append(((ia, pa), (ib, pb)) if b"".join(pa) == want == b"".join(pb) else (([], []), ([], [])))
    return out


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(texts):
    rows, corpus = [], Counter()
    for (ia, pa), (ib, pb) in both_tokens(texts):
        sa, sb = spans(pa), spans(pb)
        links, j = [], 0
        for x, (s, e) in zip(ia, sa):
            while j and sb[j - 1][1] > s:
                j -= 1
            while j < len(sb) and sb[j][0] < e:
                if sb[j][1] > s:
                    links.append((x, ib[j]))
                j += 1
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, lo = [], 0
        ga, gb = {}, {}
        at = {e: n for n, e in enumerate(ends)}
        n = 0
        for x, (s, e) in zip(ia, sa):
            ga.setdefault(n, []).append(x)
            n += e in at
        n = 0
        for x, (s, e) in zip(ib, sb):
            gb.setdefault(n, []).append(x)
            n += e in at
        groups = ";".join(",".join(map(str, ga[g])) + "|" + ",".join(map(str, gb[g])) for g in range(len(ends)))
        corpus.update({*links})
        rows.append((len(ia), len(ib), len(ends), links, groups))
    best = {}
    for (a, _), n in corpus.items():
        best[a] = max(best.get(a, 0), n)
    return [(a, b, g, len(links), sum(corpus[x] == best[x[0]] for x in links), sum(corpus[x] for x in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "", groups) for a, b, g, links, groups in rows]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("chunk", [300, alignment.CHUNK])
def test_align(spark, chunk):
    texts = TEXTS + TEXTS[20:25] + ["a" * 3000, "x▁y", "▁", " lead", "trail ", "\x00\x01"]
    got = alignment.align(docs(spark, texts).repartition(3), tokenizer(BYTE_BPE), tokenizer(PIECE_BPE), groups=True, chunk=chunk)
    want = brute(texts)
    rows = got.orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for row, t, w in zip(rows, texts, want):
        assert (*[row[c] for c in COLUMNS], row.groups or "") == w, t
    assert not rows[texts.index("x▁y")].n_a and rows[texts.index("<|endoftext|> a<|endoftext|>")].n_a > 3


def test_repeated_and_null_identifiers(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (4, "one two"), (4, None), (4, "")], "doc_id bigint, text string")
    got = alignment.align(df, tokenizer(BYTE_BPE), tokenizer(PIECE_BPE)).collect()
    want = brute(["one two"] * 3)[0][:-1]
    assert sorted(tuple(r)[1:] == want for r in got) == [False, False, True, True, True]
    assert all(r.groups_sha256 == "" and r.count_sum == 0 for r in got if not r.n_a)
    assert alignment.align(empty(spark), tokenizer(BYTE_BPE), tokenizer(PIECE_BPE)).count() == 0


def test_frequent_words_stay_known(monkeypatch):
    """The library sees a word that keeps coming once, however many others fill the memory, and none with a sign after its
    letters; what is forgotten, learned again or never held gives the same tokens."""
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    made = alignment.Aligner(tokenizer(BYTE_BPE), tokenizer(PIECE_BPE))
    library, seen = made.words.pieces.library, []

    class Seen:
        def encode(self, words):
            seen.extend([words] if isinstance(words, str) else words)
            return library.encode(words)

    made.words.pieces.library = Seen()
    texts, got = [], []
    for n in range(30):
        rare = " ".join(f"rare{n}x{k}" for k in range(30))
        some = [f"often often, often.\noften, {rare} {'w' * 70}, é, ſ. ², ,. x▁y", None, f"often {rare} ", f"odd  {n}", f"{rare}, often."]
        texts += some
        got += zip(*made.chunk(some, True)[:6])
    want = brute(texts)
    for g, w, t in zip(got, want, texts):
        assert tuple(g) == (*w[:4], *w[6:]), t
    assert seen.count("often") == 1 and not {"often,", "often."}.intersection(seen)
    assert len(made.words.slots) < 200 and max(map(len, (w for w in made.words.slots))) <= alignment.LONGEST


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_pieces_are_independent(size):
    """Any cut by diagonals gives the links and groups of the uncut merge."""
    r = random.Random(size)
    for _ in range(60):
        end = r.randint(1, 80)
        a, b = (np.array(sorted({*r.sample(range(1, end + 1), r.randint(1, end)), end})) for _ in range(2))
        ends = sorted({*a.tolist(), *b.tolist()})
        links = [(int(np.searchsorted(a, e)), int(np.searchsorted(b, e))) for e in ends]
        shared = [(a.tolist().index(e), b.tolist().index(e)) for e in ends if e in a and e in b]
        la, lb, ga, gb = alignment.merged(a, b, size)
        assert [*zip(la.tolist(), lb.tolist())] == links and [*zip(ga.tolist(), gb.tolist())] == shared
        at = np.arange(len(a) + len(b) + 1)
        order = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
        assert alignment.diagonals(a, b, at).tolist() == [sum(k == 0 for _, k in order[:n]) for n in at]


def test_query(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", *COLUMNS]
    assert {x.doc_id: tuple(x)[1:] for x in got.collect()} == {i: w[:-1] for (i, _), w in zip(rows, brute([t for _, t in rows]))}
