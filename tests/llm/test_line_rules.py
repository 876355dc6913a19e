"""Counting rules against a plain loop, the field against all sequences of states, verdicts against held-out labels."""

import itertools
import math
import random
import re
import zlib

import numpy as np

from homestream.llm import line_rules
from homestream.llm.queries import QUERIES
from tests.llm.test_operators import ODD, docs, empty


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = [False] * len(words)
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit[i:i + 8] = [True] * 8
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), sum(hit))


def failed(c):
    return c[0] < 20 or 100 * c[4] > 30 * c[0]


def texts_of(seed=1):
    r = random.Random(seed)
    vocabulary = ["a", "b", "Çé", "x#", "|", "$%", "😀", "!!", "12"]
    sep = [" ", " ", " ", "\n", "\t", "\x0b", "\r\n", "\n\n"]
    made = ["".join(r.choice(vocabulary[:r.randint(1, 9)]) + r.choice(sep) for _ in range(r.randint(0, 60))) for _ in range(250)]
    line = " ".join(f"w{i}" for i in range(12))
    return ODD + made + [line + "\n" + line, line + "\n" + line + " ", "\n" * 50, " \n \n", "   x \x1cy"]


def test_counts(spark):
    texts = texts_of()
    got = line_rules.judge(docs(spark, texts), line_rules.Field()).orderBy("doc_id").collect()
    for row, t in zip(got, texts, strict=True):
        want = brute(t)
        assert tuple(row[c] for c in line_rules.COUNTS) == want, t
        assert row.base_failed == failed(want) and row.kept == (not row.base_failed) and row.value == "v"
    together = line_rules.measure([(t or "").encode() for t in texts])[0]
    assert [tuple(x) for x in together.tolist()] == [brute(t) for t in texts]      # texts don't mix
    assert line_rules.judge(empty(spark), line_rules.Field()).count() == 0


def test_counts_of_long_text(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    body = [r.choice(words) for _ in range(200_000)]
    body[150_000:150_040] = body[10:50]
    row = line_rules.judge(docs(spark, [" ".join(body), "\n".join(body)]), line_rules.Field()).orderBy("doc_id").collect()
    assert row[0].n_repeat_words == row[1].n_repeat_words == 80
    assert row[1].n_dup_lines == 200_000 - len({*body})


def random_field(seed):
    rng = np.random.default_rng(seed)
    f = line_rules.Field([np.array([0.5])] * len(line_rules.FEATURES))
    f.weights, f.step, f.start, f.fitted = rng.normal(size=f.weights.shape), rng.normal(size=(2, 2)), rng.normal(size=2), True
    return f


def path_score(f, e, states):
    s = f.start[states[0]] + sum(x for x, y in zip(e, states) if y)
    return s + sum(f.step[a, b] for a, b in zip(states, states[1:]))


def test_viterbi_and_marginals():
    for seed in range(20):
        f = random_field(seed)
        x = np.random.default_rng(seed + 99).random((seed % 9 + 1, len(line_rules.FEATURES)))
        e = f.emission(f.binned(x))
        paths = list(itertools.product((0, 1), repeat=len(x)))
        scores = [path_score(f, e, p) for p in paths]
        assert tuple(f.viterbi(x)) == paths[int(np.argmax(scores))]
        p = np.exp(scores) / np.exp(scores).sum()
        short = np.zeros((2, len(x)))
        short[0], short[1, 0] = e, e[0]
        p1, pair = f.marginals(short, np.array([len(x), 1]))
        for t in range(len(x)):
            assert math.isclose(p1[0, t], sum(q for q, s in zip(p, paths) if s[t]), abs_tol=1e-9)
        for t in range(len(x) - 1):
            assert math.isclose(pair[0, t, 1, 0], sum(q for q, s in zip(p, paths) if (s[t], s[t + 1]) == (1, 0)), abs_tol=1e-9)


def test_fit_finds_mixed_lines():
    """Lines of the other kind inside labelled documents change over; the field tells the kinds apart."""
    r = random.Random(4)
    words = [f"{a}{b}" for a in "bdfglm" for b in ("an", "er", "it", "ol")]

    def line(loud):
        w = r.choices(words, k=r.randint(6, 12))
        return ("!! ".join(x.upper() for x in w) + "!!" if loud else " ".join(w) + ".").encode()

    made = [(y, b"\n".join(line(not y if r.random() < 0.2 else y == 0) for _ in range(8))) for y in (0, 1) for _ in range(80)]
    rows = [(y, *line_rules.measure([t])[2:]) for y, t in made]
    field = line_rules.learnt(rows)
    lines = [line(bool(i % 2)) for i in range(40)]
    right = np.mean([field.viterbi(line_rules.measure([x])[3])[0] == (i + 1) % 2 for i, x in enumerate(lines)])
    assert right == 1


def test_without_labels(spark):
    for rows in ([], [(3, 1)], [(None, 0), (2, None)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
        got = line_rules.apply_rules(docs(spark, texts_of()), labels, states=True).collect()
        assert all(x.kept == (not x.base_failed) and all(x.line_content) for x in got)


def test_clashing_names(spark):
    df = docs(spark, texts_of()).withColumnsRenamed({"value": "kept", "blob": "content_share", "kind": "n_words"})
    got = line_rules.judge(df, line_rules.Field())
    assert got.columns == ["doc_id", "text", *line_rules.OUT] and got.count() == len(texts_of())


def test_query(spark, sf_dir):
    got = QUERIES["op12_line_rules"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").join(labels, "doc_id", "left").collect()
    assert len(rows) == 1000
    for x in rows:
        want = brute(x.text)
        assert tuple(x[c] for c in line_rules.COUNTS) == want and x.base_failed == failed(want)
        assert not (x.base_failed and x.kept)
    held = [x for x in rows if x.quality is not None and not x.base_failed and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean([x.kept == (x.quality == 1) for x in held]) > 0.95
