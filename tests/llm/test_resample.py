"""Importance resampling against a plain loop over the definition."""

import hashlib
import math
import random
import re
import zlib

import pytest

from homestream.llm import resample
from homestream.llm.queries import QUERIES
from tests.llm.test_operators import ODD, docs, empty


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def features(text):
    w = words_of(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target, least=20, share=25):
    """{row number: (n_features, weight, score, rank)}"""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features(text):
                counts[f] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out, keys = {}, []
    for n, (i, text) in enumerate(rows):
        f = features(text)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[n] = [len(f), weight, score, None]
        if len(words_of(text)) >= least:
            keys.append((-score, i is None, i or 0, len(f), n))
    for rank, key in enumerate(sorted(keys)[:len(keys) * share // 100], 1):
        out[key[-1]][3] = rank
    return out


def test_resample(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "The", "a1"]
    texts = ODD + [" ".join(r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(600)] + ["w1 " * 50_000]
    rows = [(None if n % 97 == 5 else n % 500, t) for n, t in enumerate(texts)]    # null and repeated identifiers
    rows += rows[20:40]                                                            # rows repeated whole
    target = [" ".join(r.choices(vocabulary[:40], k=30)) for _ in range(50)] + [None, ""]
    frame = spark.createDataFrame([(i, t, n, "x", "y") for n, (i, t) in enumerate(rows)],
                                  "doc_id bigint, text string, n int, score string, rank string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    want = brute(rows, target)
    for few in (3, 10_000):       # 3: the rounds go to the end
        got = resample.drawn(resample.scored(frame, bench, keep=["doc_id", "n"]), few=few).collect()
        assert len(got) == len(rows)
        assert {x.n: (x.n_features, x.weight, x.score) for x in got} == {n: tuple(v[:3]) for n, v in want.items()}
        ranks = sorted((x.rank, x.score, x.doc_id, x.n_features) for x in got if x.rank)
        assert ranks == sorted((v[3], v[2], rows[n][0], v[0]) for n, v in want.items() if v[3])
    assert {c for c in resample.resample(frame, bench).columns} == {"doc_id", "text", "n", *resample.OUT, "rank"}


def test_resample_edges(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(empty(spark), none).count() == 0
    got = resample.resample(docs(spark, ODD), none, keep=["doc_id"]).collect()
    assert len(got) == len(ODD) and sum(x.rank is not None for x in got) == 0      # a quarter of one text
    assert {x.weight for x in got if not x.n_features} == {0}
    same = docs(spark, ["one two " * 15] * 9).selectExpr("5L AS doc_id", "text")
    assert sorted(x.rank for x in resample.resample(same, none).collect() if x.rank) == [1, 2]


def test_weighted_median():
    r = random.Random(1)
    for _ in range(200):
        parts = [sorted(r.choices(range(50), k=r.randint(1, 40))) for _ in range(r.randint(1, 9))]
        pivot = resample.weighted_median([(p[(len(p) - 1) // 2], len(p)) for p in parts])
        keys = sorted(sum(parts, []))
        # a quarter on either side, the pivot counted on both
        assert 4 * sum(k <= pivot for k in keys) >= len(keys) and 4 * sum(k >= pivot for k in keys) >= len(keys)


def test_cutoff(spark):
    r = random.Random(2)
    keys = sorted((r.randint(-9, 9), r.randint(0, 5), r.randint(0, 3)) for _ in range(500))
    table = spark.createDataFrame(r.sample(keys, len(keys)), "_k0 bigint, _k1 bigint, _k2 bigint").repartition(4)
    for wanted in (1, 2, 250, 499, 500):
        assert resample.cutoff(table, wanted, few=2) == keys[wanted - 1]


@pytest.mark.parametrize("name", ["op13_resample"])
def test_query(spark, sf_dir, name):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [x.text for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    want = {rows[n][0]: tuple(v) for n, v in brute(rows, target).items()}
    got = QUERIES[name](spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {x.doc_id: tuple(x)[1:] for x in got.collect()} == want
