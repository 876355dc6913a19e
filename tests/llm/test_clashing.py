"""Tables whose other columns are named like anything an operator puts out, alone and through the stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from homestream.llm import (
    alignment, decontaminate, exact, language, line_rules, pieces, pii, quality, resample, secret_ledger, simhash,
    token_counts, token_files,
)
from homestream.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer
from tests.llm.test_operators import ODD

NAMES = ("n_bytes n_tokens over_limit score predicted held_out lang_pred ids decoded items longest n_words n_hit matches start kept keep_id "
         "group_size h fp first node root norm sha path run blob findings pii spans weight rank n_features n_a groups pair chunk doc").split()


@pytest.fixture(scope="module")
def table(spark):
    texts = ODD + ["the cat and the dog sat on the mat with a hat and a bat near the old red barn door today " * 3] * 2
    rows = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    return rows.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in NAMES}).cache()


def small(spark, kind):
    if kind == "labels":
        return spark.createDataFrame([(i, i % 2, "x") for i in range(14)], "doc_id bigint, quality int, score string")
    return spark.createDataFrame([("a", "the cat and the dog sat on the mat with a hat", "x")], "item_id string, text string, items string")


OPERATORS = {
    "pii": lambda s, d: pii.find_pii(d),
    "secrets": lambda s, d: secret_ledger.find_secrets(d),
    "exact": lambda s, d: exact.exact_duplicates(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "files": lambda s, d: token_files.token_files(d, tokenizer(BYTE_BPE)),
    "counts": lambda s, d: token_counts.count_tokens(d, tokenizer(BYTE_BPE)),
    "quality": lambda s, d: quality.classify(d, small(s, "labels")),
    "language": lambda s, d: language.predict(d),
    "pieces": lambda s, d: pieces.digest(pieces.encode_decode(d, tokenizer(PIECE_BPE))),
    "leaks": lambda s, d: decontaminate.find_leaks(d, small(s, "benchmark")),
    "alignment": lambda s, d: alignment.align(d, tokenizer(BYTE_BPE), tokenizer(PIECE_BPE)),
    "rules": lambda s, d: line_rules.apply_rules(d, small(s, "labels")),
    "resample": lambda s, d: resample.resample(d, small(s, "benchmark")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, table, name):
    """As many rows as without the other columns, and the same outputs."""
    plain = OPERATORS[name](spark, table.select("doc_id", "text", "lang"))
    out = [c for c in plain.columns if c not in ("doc_id", "text", "lang")]
    got = OPERATORS[name](spark, table)
    assert len(got.columns) == len({*got.columns})
    read = lambda df: sorted(map(str, df.select("doc_id", *out).collect()))
    assert read(got) == read(plain) and out


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage(spark, table, sf_dir, name, stage):
    """A stage returns the table's own columns, with what was in them."""
    got = stage(spark, table, sf_dir)
    assert got.columns == table.columns
    rows = {r.doc_id: r for r in table.collect()}
    assert all(r == rows[r.doc_id] for r in got.collect())
    assert stage(spark, table.limit(0), sf_dir).count() == 0
