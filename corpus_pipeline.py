"""The corpus pipeline: reject poor documents, fold copies and near copies, drop benchmark leaks, encode.

Each stage takes (spark, docs, sf_dir) and returns a frame; the next stage reads it from Parquet. All but the
last return the columns of ``documents``, for the documents that stay, also those whose names an operator uses itself.
Null texts count as empty; a null identifier is an identifier of its own that comes last; an empty table passes as such.
"""

from pyspark.sql import functions as F

from homestream.llm import decontaminate, exact, pieces, quality, simhash
from homestream.llm.common import table, written
from homestream.llm.queries import PIECE_BPE, tokenizer


def quality_classifier(spark, docs, sf_dir):
    """Documents with a quality score of 0.5 or more; learns from all labels outside the held-out fold.

    Decided row by row: empty texts by their score like any other, rows repeated whole alike.
    """
    # by number, so that no column of the table is taken for one of the classifier's
    name = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in name.items()])
    scored = quality.classify(rows, table(spark, sf_dir, "labels"), name["doc_id"], name["text"])
    return scored.filter(F.col("predicted") == 1).select(*[F.col(n).alias(c) for c, n in name.items()])


def exact_dedup(spark, docs, sf_dir):
    """One row of each group of texts that are equal but for white space: the one with the most code points, then the
    smallest identifier. Decided by identifier and text, so a repeated identifier loses no other text, and of a row
    repeated whole one stays. All empty texts are one group.
    """
    return exact.drop_duplicates(docs).select(docs.columns)


def near_dedup(spark, docs, sf_dir):
    """Five-word shingles, a similarity of 0.8 or more; of each group the document with the smallest identifier stays.

    Decided by identifier and text, as above. Texts without words are near each other and nothing else.
    """
    return simhash.drop_near_duplicates(docs, words=5).select(docs.columns)


def decontamination(spark, docs, sf_dir):
    """Documents without any ten consecutive words of a benchmark item, or a whole shorter item.

    Decided row by row: texts without words stay, copies go alike, ties don't arise.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def sentencepiece_encoding(spark, docs, sf_dir):
    """The columns of documents with n_tokens, ids_sha256 and decoded_sha256 in place of the text."""
    coded = pieces.encode_decode(docs, tokenizer(PIECE_BPE), keep=[c for c in docs.columns if c != "text"])
    return pieces.digest(coded)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: The classifier, the fingerprints and the encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
