"""One registered query per operator, over whole tables, with the operator's production parameters."""

from pyspark.sql import functions as F

from homestream.llm import (
    alignment, decontaminate, exact, language, line_rules, pieces, pii, quality, resample, secret_ledger, simhash,
    token_counts, token_files,
)
from homestream.llm.common import table

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer(name):
    """Where a public vocabulary file lies; the same on every executor."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find_pii(docs, keep=["doc_id"]))


def op2_secret_scan(spark, sf_dir):
    return secret_ledger.digest(secret_ledger.find_secrets(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, limit=4)


def op5_token_files(spark, sf_dir):
    docs = token_files.token_files(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))
    return docs.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), keep=["doc_id"])


def op7_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, keep=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, keep=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


def op9_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pieces.digest(pieces.encode_decode(docs, tokenizer(PIECE_BPE), keep=["doc_id"]))


def op10_decontamination(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_leaks(docs, benchmark, keep=["doc_id"]))


def op11_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), tokenizer(PIECE_BPE))


def op12_line_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return line_rules.apply_rules(docs, labels, keep=["doc_id"])


def op13_resample(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.resample(docs, benchmark, keep=["doc_id"]).drop("n_words")


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_secret_scan, op3_exact_dedup, op4_simhash, op5_token_files, op6_token_counts, op7_quality,
    op8_language, op9_sentencepiece, op10_decontamination,
    op11_alignment, op12_line_rules, op13_resample)}
