"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fill_middle, filter_audit, fingerprint, html_text, langid, near_dedup, packing, passages, secret_scan, tokens, toxicity
from .common import table

VOCABULARY = "word_bpe_49k.json"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_tricky(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return chat.digest(chat.format_conversations(turns))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(VOCABULARY))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(spark, table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(spark, table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(VOCABULARY))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(spark, table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text")))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_minhash_near_dedup, op3_chat_formatting, op4_substring_dedup, op5_html_extraction, op6_packing, op7_document_fingerprints, op8_language_id, op9_toxicity, op10_token_counts, op11_fill_in_middle, op12_filter_interaction_audit, op13_secret_scans)}
ORACLES = {"op3_chat_formatting": chat.ORACLE, "op11_fill_in_middle": fill_middle.ORACLE, "op12_filter_interaction_audit": filter_audit.ORACLE, "op13_secret_scans": secret_scan.ORACLE}
