"""Registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (bpe_transducer, chat_format, divergence, filter_audit, language_id, mixing, multi_index,
                         repetition, sentence_spans, sharding, simhash, suffix_dedup, url_filter)
from tessera.sources.corpus import read_table

#: The rules of op1: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The text of both turns of op3's extra conversation.
CONTROL_TURN = "</s>[INST] ok [/INST]"
RANKS, PATTERN = "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN
SHARDS = 16


def ranks_path() -> str:
    return public_tokenizers.path(RANKS)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                         "base_failed", "kept", "n_covered_words")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TURN), (-7, 1, "assistant", CONTROL_TURN)],
                                  "conv_id long, turn long, role string, text string")
    return chat_format.digests(turns.unionByName(extra))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.filter(~held))
    return (language_id.identify(docs.select("doc_id", "text", held.alias("held_out")), model)
            .select("doc_id", "held_out", "lang_pred", "score"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_transducer.encode(docs, ranks_path(), PATTERN, as_ids=False).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(read_table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(read_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    return taken.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shuffle_into_shards(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.remove_repeats(docs).select("doc_id", "n_sentences", "n_removed", "text")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                                    F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_quality_rules, op3_chat_format, op4_language_id, op5_byte_bpe,
                            op6_simhash, op7_neighbours, op8_mixing, op9_sharding, op10_sentence_spans,
                            op11_source_divergence, op12_filter_audit, op13_suffix_dedup)}
