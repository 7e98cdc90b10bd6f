"""The named queries of this folder: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm import (
    chat_trie,
    decontaminate,
    license_rules,
    pii_disclosure,
    quality_llr,
    secret_owners,
    sentencepiece_table,
    simhash_trie,
    site_lines,
    tandem_runs,
    token_alignment,
    token_counts,
    warc,
)
from shelfspan.llm.common import checkpointed, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_owners.scan(table(spark, folder, "documents"))

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(n(kind) for kind in secret_owners.BASE),
        F.sha2(secret_owners.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_owners.span_text(F.col("spans")).alias("spans"),
        "n_copied",
        "n_live",
        "n_unclear",
    )


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(table(spark, folder, "documents"), path, limit=1024)


@query
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_table.digests(table(spark, folder, "documents"), path)


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ratio = quality_llr.fit(docs, table(spark, folder, "labels"))
    return docs.select("doc_id", quality_llr.verdict(F.col("text"), ratio).alias("q")).select("doc_id", "q.*")


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return site_lines.drop_furniture(docs, counts=("n_lines", "n_dropped"))


@query
def op9_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", license_rules.scan(F.col("text")).alias("found")).select("doc_id", "found.*")


@query
def op6_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return simhash_trie.near_duplicates(docs, size=3, budget=2).select("doc_id", "fingerprint", "component_id")


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    marked = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame(
        [(-7, 0, "user", marked), (-7, 1, "assistant", marked)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    read = chat_trie.read_back(*chat_trie.packed(rows))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark, "warc")
    files = checkpointed(warc.write(table(spark, folder, "pages"), archives, least_bytes=0))
    records = warc.read(files, archives).where("gap is null")
    return records.select(
        F.col("id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = token_alignment.alignment(table(spark, folder, "documents"), path_a, path_b)
    digest = F.when(F.col("groups_sha256") == "", F.lit("")).otherwise(F.col("groups_sha256"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return tandem_runs.periodic_runs(table(spark, folder, "documents"), plant=True)


@query
def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii_disclosure.scan(table(spark, folder, "documents"))

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(n(kind) for kind in pii_disclosure.BASE),
        F.sha2(pii_disclosure.span_text(F.col("base")), 256).alias("base_sha256"),
        pii_disclosure.span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == "linked")).cast("long").alias("n_linked"),
        F.length("sanitised").cast("long").alias("sanitised_chars"),
    )
