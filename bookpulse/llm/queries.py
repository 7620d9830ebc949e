"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bookpulse.llm import (
    chat, decontaminate, language_id, line_dedup, merkle, packing, quality_rules, ranked_search,
    simhash, spotsigs, token_files, tokens, url_filter, warc,
)
from bookpulse.llm.oracles import ORACLES
from bookpulse.session import stage, work_folder

__all__ = ["ORACLES", "QUERIES"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}/{uuid.uuid4().hex}"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), tokens.tokenizer_file())
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With conversation -7, whose texts hold the template's own control strings."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(rows.unionByName(own), chat.tokenizer_file())
    return chat.read_back(stage(formatted, "formatted"), chat.tokenizer_file())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "source", "text", "n_lines", "n_dropped")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), folder)
    found = warc.page_digests(warc.read_archives(spark, folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "tokens")
    token_files.write_token_files(_read(spark, sf_dir, "documents"), folder, tokens.tokenizer_file())
    return token_files.with_checksums(token_files.read_tokens(spark, folder))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With A-Z in lower case as tampering, where 5 divides the CRC-32 of the doc_id."""
    return merkle.manifest(_read(spark, sf_dir, "documents"), merkle.lower_cased())


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f for f in (
        op1_decontaminate, op2_url_filter, op3_spotsigs, op4_language_id, op5_packing, op6_chat_format,
        op7_line_dedup, op8_simhash, op9_warc, op10_token_files, op11_merkle, op12_quality_rules, op13_ranked_search,
        pipeline,
    )
}
