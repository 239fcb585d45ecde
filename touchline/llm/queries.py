"""Registered queries of this subpackage, and their DuckDB statements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import (
    chat, collocations, decontaminate, frames, licenses, oracle, pieces, pii, quality, secrets,
    sharding, simhash, substrings, warc, whitening)

SHARDS = [f"shard-{i:03d}" for i in range(256)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, slot, shard = sharding.place(
        table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)
    return placed.select("doc_id", slot, shard)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(substrings.drop_repeats(table(spark, sf_dir, "documents")))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(pieces.decode(pieces.encode(table(spark, sf_dir, "documents"))))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{frames.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.report(warc.read(spark, folder))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(chat.format_chats(turns.unionByName(chat.probe(spark))))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.find_notices(table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_sharding, op3_simhash, op4_substrings, op5_pieces, op6_warc,
    op7_secrets, op8_pii, op9_quality, op10_chat,
    op11_licenses, op12_whitening, op13_collocations)}

#: The others have hashes, models or tables that SQL does not; tests compare
#: them with plain versions.
ORACLE = {
    "op1_decontaminate": oracle.CONTAMINATION,
    "op4_substrings": oracle.REPEATS,
    "op6_warc": oracle.ARCHIVE,
    "op7_secrets": oracle.SECRETS,
    "op10_chat": oracle.CHATS,
    "op11_licenses": oracle.LICENSES,
    "op13_collocations": oracle.PHRASES,
}
