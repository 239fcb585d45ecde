"""A corpus pipeline: each stage works on all that the one before it kept.

1. quality rules: documents that they reject go;
2. SimHash near-duplicates: one document of each class stays;
3. benchmark decontamination: contaminated documents go;
4. secret scans: every secret in a text is replaced by a marker;
5. SentencePiece: the texts' pieces, and whether they decode to the text.

Each stage's rows are written as Parquet and read again by the next.

Defined results: a null or empty text fails the quality rules, so it goes in the
first stage; texts of any length are judged, masked and segmented whole; repeated
rows (equal in every column) are one class, of which one stays, and of the documents
of a class the least doc_id stays (nulls last), then the least hash of the text, then
of the row; a score at the quality threshold stays, and so does a document just under
the share of hit words; a null doc_id is like any other but never trusted; other columns are
carried through the first four stages unchanged, whatever their names; empty tables
give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontaminate, frames, pieces, quality, secrets, simhash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, lossless (the ids decode to the text)."""
    return pieces.encode(docs, verify=True)


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_near_duplicates", one_of_each),
    ("benchmark_decontamination", uncontaminated),
    ("secret_scans", without_secrets),
    ("sentencepiece", segmented),
]

#: No statement: hashed n-grams, SimHash and the segmentation cannot be
#: expressed in SQL; tests compare every stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{frames.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
