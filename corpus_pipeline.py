"""A training corpus from raw documents, in five stages.

Each stage takes all that the one before it kept: documents predicted toxic
go, of equal texts one stays, of near copies one stays, the sources are mixed
to their target weights, and what is left is encoded to ids and decoded.
Between two stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabforge.llm.block_naming import drop_exact_duplicates
from tabforge.llm.common import materialize, table
from tabforge.llm.mixing import mixed_documents
from tabforge.llm.piece_bpe import encode_documents, with_digests
from tabforge.llm.queries import model_path
from tabforge.llm.simhash_bk import drop_near_duplicates
from tabforge.llm.weak_supervision import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, words_per_shingle=3, radius=3)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = with_digests(encode_documents(docs, model_path()))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("source_mix", source_mix), ("encoding", encoding)]

# A trained classifier, fingerprints and BPE are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
