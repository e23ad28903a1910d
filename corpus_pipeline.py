"""A corpus pipeline over `documents`: quality rules, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of `documents`.  `run` writes each stage's result as Parquet
under the shared folder and reads it again for the next stage, so a lost
executor costs a stage's tasks and no earlier stage.

Defined results are those of the operators: null and empty texts fail the
quality rules; of near-duplicates the smallest id stays (one without an id
only where no member has one), and different texts that share an id all stay; equal values get equal pseudonyms; a document that the mixture
takes several times is repeated; an empty table passes through to no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm._base import shared_dir
from cellweave.llm.mixing import materialise, mix
from cellweave.llm.packing import pack
from cellweave.llm.pii import pseudonymise
from cellweave.llm.queries_pii import KEY
from cellweave.llm.queries_tokens import vocabulary
from cellweave.llm.repetition import filter_documents
from cellweave.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymise(docs, KEY)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return materialise(docs, mix(docs, digest=True))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small slices and cache: earlier stages have grown the executors' heaps to the full."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), slice_bytes=2 << 20, cache=100_000).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixture", source_mixture),
    ("packed_sequences", packed_sequences),
]

#: SQL cannot express near-duplicate links or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
