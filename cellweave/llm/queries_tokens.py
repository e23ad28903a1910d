"""op4 (packing) and op6 (token files) of `documents`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import token_files
from cellweave.llm._base import checkpointed, shared_dir
from cellweave.llm.packing import pack


def vocabulary(name: str) -> str:
    """Where the machine keeps a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), slice_bytes=8 << 20, cache=400_000)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), folder)
    found = token_files.read(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    found = checkpointed(found)  # the files served this result only
    token_files.Folder(folder).delete()
    return found


QUERIES = {"op4_packing": op4_packing, "op6_token_files": op6_token_files}
ORACLE: dict[str, str] = {}
