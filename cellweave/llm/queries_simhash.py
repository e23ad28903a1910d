"""op7: SimHash near-duplicates of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.simhash import simhash_classes


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = simhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classed.select(F.col("id").alias("doc_id"), "fingerprint", F.col("class_id").alias("component_id"))


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
ORACLE: dict[str, str] = {}
