"""op3: quality rules of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.repetition import judge


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLE: dict[str, str] = {}
