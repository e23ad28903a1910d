"""op1: quality of `documents` under a model of those labelled good and not toxic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.kneser_ney import classify


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("id"))
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLE: dict[str, str] = {}
