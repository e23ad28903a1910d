"""op10: pseudonyms for the personal data in `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.pii import report

#: The key of the registered queries; a deployment passes its own secret.
KEY = b"a documented key for tests and benchmarks"


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), KEY).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_pii_pseudonyms": op10_pii_pseudonyms}
ORACLE: dict[str, str] = {}
