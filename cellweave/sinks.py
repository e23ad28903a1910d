"""Checkpoints, tables, manifests and point layers written for other tools."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or a temporary folder where the session names none on one machine (tests); on a cluster it must be set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellweave-"))
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_new(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, **options) -> None:
    """Write a table; an error where the folder exists."""
    writer = df.write.mode("errorifexists").format(kind).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_csv(df: DataFrame, path: str, compressed: bool = False, digits: int | None = None) -> None:
    """CSV with a header; floating columns with `digits` significant digits where given."""
    if digits:
        shaped = {f.name: F.format_string(f"%.{digits}g", F.col(f"`{f.name}`")) for f in df.schema if f.dataType.typeName() in ("float", "double")}
        df = df.withColumns(shaped) if shaped else df
    write_new(df, path, "csv", header=True, **({"compression": "gzip"} if compressed else {}))


def write_swd(df: DataFrame, path: str, predictors: list[str]) -> None:
    """Samples with data: species, longitude, latitude, predictors, twelve significant digits."""
    write_csv(df.select("species", "longitude", "latitude", *predictors), path, digits=12)


def table_digest(df: DataFrame) -> str:
    """SHA-256 of a table as a set of rows: the hash of the sorted row hashes' sums.

    Rows are hashed where they are and summed in 4 parts of 64 bits, so nothing
    is collected and the order of rows has no effect.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    found = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return hashlib.sha256(json.dumps([str(v) for v in found]).encode()).hexdigest()


def file_digest(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def write_json(path: str | Path, value: object) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def geojson(points: DataFrame, longitude: str, latitude: str, properties: list[str]) -> DataFrame:
    """One feature a row as JSON text, to be written as lines; small layers are wrapped by `feature_collection`."""
    shape = F.struct(F.lit("Point").alias("type"), F.array(longitude, latitude).alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def feature_collection(features: list[str]) -> str:
    return '{"type": "FeatureCollection", "features": [' + ", ".join(features) + "]}"


def json_list(values: Column) -> Column:
    """A sorted array as JSON text with a space after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(values), lambda v: F.concat(F.lit('"'), v.cast("string"), F.lit('"'))), ", "), F.lit("]"))
