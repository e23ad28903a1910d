"""Readers of the file formats that surveys, grids and models come in."""

from __future__ import annotations

import io
import json
import re
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.keys import blank

#: Samples: ids stay text, whatever they look like.
SAMPLES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("sample_id", "site_id", "group_id")]
    + [T.StructField("year", T.IntegerType()), T.StructField("season", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("m", "h", "habitat_suitability", "u_m", "u_h")]
    + [T.StructField("feasible", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("role", "m_artifact_id", "h_artifact_id")]
    + [T.StructField(n, T.DoubleType()) for n in ("target_protection", "target_restoration")]
)


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first line of a CSV, with repetitions kept."""
    first = spark.read.text(path).limit(1).collect()
    return next(iter(__import__("csv").reader([first[0]["value"]])), []) if first else []


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A CSV by the declared schema; columns are matched by name, unknown ones read as text, errors raised."""
    names = header(spark, path)
    if len(set(names)) != len(names):
        raise ValueError("a column name is repeated")
    known = {f.name: f for f in schema}
    full = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
    found = spark.read.schema(full).option("header", True).option("mode", "FAILFAST").csv(path)
    return found.select(*columns) if columns else found


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, SAMPLES)


def read_all_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose columns all stay text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_swd(spark: SparkSession, path: str, predictors: list[str], one_species: bool = False) -> DataFrame:
    """Samples with data: exact column order, then numbers by position."""
    expected = ["species", "longitude", "latitude", *predictors]
    if header(spark, path) != expected:
        raise ValueError(f"columns must be {expected}")
    schema = T.StructType([T.StructField("species", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in expected[1:]])
    found = read_csv(spark, path, schema)
    if one_species and found.where(~blank(F.col("species"))).select("species").distinct().limit(2).count() > 1:
        raise ValueError("more than one species")
    return found


def parse_ascii(text: str) -> tuple[dict[str, float], np.ndarray]:
    """Header and values (NaN for no data) of an ESRI ASCII grid."""
    lines = text.splitlines()
    head: dict[str, float] = {}
    while lines and re.match(r"\s*[A-Za-z_]+\s+\S+\s*$", lines[0]):
        key, value = lines.pop(0).split()
        head[key.lower()] = float(value)
    missing = {"ncols", "nrows", "cellsize"} - set(head)
    if missing or not ({"xllcorner", "yllcorner"} <= set(head) or {"xllcenter", "yllcenter"} <= set(head)):
        raise ValueError("incomplete grid header")
    values = np.array(" ".join(lines).split(), float)
    if values.size != int(head["ncols"]) * int(head["nrows"]):
        raise ValueError("the number of cells differs from the header")
    values = values.reshape(int(head["nrows"]), int(head["ncols"]))
    return head, np.where(values == head.get("nodata_value", -9999.0), np.nan, values)


def read_ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """(layer, row, col, x, y, value) of ESRI ASCII grids, plain or in ZIP archives, one file a task step."""
    schema = "layer string, row long, col long, x double, y double, value double"

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if name.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(body)) as z:
                        parts = [(n, z.read(n)) for n in z.namelist() if n.lower().endswith(".asc")]
                else:
                    parts = [(name, body)]
                for part, content in parts:
                    head, values = parse_ascii(content.decode())
                    size = head["cellsize"]
                    left = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - size / 2
                    low = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - size / 2
                    for row in range(values.shape[0]):
                        col = np.arange(values.shape[1])
                        y = low + (values.shape[0] - row - 0.5) * size
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([Path(part).stem] * len(col)), pa.array(np.full(len(col), row)), pa.array(col), pa.array(left + (col + 0.5) * size), pa.array(np.full(len(col), y)), pa.array(values[row], mask=np.isnan(values[row]))],
                            names=["layer", "row", "col", "x", "y", "value"],
                        )

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, schema)


def widen(layers: DataFrame, names: list[str]) -> DataFrame:
    """The wide cell table of a long layer table: one row a cell, one column a layer."""
    return layers.groupBy("row", "col").pivot("layer", names).agg(F.first("value"))


def read_numpy(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(row, col, name) of two-dimensional .npy files; NaN becomes NULL."""

    def run(batches):
        for batch in batches:
            for body in batch.column("content").to_pylist():
                values = np.load(io.BytesIO(body), allow_pickle=False)
                for row in range(values.shape[0]):
                    v = values[row].astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), row)), pa.array(np.arange(len(v))), pa.array(v, mask=np.isnan(v))], names=["row", "col", name])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"row long, col long, `{name}` double")


#: Rows of a coefficient file that are no features.
LAMBDA_NOTES = ("linearPredictorNormalizer", "densityNormalizer", "numBackgroundPoints", "entropy")


def read_lambdas(spark: SparkSession, path: str) -> DataFrame:
    """(path, feature, coefficient, low, high) of coefficient files, without the four notes."""
    lines = spark.read.text(path, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    parts = F.split("value", r",\s*")
    rows = lines.select("path", parts[0].alias("feature"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("coefficient"), F.try_element_at(parts, F.lit(3)).try_cast("double").alias("low"), F.try_element_at(parts, F.lit(4)).try_cast("double").alias("high"))
    return rows.where(~F.col("feature").isin(*LAMBDA_NOTES))


def complexity(lambdas: DataFrame) -> DataFrame:
    """(path, complexity): coefficients that are not zero."""
    return lambdas.groupBy("path").agg(F.count_if(F.col("coefficient") != 0).alias("complexity"))


def convergence(pages: DataFrame, text: str = "text") -> DataFrame:
    """How and when a fit ended, from its report page."""
    pattern = r"Algorithm (converged|terminated) after (\d+) iterations \((\d+) seconds\)"
    at = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return pages.withColumns({"outcome": at(1), "iterations": at(2).cast("int"), "seconds": at(3).cast("int")})


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def boundary_edges(spark: SparkSession, geojson: dict) -> DataFrame:
    """(x1, y1, x2, y2) of all rings of a GeoJSON polygon, multipolygon, feature or collection."""
    rows = []

    def rings(g: dict) -> None:
        kind = g.get("type")
        if kind == "FeatureCollection":
            for f in g["features"]:
                rings(f)
        elif kind == "Feature":
            rings(g["geometry"])
        elif kind in ("Polygon", "MultiPolygon"):
            for polygon in [g["coordinates"]] if kind == "Polygon" else g["coordinates"]:
                for ring in polygon:
                    rows.extend((float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(ring, ring[1:] + ring[:1]) if a != b)
        else:
            raise ValueError(f"no polygon: {kind}")

    rings(geojson)
    return spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
