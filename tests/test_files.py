"""Readers, writers and the streaming extension, on files of every kind."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import sinks
from cellweave.operators import provenance, spatial, validate
from cellweave.sources import files
from cellweave.streaming.visits import streaming_visits

GRID = "ncols 3\nnrows 2\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -9999\n1 2 3\n4 -9999 0\n"


def test_samples_keep_ids_as_text(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("sample_id,site_id,group_id,year,season,m,h,habitat_suitability,u_m,u_h,feasible,extra\n007,01,g,2020,spring,0.5,0.1,0.2,0,0,1,x\n")
    row = files.read_samples(spark, str(path)).first()
    assert (row.sample_id, row.site_id, row.m, row.extra) == ("007", "01", 0.5, "x")
    path.write_text("sample_id,sample_id\n1,2\n")
    with pytest.raises(ValueError, match="repeated"):
        files.read_samples(spark, str(path))
    path.write_text("sample_id,m\n1,not a number\n")
    with pytest.raises(Exception):
        files.read_samples(spark, str(path)).collect()


def test_swd(spark, tmp_path):
    frame = spark.createDataFrame([("a", 111.123456789012345, 34.5, 1.0), ("a", 112.0, 35.0, -9999.0)], "species string, longitude double, latitude double, x double")
    sinks.write_swd(frame.coalesce(1), str(tmp_path / "swd"), ["x"])
    back = files.read_swd(spark, str(tmp_path / "swd"), ["x"], one_species=True)
    assert back.orderBy("longitude").first().longitude == pytest.approx(111.123456789, abs=1e-8)
    found = {r.rule: r.n_violations for r in validate.swd_violations(back, ["x"]).collect()}
    assert found["x_no_data"] == 1 and found["blank_species"] == 0
    with pytest.raises(ValueError, match="columns"):
        files.read_swd(spark, str(tmp_path / "swd"), ["y"])


def test_ascii_grids_plain_and_zipped(spark, tmp_path):
    (tmp_path / "a.asc").write_text(GRID)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("in/b.asc", GRID)
    cells = files.read_ascii_grids(spark, str(tmp_path))
    got = {(r.layer, r.row, r.col): (r.x, r.y, r.value) for r in cells.collect()}
    assert len(got) == 12 and got["a", 0, 0] == (105.0, 215.0, 1.0) and got["b", 1, 1][2] is None and got["b", 1, 2][2] == 0.0
    wide = files.widen(cells, ["a", "b"])
    assert wide.count() == 6 and wide.where("a = b").count() == 5
    with pytest.raises(ValueError, match="number of cells"):
        files.parse_ascii(GRID + "5\n")
    with pytest.raises(ValueError, match="header"):
        files.parse_ascii("ncols 2\nnrows 1\n1 2\n")


def test_numpy_lambdas_and_reports(spark, tmp_path):
    buffer = io.BytesIO()
    np.save(buffer, np.array([[1.0, np.nan], [3.0, 4.0]], np.float32))
    (tmp_path / "v.npy").write_bytes(buffer.getvalue())
    assert {(r.row, r.col, r.v) for r in files.read_numpy(spark, str(tmp_path / "v.npy"), "v").collect()} == {(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)}
    (tmp_path / "m.lambdas").write_text("a, 1.5, 0.0, 2.0\nb, 0.0, 0.0, 1.0\na^2, -0.5, 0.0, 4.0\nlinearPredictorNormalizer, 3.0\nentropy, 7.1\n")
    assert files.complexity(files.read_lambdas(spark, str(tmp_path / "m.lambdas"))).first().complexity == 2
    pages = spark.createDataFrame([("x Algorithm converged after 120 iterations (4 seconds). y",), ("Algorithm terminated after 500 iterations (61 seconds)",), ("nothing",)], "text string")
    assert [(r.outcome, r.iterations, r.seconds) for r in files.convergence(pages).collect()] == [("converged", 120, 4), ("terminated", 500, 61), (None, None, None)]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0.123456789012345, "a"), (2, None, "b")], "id int, v double, s string")
    sinks.write_csv(frame.coalesce(1), str(tmp_path / "c"), compressed=True, digits=10)
    assert float(spark.read.option("header", True).csv(str(tmp_path / "c")).where("id = 1").first().v) == 0.123456789
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_csv(frame, str(tmp_path / "c"))
    assert sinks.table_digest(frame) == sinks.table_digest(frame.orderBy(F.desc("id")).repartition(3)) != sinks.table_digest(frame.limit(1))
    features = [r.value for r in sinks.geojson(spark.createDataFrame([(111.0, 34.0, "p")], "lon double, lat double, name string"), "lon", "lat", ["name"]).collect()]
    assert json.loads(sinks.feature_collection(features))["features"][0]["geometry"]["coordinates"] == [111.0, 34.0]
    lists = spark.createDataFrame([(["c2", "c1"],)], "v array<string>").select(sinks.json_list(F.col("v")).alias("j"))
    assert lists.first().j == '["c1", "c2"]'


def test_provenance_rules(spark):
    samples = spark.createDataFrame([("1", "g1", "a"), ("2", "g2", "a")], "sample_id string, group_id string, artifact string")
    foot = spark.createDataFrame([("a", "fit", "sample", "2"), ("a", "tune", "group", "g1"), ("a", "fit", "sample", "9")], "artifact string, stage string, kind string, id string")
    assert {(r.kind, r.n_leaks) for r in provenance.leaks(samples, foot).collect()} == {("sample", 1), ("group", 1)}
    row = provenance.footprint_consistency(samples, foot).first()
    assert (row.n_unknown_samples, row.n_groups_not_declared) == (1, 1)
    g = lambda *v: spark.createDataFrame([(x,) for x in v], "group_id string")
    assert {r.rule: r.n_violations for r in provenance.group_exclusion(g("a", "b"), g("b", "c"), g("c", "d")).collect()} == {"predicted_used": 1, "used_locked": 1}
    assert {r.side: r.n for r in provenance.set_difference(g("a", "b"), g("b", "c", "d"), ["group_id"]).collect()} == {"left_only": 1, "right_only": 2}
    outputs = spark.createDataFrame([("p", "1", False), ("q", "2", False), ("r", "3", True)], "path string, sha256 string, present boolean")
    assert [r.path for r in provenance.unreceipted(outputs, spark.createDataFrame([("p", "1"), ("q", "9")], "path string, sha256 string")).collect()] == ["q"]
    events = spark.createDataFrame([("e1", "s1")], "event_id string, source string")
    ledger = spark.createDataFrame([("r1", "s1"), ("r2", "s2")], "record_id string, source string")
    links = spark.createDataFrame([("e1", "r1"), ("e1", "r2"), ("e9", "r1")], "event_id string, record_id string")
    assert {r.rule: r.n_violations for r in provenance.link_violations(events, links, ledger).collect()} == {"unknown_event": 1, "unknown_record": 0, "different_source": 1, "record_linked_twice": 1}


def test_tiles(spark):
    cells = spatial.tile(spark, 5, 4)
    assert cells.count() == 20 and spatial.decimate(cells, 2).count() == 6
    assert cells.select(spatial.block_row(2).alias("b")).distinct().count() == 2


def test_streaming_counts_each_event_once(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "e1", 1), ("2024-01-01 00:05:00", "e1", 1), ("2024-01-01 00:10:00", "e2", 1), ("2024-01-01 00:20:00", "e3", 2), ("2024-03-20 00:00:00", "e9", 9)]
    batch = spark.createDataFrame(rows, "t string, event string, cell long").select(F.to_timestamp("t").alias("t"), "event", "cell")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = streaming_visits(stream, "t", "event", "cell").writeStream.format("memory").queryName("visits").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.cell, r.visits) for r in spark.table("visits").collect()}
    assert got == {(1, 2), (2, 1)}
