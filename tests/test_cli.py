import csv
import json

import pytest

from cellweave.cli import main
from cellweave.operators.validate import ValidationError


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("d") / "demo"
    assert main(["demo", "--out", str(out)], spark)["rows"] == 480
    return out


def test_baseline(spark, demo, tmp_path):
    main(["baseline", "--csv", str(demo / "samples.csv"), "--out", str(tmp_path / "b"), "--method", "linear"], spark)
    rows = spark.read.option("header", True).csv(str(tmp_path / "b" / "scores"))
    assert rows.count() == 480 and {"conservation", "restoration", "eligible", "zone"} <= set(rows.columns)
    assert json.loads((tmp_path / "b" / "manifest.json").read_text())["method"] == "linear"
    with pytest.raises(FileExistsError):
        main(["baseline", "--csv", str(demo / "samples.csv"), "--out", str(tmp_path / "b")], spark)


def test_baseline_refuses_bad_rows(spark, demo, tmp_path):
    text = (demo / "samples.csv").read_text().splitlines()
    bad = tmp_path / "bad.csv"
    bad.write_text("\n".join([*text, text[1]]) + "\n")
    with pytest.raises(ValidationError, match="repeated"):
        main(["baseline", "--csv", str(bad), "--out", str(tmp_path / "x")], spark)
    assert not (tmp_path / "x").exists()


def test_train_and_predict(spark, demo, tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"epochs": 40}))
    args = ["train", "--csv", str(demo / "samples.csv"), "--provenance", str(demo / "provenance.json"), "--config", str(config)]
    with pytest.raises(ValidationError, match="demo"):
        main([*args, "--out", str(tmp_path / "no")], spark)
    report = main([*args, "--out", str(tmp_path / "t"), "--demo"], spark)
    tests = {r["target"]: r for r in report["metrics"] if r["role"] == "test"}
    assert tests["target_protection"]["n"] == 96 and tests["target_protection"]["rmse"] < 0.2
    common = ["predict", "--csv", str(demo / "samples.csv"), "--checkpoint", str(tmp_path / "t" / "gate.json")]
    with pytest.raises(ValidationError):
        main([*common, "--out", str(tmp_path / "p")], spark)
    main([*common, "--out", str(tmp_path / "p"), "--demo"], spark)
    read = lambda p: {r["sample_id"]: float(r["conservation"]) for r in spark.read.option("header", True).csv(str(p)).collect()}
    first, second = read(tmp_path / "t" / "predictions"), read(tmp_path / "p" / "predictions")
    assert max(abs(first[k] - second[k]) for k in first) < 1e-9 and len(first) == 480


@pytest.mark.parametrize("tamper, said", [("table", "audited"), ("leak", "leaks"), ("groups", "inconsistent")])
def test_train_refuses_tampering(spark, demo, tmp_path, tamper, said):
    declared = json.loads((demo / "provenance.json").read_text())
    if tamper == "table":
        declared["table_sha256"] = "0"
    elif tamper == "leak":
        declared["artifacts"]["m_without_g13"]["fit_sample_ids"].append("s13_00")
        declared["artifacts"]["m_without_g13"]["fit_group_ids"].append("g13")
    else:
        declared["artifacts"]["m_without_g13"]["fit_group_ids"].remove("g00")
    path = tmp_path / "p.json"
    path.write_text(json.dumps(declared))
    with pytest.raises(ValidationError, match=said):
        main(["train", "--csv", str(demo / "samples.csv"), "--provenance", str(path), "--out", str(tmp_path / "t"), "--demo"], spark)


def test_raster(spark, demo, tmp_path):
    layers = [x for n in ("m", "h", "feasible", "habitat_suitability") for x in (f"--{n.replace('_', '-')}", str(demo / f"{n}.asc"))]
    got = main(["raster", *layers, "--out", str(tmp_path / "r")], spark)
    assert got["valid_cells"] == 31 * 40 and got["zones"]["0"] == 40 and got["mask_disagreement"] == 0
    moved = tmp_path / "h.asc"
    moved.write_text((demo / "h.asc").read_text().replace("xllcorner 350000", "xllcorner 350050"))
    with pytest.raises(ValidationError, match="not_aligned"):
        main(["raster", *layers[:3], str(moved), *layers[4:], "--out", str(tmp_path / "s")], spark)
    assert not (tmp_path / "s").exists()


def plan_inputs(folder, **change):
    spec = {"distance_unit": "m", "fixed_half_saturation_constant": 0.5, "parameters": [{"key": "weight:urban", "low": 0.2, "high": 0.9, "evidence": "x"}, {"key": "distance:urban", "low": 500, "high": 2000, "evidence": "x"}, {"key": "habitat:1", "low": 0.1, "high": 0.4, "evidence": "x"}, {"key": "sensitivity:2:urban", "low": 0.0, "high": 0.5, "evidence": "x"}]}
    spec |= change.pop("spec", {})
    (folder / "prior.json").write_text(json.dumps(spec))
    with open(folder / "threats.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["threat", "max_dist", "weight", "decay", "cur_path", "base_path", "fut_path"])
        w.writerow(["urban", 1000, 0.5, change.pop("decay", "linear"), "u.asc", "", ""])
    (folder / "sensitivity.csv").write_text("lucode,name,habitat,urban\n1,water,0.9,0.2\n2,wood,0.5,0.7\n")
    (folder / "lulc.asc").write_text(f"ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 100\nNODATA_value -9999\n1 2\n{change.pop('code', '2')} -9999\n")
    return [x for n, f in (("prior", "prior.json"), ("threats", "threats.csv"), ("sensitivity", "sensitivity.csv"), ("lulc", "lulc.asc")) for x in (f"--{n}", str(folder / f))]


def test_invest_plan(spark, tmp_path):
    main(["invest-plan", *plan_inputs(tmp_path), "--out", str(tmp_path / "plan"), "--members", "8"], spark)
    threats = spark.read.parquet(str(tmp_path / "plan" / "threats"))
    assert threats.count() == 8 and threats.select("weight").distinct().count() == 8 and threats.where("weight NOT BETWEEN 0.2 AND 0.9 OR max_dist NOT BETWEEN 500 AND 2000").count() == 0
    table = spark.read.parquet(str(tmp_path / "plan" / "sensitivity"))
    assert table.count() == 16 and table.where("lucode = '1' AND habitat > 0.4").count() == 0 and table.where("lucode = '2' AND habitat <> 0.5").count() == 0 and table.where("lucode = '2' AND urban > 0.5").count() == 0
    assert spark.read.parquet(str(tmp_path / "plan" / "half_saturation")).where("half_saturation_constant = 0.5").count() == 8


@pytest.mark.parametrize("change", [{"code": "3"}, {"code": "1.5"}, {"decay": "cubic"}, {"spec": {"distance_unit": "km"}}, {"spec": {"fixed_half_saturation_constant": None}}, {"spec": {"parameters": [{"key": "weight:rail", "low": 0.1, "high": 0.2, "evidence": "x"}]}}, {"spec": {"parameters": [{"key": "weight:urban", "low": 0.9, "high": 0.2, "evidence": "x"}]}}])
def test_invest_plan_leaves_nothing_behind(spark, tmp_path, change):
    with pytest.raises(ValidationError):
        main(["invest-plan", *plan_inputs(tmp_path, **change), "--out", str(tmp_path / "plan")], spark)
    assert not (tmp_path / "plan").exists()


def test_calibration_rank(spark, tmp_path):
    rows = [f"{m},{f},{s},auc,1,inner_calibration_validation" for m, ss in (("a", (0.8, 0.81, 0.82)), ("b", (0.5, 0.51, 0.52))) for f, s in enumerate(ss)]
    path = tmp_path / "c.csv"
    path.write_text("\n".join(["member_id,fold,score,metric,higher_is_better,split_role", *rows]) + "\n")
    assert main(["calibration-rank", "--csv", str(path), "--out", str(tmp_path / "o")], spark)["best_member"] == "a"
    path.write_text(path.read_text().replace("inner_calibration_validation", "test", 1))
    with pytest.raises(ValidationError, match="inner"):
        main(["calibration-rank", "--csv", str(path), "--out", str(tmp_path / "p")], spark)
