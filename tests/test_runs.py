import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cellweave.operators import runs

REPO = str(Path(__file__).resolve().parent.parent)

HALF = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from cellweave.operators import runs
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
ledger = runs.Ledger(spark, {folder!r}, {{"seed": 7}})

def make(k):
    if k == 2:
        spark.range(3).write.parquet({folder!r} + "/scopes/s2/table-0001")  # a table without its record
        os._exit(9)
    return spark.range(10).select((F.col("id") * k).alias("v"))

ledger.run({{f"s{{k}}": (lambda k=k: make(k)) for k in range(4)}})
"""


def scopes(spark, made):
    def make(k):
        made.append(k)
        return spark.range(10).select((F.col("id") * k).alias("v"))

    return {f"s{k}": (lambda k=k: make(k)) for k in range(4)}


def test_a_killed_run_is_taken_up_by_another_session(spark, tmp_path):
    folder = str(tmp_path / "run")
    done = subprocess.run([sys.executable, "-c", HALF.format(repo=REPO, folder=folder)], capture_output=True, timeout=200)
    assert done.returncode == 9
    with pytest.raises(runs.RunError, match="seed"):
        runs.Ledger(spark, folder, {"seed": 8})
    made = []
    waiting = runs.Ledger(spark, folder, {"seed": 7}).run(scopes(spark, made))
    assert waiting["s2"] is None and made == [3]  # the dead session's claim is within its lease
    with pytest.raises(runs.RunError, match="s2"):
        runs.union_of(waiting, "scope")
    ledger = runs.Ledger(spark, folder, {"seed": 7}, lease=0.0)
    got = runs.union_of(ledger.run(scopes(spark, made)), "scope")
    assert made == [3, 2] and len(ledger.attempts("s2")) == 2 and ledger.finished(["s0", "s2", "x"]) == {"s0", "s2"}
    whole = runs.union_of({s: f() for s, f in scopes(spark, []).items()}, "scope")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    spark.range(11).select(F.col("id").alias("v")).write.mode("overwrite").parquet(folder + "/scopes/s1/table-0001")
    with pytest.raises(runs.RunError, match="changed"):
        ledger.run(scopes(spark, made))


def test_failed_attempts_are_kept_and_made_again(spark, tmp_path):
    ledger = runs.Ledger(spark, str(tmp_path), {})
    with pytest.raises(ZeroDivisionError):
        ledger.run({"a/b": lambda: 1 // 0})
    assert ledger.run({"a/b": lambda: spark.range(2)})["a/b"].count() == 2
    assert len(ledger.attempts("a/b")) == 2


def test_only_one_session_wins_a_record(tmp_path):
    assert [runs.create(tmp_path / "r.json", k) for k in range(3)] == [True, False, False]
    assert runs.read(tmp_path / "r.json") == 0 and [p.name for p in tmp_path.iterdir()] == ["r.json"]


def test_locked_test_is_claimed_once(tmp_path):
    choice = {"classes": "LQ", "multiplier": 2.0}
    with pytest.raises(runs.RunError, match="frozen"):
        runs.claim_locked_test(str(tmp_path), choice, ["b"])
    first = runs.freeze(str(tmp_path), choice, {"auc": 0.7})
    assert runs.freeze(str(tmp_path), choice, {"auc": 0.7}) == first
    with pytest.raises(runs.RunError, match="another"):
        runs.freeze(str(tmp_path), choice | {"multiplier": 1.0}, {"auc": 0.7})
    with pytest.raises(runs.RunError, match="not the frozen"):
        runs.claim_locked_test(str(tmp_path), {}, ["b"])
    assert runs.claim_locked_test(str(tmp_path), choice, ["b", "a"])["groups"] == ["a", "b"]
    with pytest.raises(runs.RunError, match="already"):
        runs.claim_locked_test(str(tmp_path), choice, ["b"])
    runs.record_locked_result(str(tmp_path), {"auc": 0.6})
    assert runs.broken_links(str(tmp_path)) == []
    held = json.loads((tmp_path / "selection.json").read_text())
    (tmp_path / "selection.json").write_text(json.dumps(held | {"selection": {}}))
    assert runs.broken_links(str(tmp_path)) == ["selection"]
