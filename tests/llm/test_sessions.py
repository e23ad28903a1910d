import random

import pytest

from cellweave.llm import sessions as ss


def brute(events, gap):
    """Every version, by building the state after each batch from all events so far."""
    out, users = [], {u for u, t, b, _ in events if u is not None and t is not None and b is not None}
    for user in users:
        mine = sorted((t, b, v or 0) for u, t, b, v in events if u == user and t is not None and b is not None)
        versions, standing = [], []
        for batch in sorted({b for _, b, _ in mine}):
            runs = []
            for e in (e for e in mine if e[1] <= batch):
                if runs and e[0] - runs[-1][-1][0] <= gap:
                    runs[-1].append(e)
                else:
                    runs.append([e])
            for run in runs:
                new = sum(b == batch for _, b, _ in run)
                if not new:
                    continue
                row = {"user": user, "batch": batch, "start": run[0][0], "end": run[-1][0], "n_events": len(run), "n_new": new, "total": sum(v for _, _, v in run), "by": None}
                inside = [s for s in standing if row["start"] <= s["start"] and s["end"] <= row["end"]]
                for s in inside:
                    s["by"] = row
                standing = [s for s in standing if s not in inside] + [row]
                versions.append(row | {"n_retracted": len(inside), "self": row})
        for v in versions:
            by = v["self"]["by"]
            out.append((user, v["batch"], v["start"], v["end"], v["n_events"], v["n_new"], v["n_retracted"], v["total"], by and by["batch"], by and by["start"]))
    return sorted(out, key=str)


def check(spark, events, gap):
    frame = spark.createDataFrame([(*e, 1, "x") for e in events], "who long, at long, lot long, worth long, n long, first string").repartition(3)
    got = ss.merge_sessions(frame, "who", "at", "lot", gap, "worth")
    assert got.columns == ["user", "batch", "start", "end", "n_events", "n_new", "n_retracted", "total", "retracted_batch", "retracted_start"]
    assert {t for n, t in got.dtypes} == {"bigint"}
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == brute(events, gap)
    return rows


def test_against_brute_force(spark, monkeypatch):
    """Random users; users with nearly all rows whose sessions pass many slots, extended forwards, backwards and by bridges; nulls."""
    monkeypatch.setattr(ss, "SLOT_GAPS", 2)
    rng = random.Random(5)
    events = []
    for user in range(30):
        reach = rng.choice([30, 200, 600])
        events += [(user, rng.randrange(-20, reach), rng.randrange(1 + rng.randrange(8)), rng.randrange(100)) for _ in range(rng.randrange(1, 60))]
    events += events[::7]
    events += [(101, 9 * k, k, 1) for k in range(60)]
    events += [(102, 9 * k, 60 - k, 1) for k in range(60)]
    events += [(103, 9 * k, 0 if k % 2 else (k * 37) % 11 + 1, 1) for k in range(150)]
    events += [(104, 5, 0, None), (104, 5, 0, 3), (None, 5, 0, 1), (104, None, 0, 1), (104, 5, None, 1), (104, 16, 1, 2), (104, 15, 2, 2)]
    rows = check(spark, events, 10)
    assert sum(r[0] == 104 for r in rows) == 3


def test_empty_and_refused(spark):
    assert check(spark, [], 10) == []
    with pytest.raises(ValueError):
        ss.merge_sessions(spark.createDataFrame([], "user long, time long, batch long"), gap=0)


def test_plan_is_sql_only(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "user long, time long, batch long")
    plan = ss.merge_sessions(frame, gap=5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
