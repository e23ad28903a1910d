import numpy as np
import pytest

from cellweave.operators import convolve, habitat, spatial


def plain(values, kernel):
    """Every value times every offset, added up."""
    r, out = kernel.shape[0] // 2, {}
    for (row, col), v in values.items():
        for i in range(-r, r + 1):
            for j in range(-r, r + 1):
                out[row + i, col + j] = out.get((row + i, col + j), 0.0) + v * kernel[i + r, j + r]
    return out


def scattered(seed, n=60, reach=70):
    rng = np.random.default_rng(seed)
    return {(int(r), int(c)): float(v) for r, c, v in zip(rng.integers(-reach, reach, n), rng.integers(-reach, reach, n), rng.random(n))}


@pytest.mark.parametrize("r", [0, 3, 12])
def test_tiles_with_halos_equal_the_plain_sum(spark, r):
    rng = np.random.default_rng(r)
    kernel, values = rng.random((2 * r + 1,) * 2), scattered(1)
    want = plain(values, kernel)
    frame = spark.createDataFrame([("a", *k, v / 2) for k, v in values.items()] * 2 + [("b", 0, 0, 5.0), ("other", 1, 1, 9.0)], "layer string, row long, col long, value double").repartition(4)
    at = [(i, j, f"{i}/{j}") for i in range(-90, 90, 3) for j in range(-90, 90)]
    got = convolve.convolved_at(frame, {"a": kernel, "b": np.ones((3, 3))}, spark.createDataFrame(at, "row long, col long, name string"), tile=16).collect()
    assert len(got) == len(at) and all(g.name == f"{g.row}/{g.col}" for g in got)
    for g in got:
        assert g.a == pytest.approx(want.get((g.row, g.col), 0.0), abs=1e-9) and g.b == pytest.approx(5.0 * (max(abs(g.row), abs(g.col)) <= 1), abs=1e-9)
        assert (g.row, g.col) in want or g.a == 0.0
    every = convolve.convolved(frame.where("layer = 'a'"), kernel, ["layer"], "value", "sum", tile=16).collect()
    assert {(e.row, e.col) for e in every} == set(want) and all(e["sum"] == pytest.approx(want[e.row, e.col], abs=1e-9) for e in every)


def test_long_reach_copies_cells_a_few_times(spark):
    values = spark.createDataFrame([(r, c) for r in range(0, 600, 7) for c in range(0, 600, 7)], "row long, col long")
    dealt = convolve.with_halo(values, convolve.side(100), 100)
    assert dealt.count() <= 4 * values.count()


def test_degradation_equals_the_spread_of_each_source(spark):
    rng = np.random.default_rng(6)
    cells = [(r, c, int(rng.integers(1, 4)), float(rng.random() < 0.2), float(rng.random())) for r in range(25) for c in range(30)]
    threats = [("urban", 700.0, 0.7, "linear"), ("light", 1100.0, 0.3, "exponential")]
    sensitivity = {1: (0.9, 0.4, 0.6), 2: (0.5, 1.0, 0.2)}
    found = habitat.degradation(spark.createDataFrame(cells, "row int, col int, lucode int, urban double, light double"), threats, spark.createDataFrame([(k, *v) for k, v in sensitivity.items()], "lucode int, habitat double, urban double, light double"))
    loads = []
    for k, (_, far, weight, decay) in enumerate(threats):
        offsets = habitat.decay_offsets(far, decay, 100.0)
        scale, out = sum(s for *_, s in offsets), {}
        for cell in cells:
            for r, c, s in offsets if cell[3 + k] > 0 else ():
                out[cell[0] + r, cell[1] + c] = out.get((cell[0] + r, cell[1] + c), 0.0) + cell[3 + k] * s / scale * weight
        loads.append(out)
    got = {(r.row, r.col): r.degradation for r in found.collect()}
    assert len(got) == len(cells)
    for r, c, code, *_ in cells:
        want = sum(loads[k].get((r, c), 0.0) * sensitivity[code][k + 1] for k in range(2)) if code in sensitivity else 0.0
        assert got[r, c] == pytest.approx(want, abs=1e-9)


def test_smoothing_keeps_the_mass_of_each_key(spark):
    values = spark.createDataFrame([("x", 0, 0, 1.0), ("x", 300, -40, 2.0), (None, 5, 5, 3.0)], "k string, row long, col long, value double")
    got = spatial.smooth(values, 5.0, ["k"]).groupBy("k").sum("density").collect()
    assert {r.k: pytest.approx(r["sum(density)"]) for r in got} == {"x": 3.0, None: 3.0}
