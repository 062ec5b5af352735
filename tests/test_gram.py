import numpy as np
import pytest

from flowquarry.operators import gram, profiling


@pytest.mark.parametrize("block,cells", [(64, 1 << 22), (3, 1 << 22), (3, 9)])
def test_correlations_equal_numpy(spark, monkeypatch, block, cells):
    monkeypatch.setattr(gram, "GROUP_CELLS", cells)  # the last case reads the table once per pair of blocks
    x = np.random.default_rng(3).normal(1e6, 1, (300, 8))
    x[:, 3] = x[:, 1] * 2 + 5
    x[:, 5] = 4.0
    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(5)
    found = gram.pair_correlations(df, names, x.mean(axis=0).tolist(), block).collect()
    assert {(r["i"], r["j"]) for r in found} == {(i, j) for i in range(8) for j in range(i, 8)}
    with np.errstate(invalid="ignore"):
        expected = np.corrcoef(x.T)
    for r in found:
        assert (r["feature1"], r["feature2"]) == (names[r["i"]], names[r["j"]])
        assert r["r"] == pytest.approx(expected[r["i"], r["j"]], nan_ok=True)


def test_matrix_is_mirrored(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0)], "a double, b double")
    rows = {(r["feature1"], r["feature2"]): r["r"] for r in profiling.correlation_matrix(df, ["a", "b"]).collect()}
    assert len(rows) == 4 and rows["a", "b"] == rows["b", "a"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1])
