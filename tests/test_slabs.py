"""Slabs of any height give what the whole volume gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import raster as R
from voxelweave.operators import slabs as S
from voxelweave.operators.grid import Grid
from voxelweave.operators.raster import Raster

GRID = Grid((11, 8, 9), (-2, 3, 1))


def volumes(seed=0, share=0.45):
    rng = np.random.default_rng(seed)
    snake = np.zeros(GRID.shape, np.int32)
    snake[:, 1, 1] = snake[-1, 1:7, 1] = snake[:, 6, 1] = snake[0, 6, 1:8] = snake[:, 6, 7] = 5  # up and down through every seam
    snake[4:6, 3, 4] = 1
    return {"noise": (rng.random(GRID.shape) < share) * rng.integers(1, 90, GRID.shape), "snake": snake, "one": np.pad(np.ones((1, 1, 1), int), [(9, 1), (4, 3), (8, 0)]), "thick": np.pad(np.ones((9, 6, 7), int), 1)}


def voxels(spark, arrays):
    rows = [(n, *(int(c + o) for c, o in zip(p, GRID.origin)), int(a[tuple(p)])) for n, a in arrays.items() for p in np.argwhere(a)]
    return spark.createDataFrame(rows + [("noise", 99, 3, 1, 7)], "vol_id string, z int, y int, x int, v int")  # one outside of the grid


def rows(df):
    return sorted((r.vol_id, r.z, r.y, r.x, r.v) for r in df.collect())


def want(arrays, kernel):
    out = []
    for n, a in arrays.items():
        r = kernel(Raster(a.astype(np.int32), GRID.origin))
        out += [(n, *(int(c + o) for c, o in zip(p, r.origin)), int(r.data[tuple(p)])) for p in np.argwhere(r.data)]
    return sorted(out)


@pytest.mark.parametrize("height", [1, 3, 4, 100])
def test_labels_and_sizes(spark, height):
    arrays = volumes()
    v = voxels(spark, arrays)
    assert rows(S.labels(v, GRID, height)) == want(arrays, lambda r: Raster(R.label(r.on, R.SIX)[0], r.origin))
    if height == 3:
        assert rows(S.keep_sizes(v, GRID, 2, 40, height=height)) == want(arrays, lambda r: R.keep_sizes(r, 2, 40))
        for join in (False, True):
            assert rows(S.keep_ranks(v, GRID, 1, 3, join, height=height)) == want(arrays, lambda r: R.keep_ranks(r, 1, 3, join))
        table = S.components(v, GRID, height)
        assert {(r.label, r.n) for r in table.sizes().where("vol_id = 'snake'").collect()} == {(1, int((arrays["snake"] == 5).sum())), (2, 2)}


def test_rounds_of_stars_contract_like_one_task(spark):
    rng = np.random.default_rng(3)
    pairs = [(v, int(a), int(b)) for v, n in (("a", 60), ("b", 200)) for a, b in rng.integers(0, n, (n // 2, 2))] + [("chain", k, k + 1) for k in range(40)]
    df = spark.createDataFrame(pairs, "vol_id string, a long, b long")
    one, many = (sorted(map(tuple, S.contracted(df, t).collect())) for t in (10**6, 0))
    assert one == many and {r for v, i, r in one if v == "chain"} == {0}


@pytest.mark.parametrize("height", [1, 4])
def test_morphology_and_smoothing(spark, height):
    arrays = volumes(5, 0.8)
    v = voxels(spark, arrays)
    assert rows(S.erode(v, GRID, 2, height)) == want(arrays, lambda r: R.erode(r, 2))
    assert rows(S.dilate(v, GRID, 2, (1, 0, 1), height)) == want(arrays, lambda r: R.dilate(r, 2, (1, 0, 1)))
    assert rows(S.close(v, GRID, 1, (1, 1, 0), height)) == want(arrays, lambda r: R.close(r, 1, (1, 1, 0)))
    if height == 4:
        assert rows(S.open_(v, GRID, 1, height)) == want(arrays, lambda r: R.open_(r, 1))
        assert rows(S.gauss(v, GRID, height=height)) == want(arrays, lambda r: Raster(R.gauss(r.data, 2.0, 3).astype(np.int32), r.origin))
        assert rows(S.gauss_band(v, GRID, 10, 30, height=height)) == want(arrays, lambda r: R.gauss_band(r, 2.0, 3, 10, 30))


def test_a_task_holds_its_slab_and_halo_only(spark):
    """The kernel's arrays do not grow with the volume's height."""

    def measured(grid):
        def kernel(r):
            return Raster(np.full_like(r.data, r.data.shape[0]), r.origin)

        v = spark.range(grid.shape[0]).select(F.lit("a").alias("vol_id"), F.col("id").cast("int").alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(1).alias("v"))
        return max(r.v for r in S.by_slabs(v, grid, kernel, 3, 5).collect())

    assert measured(Grid((40, 2, 2))) == measured(Grid((400, 2, 2))) == 5 + 2 * 3


def test_no_voxels(spark):
    none = spark.createDataFrame([], "vol_id string, z int, y int, x int, v int")
    assert S.labels(none, GRID).count() == 0 and S.erode(none, GRID, 1).count() == 0
    with pytest.raises(ValueError):
        S.gauss_band(none, GRID, -1, 1)
    with pytest.raises(ValueError):
        S.keep_ranks(none, GRID, 0, 1)
