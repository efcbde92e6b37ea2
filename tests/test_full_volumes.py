"""Volumes with nothing sparse: full after inversion, without bone, without background."""

import os

import duckdb
import numpy as np
import pytest

from voxelweave.operators import grid as G
from voxelweave.operators import whole as W
from voxelweave.plans import catalog
from voxelweave.plans import catalog_files  # noqa: F401  (registers its queries)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
LIKE_SQL = ("cascade_grids", "chamfer_dt", "erosion_1", "erosion_3", "erosion_3_kernel", "open_1_kernel", "open_1_mirror", "invert_mask")


@pytest.fixture(scope="module")
def even(tmp_path_factory):
    """A volume of the driver's line items, one of nearly even values (no voxel above 1.6 of the mean) and one of equal values."""
    folder = str(tmp_path_factory.mktemp("even"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW li AS SELECT * FROM '{SF}/lineitem.parquet' WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
    lattice = "SELECT z.range AS l_orderkey, y.range AS l_partkey, x.range + 17 AS l_suppkey, 1 AS l_linenumber, {} AS l_quantity, 'Z' AS l_returnflag, '{}' AS l_linestatus FROM range(12) z, range(24) y, range(24) x"
    con.sql(f"COPY (SELECT * FROM li UNION ALL BY NAME {lattice.format('10 + x.range % 2', 'Q')} UNION ALL BY NAME {lattice.format('10', 'S')}) TO '{folder}/lineitem.parquet'")
    return folder


@pytest.mark.parametrize("name", LIKE_SQL)
def test_like_sql(spark, even, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{even if f == 'lineitem.parquet' else SF}/{f}'")
    got, want = catalog.queries()[name](spark, even), con.sql(catalog.oracle_sql()[name])
    names = sorted(got.columns)
    pick = lambda columns, rows: sorted(tuple(r[columns.index(n)] for n in names) for r in rows)
    ours, theirs = pick(got.columns, got.collect()), pick(want.columns, want.fetchall())
    assert ours == theirs and len(ours) > 0


@pytest.mark.parametrize("name", ("dt_thickness", "dt_spacing", "dt_number", "vector_dt"))
def test_no_background_no_map(spark, even, name):
    """A volume without spheres has an empty map and does not stop the others."""
    out = catalog.queries()[name](spark, even)
    assert {r.vol_id for r in out.select("vol_id").distinct().collect()} == {"AF"}


def test_full_volume_beside_another(spark):
    grid = G.Grid((3, 5, 5))
    full = [("full", *map(int, p), 1) for p in np.argwhere(np.ones(grid.shape))]
    one = [("one", 1, 2, 2, 1)]
    voxels, region = (spark.createDataFrame(rows, G.VOXELS) for rows in (full + one, full + [("one", *r[1:]) for r in full]))
    maps = {r.vol_id: r.v for r in W.sphere_map(voxels, region, grid).collect()}
    assert set(maps) == {"one"} and maps["one"] > 0
    assert {r.vol_id for r in W.nearest_contact(voxels, grid).collect()} == {"one"}
