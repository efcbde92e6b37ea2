"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import contour, frequency, sphere
from voxelweave.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.7g}") + 0.0
    return float(v) if hasattr(v, "is_finite") else v


def rows(columns, data, names):
    at = [columns.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_like_duckdb(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    ours, theirs = rows(got.columns, got.collect(), names), rows(want.columns, want.fetchall(), names)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9)) for x, y in zip(a, b)), (a, b)


def arrays(voxels):
    out = {}
    for r in voxels.collect():
        out.setdefault(r.vol_id, np.zeros(catalog.GRID.shape, np.int32))[r.z, r.y, r.x] = r.v
    return out


def as_rows(found):
    return sorted((n, *map(int, p), int(a[tuple(p)])) for n, a in found.items() for p in np.argwhere(a))


def test_kernels_behind_tables(spark):
    """Queries without SQL, against their kernels on arrays (which test_kernels checks by plain loops)."""
    thick, sparse, blob, grey, region = (arrays(f(spark, SF)) for f in (catalog._thick, catalog.sparse, catalog._blob, catalog.grey, catalog._region))
    few = ("AF", "RO")
    thick, sparse, blob, grey = ({n: a[n] for n in few} for a in (thick, sparse, blob, grey))
    run = lambda name: sorted(map(tuple, catalog.queries()[name](spark, SF).where(F.col("vol_id").isin(*few)).collect()))
    for name, draw, source in (("dt_thickness", sphere.thickness, thick), ("dt_spacing", sphere.spacing, sparse), ("dt_number", sphere.number, thick)):
        assert run(name) == as_rows({n: draw(a != 0, region[n] != 0)[0] for n, a in source.items()}), name
    assert run("render_volume") == as_rows({n: np.stack([np.where(contour.render_slice(s != 0, contour.MIN_VERTICES), 127, 0) for s in a]) for n, a in blob.items()})
    on = {n: frequency.frequency_threshold(a * 400, (0.0607,) * 3) for n, a in grey.items()}
    assert run("lh_threshold") == as_rows({n: np.where(a, 127, 0) for n, a in on.items()})
    fields = {n: sphere.nearest_contact(a != 0) for n, a in thick.items()}
    for r in catalog.vector_dt(spark, SF).where(F.col("vol_id").isin(*few)).collect():
        field = fields[r.vol_id]
        assert tuple(field[:, r.z, r.y, r.x]) == (r.vz, r.vy, r.vx)


def test_chains_close(spark):
    """Every chain of the contours steps to a neighbour and comes back to its start, along voxels of the blob or beside it."""
    chains = {}
    for r in catalog.contour_chains(spark, SF).collect():
        chains.setdefault((r.vol_id, r.z, r.contour), []).append((r.i, r.y, r.x))
    assert len(chains) > 20
    for rows in chains.values():
        path = [p for _, *p in sorted(rows)]
        assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(path, path[1:] + path[:1]))


def test_phantom(spark):
    """The compartments of the phantom fill its contour, and its pores lie in the ring."""
    labels = catalog.compartment_labels(spark, SF)
    scan, outline, grid = catalog.cylinder(spark, SF)
    assert labels.count() == outline.count() and {r.v for r in labels.select("v").distinct().collect()} == {1, 2}
    steps = {r.step: r.voxels for r in catalog.compartment_stages(spark, SF).collect()}
    assert len(steps) == 30 and steps["00_all"] == outline.count() == steps["28_cortfinal"] + steps["29_trabfinal"]
    y, x = F.col("y") - 200, F.col("x") - 100
    pores = catalog.pore_cascade(spark, SF)
    assert pores.count() > 0 and pores.where((2 * y - 89) * (2 * y - 89) + (2 * x - 89) * (2 * x - 89) > 6400).count() == 0


def test_chains_by_sql(spark):
    key = lambda r: (r.vol_id, r.z, r.contour, r.kind, r.i, r.y, r.x)
    got, want = (sorted(map(key, catalog.queries()[n](spark, SF).collect())) for n in ("slice_chains_sql", "contour_chains"))
    assert got == want and len(got) > 10
