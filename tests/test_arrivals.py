"""Scans and contours that come in different batches, late, twice or never."""

import datetime as dt

import numpy as np

from voxelweave.plans import workflow as W
from voxelweave.plans.morphometry import Maps
from voxelweave.streaming import arrivals as A

LOG = "Mu_Scaling   8192\nDensity: slope 1600\nDensity: intercept -390\n"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def planes(vol, layer, minute, zs, log="", n=4, value=1):
    a = np.full((6, 6), value, np.int16)
    at = START + dt.timedelta(minutes=minute)
    return [(vol, layer, n, at, z, 0, 0, 6, 6, 0.06, 0.06, 0.06, "i2", log if z == 0 else "", a.tobytes()) for z in zs]


def counted():
    """A scan's result is how many slices each layer has, so that the test is about the state alone."""

    def evaluated(vol_id, layers, values, p):
        return [(vol_id, f"{n} planes", float(len(s)), str(values["slope"]), *(None,) * 9) for n, s in sorted(layers.items())]

    return evaluated


def run(spark, tmp_path, *batches, **how):
    """Each batch is a file of its own and a run of the query of its own: every one but the first is a restart."""
    for k, rows in enumerate(batches):
        if rows:
            spark.createDataFrame(rows, A.ARRIVALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = A.evaluate_arrivals(A.arriving_slices(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "ck"), **how)
        assert query.awaitTermination(200) and query.exception() is None
    return sorted((r.vol_id, r.name, r.value, r.note) for r in spark.read.schema(W.RESULT).parquet(str(tmp_path / "out")).collect())


def test_parts_in_different_batches(spark, tmp_path):
    first = planes("a", "grey", 0, (0, 1, 2), LOG) + planes("b", "contour", 0, range(4)) + planes("c", "grey", 1, range(4), LOG)
    second = planes("a", "contour", 3, range(4)) + planes("a", "grey", 3, (2, 3)) + planes("b", "other", 3, (0,))
    third = planes("a", "grey", 5, (1, 2)) + planes("b", "grey", 5, range(4), LOG)
    late = planes("z", "grey", 500, (0,))  # moves the watermark past everyone's patience
    got = run(spark, tmp_path, first, second, third, late, planes("z", "grey", 501, (1,)), patience="30 minutes", delay="1 minute", evaluated=counted())
    assert got == [
        ("a", "contour planes", 4.0, "1600.0"), ("a", "grey planes", 4.0, "1600.0"), ("a", "late", 2.0, None),
        ("b", "contour planes", 4.0, "1600.0"), ("b", "grey planes", 4.0, "1600.0"),
        ("c", "error", None, "incomplete: 0 of some planes of the contour"),
    ]


def test_the_same_as_a_batch(spark, tmp_path):
    """The whole evaluation in the state: a scan that fails is an error row like in a batch."""
    rows = planes("s", "grey", 0, range(4), LOG, value=5) + planes("s", "contour", 0, range(4))
    params = W.Evaluation(maps=Maps(which=()))
    got = run(spark, tmp_path, rows[:5], rows[5:], params=params)
    frame = spark.createDataFrame(rows, A.ARRIVALS)
    want = W.evaluate_scans(frame.where("layer = 'grey'"), frame.where("layer = 'contour'"), params)
    assert got == sorted((r.vol_id, r.name, r.value, r.note) for r in want.collect()) and got[0][1] == "error"
