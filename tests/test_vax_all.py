import os

import pytest

from voxelweave.functions import text as X
from voxelweave.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_no_event_is_left_out(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id")
    got = catalog.queries()["vax_float"](spark, SF)
    assert got.count() == events.count() and got.join(events, "event_id", "left_anti").count() == 0
    assert "where" not in catalog.oracle_sql()["vax_float"].lower().split("from f")[1]


def test_every_exponent(spark):
    rows = spark.range(256).selectExpr("id AS e", "id * 128 AS u")
    got = {r.e: r.value for r in rows.select("e", X.vax_float(rows.u).alias("value")).collect()}
    assert got == {e: 0.5 * 2.0 ** (e - 128) if e else 0.0 for e in range(256)}
