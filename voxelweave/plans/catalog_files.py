"""Registered queries over files (written from the fixtures and read back), and of smaller operators.

Volumes are written by the executors into the shared folder and read by slabs, both through the
``volume`` data source; only contour chains and small records are gathered to be written.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import denylist as DL
from ..functions import policy as P
from ..functions import sketches as K
from ..functions import statistics as S
from ..functions import tables as TF
from ..functions import text as X
from ..functions import variants as VA
from ..operators import grid as G
from ..operators import voxel as V
from ..operators.grid import AXES, KEYS, Grid
from ..sources import images as I
from ..sources import records as R
from ..sources import volumes as VF
from ..sources.shared import folder as _folder
from .catalog import _DIAMOND, GRID, _blob, _diamond, _t, grey, mask, part, query, shifted, sparse
from . import given as GM
from .workflow import headers, thresholds

_EL = (0.06069973, 0.06069973, 0.06069973)


def _written(spark, name: str, ending: str, volumes: dict[str, list[dict]], encode) -> str:
    folder = _folder(spark, name)
    for vol_id, data in volumes.items():
        I.put(spark, f"{folder}/{vol_id}.{ending}", encode(vol_id, data))
    return folder


def _named(df: DataFrame, column: str = "path") -> DataFrame:
    """The file's name without its ending in place of the path."""
    return df.withColumn(column, F.regexp_extract(column, r"([^/.]+)\.[^/]*$", 1))


def _through(spark, voxels: DataFrame, ending: str, grid: Grid, dtype: str = "i2", segments: tuple[str, ...] = (), log: str = "") -> DataFrame:
    """Slices of the fixture's volumes, moved to the grid's origin, written as files by the executors and read back."""
    folder = _folder(spark, ending)
    moved = voxels.select("vol_id", *[(F.col(a) + o).alias(a) for a, o in zip(AXES, grid.origin, strict=True)], "v")
    VF.write_volumes(VF.planes(moved, grid, dtype, log), folder, ending, segments)
    return VF.register(spark).read.format("volume").option("splitBytes", "4096").load(folder)


# ---- volumes


@query("SELECT vol_id, z, y, x, v FROM mask")
def aim_read(spark, sf):
    """Volumes of the older version, one byte a voxel."""
    return I.voxels(_through(spark, mask(spark, sf), "aim", Grid(GRID.shape, GRID.origin, _EL), "u1"), "vol_id")


@query("SELECT vol_id, z, y, x, v FROM grey")
def aim_v030_read(spark, sf):
    """Volumes of the newer version, two bytes a voxel."""
    return I.voxels(_through(spark, grey(spark, sf), "aim", Grid(GRID.shape, GRID.origin, _EL)), "vol_id")


@query("SELECT vol_id, z + 5 AS z, y - 3 AS y, x + 2 AS x, v FROM grey")
def nrrd_read(spark, sf):
    return I.voxels(_through(spark, grey(spark, sf), "nrrd", Grid(GRID.shape, (5, -3, 2), _EL)), "vol_id")


@query("SELECT vol_id, z + 5 AS z, y - 3 AS y, x + 2 AS x, v FROM grey")
def nifti_read(spark, sf):
    return I.voxels(_through(spark, grey(spark, sf), "nii.gz", Grid(GRID.shape, (5, -3, 2), _EL)), "vol_id")


@query("SELECT vol_id, z, y, x, v FROM grey WHERE z BETWEEN 4 AND 6 AND vol_id IN ('AF', 'RF', 'NO')")
def slab_read(spark, sf):
    """Some slices of some volumes: other files are not opened and other slices not read."""
    slices = _through(spark, grey(spark, sf), "nii", Grid(GRID.shape, GRID.origin, _EL))
    return I.voxels(slices.where("z >= 4 AND z < 7 AND vol_id IN ('AF', 'RF', 'NO')"), "vol_id")


@query("SELECT vol_id, z, y, x, CASE WHEN m.v IS NOT NULL THEN 2 ELSE 1 END AS v FROM shifted s FULL JOIN mask m USING (vol_id, z, y, x) WHERE z BETWEEN 0 AND 11 AND y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 23")
def layers_written(spark, sf):
    """Two masks of every volume as one segmentation file each, the second over the first."""
    both = V.overlay(shifted(spark, sf).withColumn("v", F.lit(1)), mask(spark, sf).withColumn("v", F.lit(2)))
    return I.voxels(_through(spark, both, "seg.nrrd", Grid(GRID.shape, GRID.origin, _EL), "u1", ("moved", "own")), "vol_id")


@query("SELECT vol_id, 0::INT AS oz, -4::INT AS oy, 7::INT AS ox, 12::INT AS nz, 24::INT AS ny, 24::INT AS nx, 61 AS el FROM (SELECT DISTINCT vol_id FROM grey)")
def volume_headers(spark, sf):
    """Position, size and voxel size (in thousandths of a mm, rounded) of each file."""
    slices = _through(spark, mask(spark, sf), "aim", Grid(GRID.shape, (0, -4, 7), _EL), "u1")
    return slices.groupBy("vol_id").agg(F.min("z").alias("oz"), F.min("oy").alias("oy"), F.min("ox").alias("ox"), F.count("*").cast("int").alias("nz"), F.max("ny").alias("ny"), F.max("nx").alias("nx"), F.round(F.max("ex") * 1000).cast("int").alias("el"))


_K = "(ascii(vol_id) % 7)"


@query(f"SELECT vol_id, round_even((500 + 390::DOUBLE + {_K}) / (1600 + 10 * {_K}) * 8192, 0)::INT AS lower, round_even((3000 + 390::DOUBLE + {_K}) / (1600 + 10 * {_K}) * 8192, 0)::INT AS upper FROM (SELECT DISTINCT vol_id FROM grey)")
def scan_thresholds(spark, sf):
    """Native thresholds of every scan from the calibration in its own log."""
    k = F.ascii("vol_id") % 7
    log = F.concat(F.lit("Mu_Scaling   8192\nDensity: slope "), (1600 + 10 * k).cast("string"), F.lit("\nDensity: intercept -"), (390 + k).cast("string"), F.lit("\n"))
    grid, folder = Grid(GRID.shape, GRID.origin, _EL), _folder(spark, "logs")
    VF.write_volumes(VF.planes(mask(spark, sf), grid, "u1").withColumn("log", F.when(F.col("z") == 0, log)), folder)
    return thresholds(headers(VF.register(spark).read.format("volume").load(folder)), lower=500, upper=3000)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN 0.0607::DOUBLE ELSE (s_suppkey % 5)::DOUBLE / 50 END AS ex, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN 0.05::DOUBLE ELSE 4 * (s_suppkey % 3)::DOUBLE END AS ey FROM supplier")
def element_sizes(spark, sf):
    """A header's voxel sizes if all make sense, else the nominal ones."""
    k = F.col("s_suppkey")
    sizes = X.element_size([(k % 5).cast("double") / 50, 4 * (k % 3).cast("double"), F.lit(0.06)], (0.0607, 0.05, 0.04))
    return _t(spark, sf, "supplier").select("s_suppkey", sizes[0].alias("ex"), sizes[1].alias("ey"))


@query(_DIAMOND + """, s AS (SELECT *, lead(x, 1, first_x) OVER w - x AS dx, lead(y, 1, first_y) OVER w - y AS dy FROM (SELECT *, first(x) OVER w AS first_x, first(y) OVER w AS first_y FROM chain WINDOW w AS (PARTITION BY vol_id, z ORDER BY i)) WINDOW w AS (PARTITION BY vol_id, z ORDER BY i))
SELECT vol_id, z, first(x) OVER (PARTITION BY vol_id, z ORDER BY i) AS x0, i, (CASE WHEN dx = 1 AND dy = 0 THEN 0 WHEN dx = 1 AND dy = -1 THEN 1 WHEN dx = 0 AND dy = -1 THEN 2 WHEN dx = -1 AND dy = -1 THEN 3 WHEN dx = -1 AND dy = 0 THEN 4 WHEN dx = -1 AND dy = 1 THEN 5 WHEN dx = 0 AND dy = 1 THEN 6 ELSE 7 END)::INT AS code FROM s""")
def contour_file_read(spark, sf):
    """Contour files with one chain a slice, written and read back."""
    chains = _diamond(spark, sf)
    codes = X.chain_codes(chains, "vol_id", "z").join(chains.select("vol_id", "z", "i", "x", "y"), ["vol_id", "z", "i"])
    rows = codes.groupBy("vol_id", "z").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "code"))).alias("c")).collect()
    volumes: dict[str, list[dict]] = {}
    for r in rows:
        volumes.setdefault(r.vol_id, []).append({"z": r.z, "x0": r.c[0].x, "y0": r.c[0].y, "codes": [p.code for p in r.c]})
    folder = _written(spark, "gobj", "gobj", volumes, lambda n, c: I.encode_contours(c))
    found = VF.register(spark).read.format("contours").load(folder)
    return found.select("vol_id", "z", "x0", F.posexplode("codes").alias("i", "code"))


@query("SELECT vol_id, z, y, x, 127 AS v FROM shifted ANTI JOIN mask USING (vol_id, z, y, x) WHERE z BETWEEN 0 AND 11 AND y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 23")
def segment_read(spark, sf):
    """One named segment of files that hold two."""
    both = V.overlay(shifted(spark, sf).withColumn("v", F.lit(2)), mask(spark, sf).withColumn("v", F.lit(1)))
    folder = _folder(spark, "seg")
    VF.write_volumes(VF.planes(both, Grid(GRID.shape, GRID.origin, _EL), "u1"), folder, "seg.nrrd", ("Cortical", "Trabecular"))
    segments = I.read_segments(spark, folder, "trab", glob="*.nrrd").withColumn("vol_id", F.regexp_extract("path", r"([^/.]+)\.seg\.nrrd$", 1))
    return I.voxels(segments, "vol_id").select(*KEYS, F.lit(127).alias("v"))


# ---- records and inventories


@query("SELECT 'id' || n_nationkey AS id, n_regionkey::INT AS n, n_name AS label FROM nation WHERE n_nationkey NOT IN (3, 7)")
def records_read(spark, sf):
    folder = _folder(spark, "records")
    for r in _t(spark, sf, "nation").collect():
        I.put(spark, f"{folder}/{r.n_nationkey}.json", json.dumps({"id": f"id{r.n_nationkey}", "A": {"n": int(r.n_regionkey)}, "meta": {"label": r.n_name}}, indent=1).encode())
    found = R.read_records(spark, folder, "id string, A struct<n: int>, meta struct<label: string>", ["id3", "id7"])
    return found.select("id", F.col("A.n").alias("n"), F.col("meta.label").alias("label"))


@query("SELECT 'id' || n_nationkey AS id, CASE WHEN n_nationkey < 15 THEN 'first' ELSE 'second' END AS pool FROM nation WHERE n_nationkey % 4 <> 0")
def records_pooled(spark, sf):
    """Records of two folders; an id that both hold comes from the first, one without its part goes."""
    folders = {"first": _folder(spark, "pool1"), "second": _folder(spark, "pool2")}
    for r in _t(spark, sf, "nation").collect():
        body = {"id": f"id{r.n_nationkey}"} | ({"A": {"n": 1}} if r.n_nationkey % 4 else {})
        for pool, wanted in (("first", r.n_nationkey < 15), ("second", r.n_nationkey >= 10)):
            if wanted:
                I.put(spark, f"{folders[pool]}/{r.n_nationkey}.json", json.dumps(body).encode())
    return R.pooled_records(spark, folders, "id string, A struct<n: int>", "A").select("id", "pool")


@query("SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey / 8::DOUBLE END AS value, s_name AS name FROM supplier")
def csv_keyed(spark, sf):
    lines = ["id,value,name", *[f"{r.s_suppkey},{'n/a' if r.s_suppkey % 4 == 0 else r.s_suppkey / 8},{r.s_name}" for r in _t(spark, sf, "supplier").collect()]]
    path = _folder(spark, "keyed") + "/table.csv"
    I.put(spark, path, "\n".join(lines).encode())
    return R.read_keyed(spark, path, "id", ["value"])


def _files(spark, sf, name: str, text) -> DataFrame:
    folder = _folder(spark, name)
    for r in _t(spark, sf, "nation").collect():
        if content := text(r.n_nationkey):
            I.put(spark, f"{folder}/{r.n_nationkey}.txt", content.encode())
    return _named(R.inventory(spark, folder)).withColumnRenamed("path", "name")


@query("SELECT n_nationkey::VARCHAR AS name, length('content ' || n_nationkey % 4)::BIGINT AS length, sha256('content ' || n_nationkey % 4) AS sha256, count(*) OVER (PARTITION BY n_nationkey % 4) AS twins FROM nation")
def file_inventory(spark, sf):
    return _files(spark, sf, "inventory", lambda k: f"content {k % 4}")


@query("SELECT n_nationkey::VARCHAR AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'second only' WHEN n_nationkey % 5 = 1 THEN 'first only' WHEN n_nationkey % 5 = 2 THEN 'different' ELSE 'identical' END AS state FROM nation")
def rerun_identity(spark, sf):
    first = _files(spark, sf, "first", lambda k: f"run {k}" if k % 5 else "")
    second = _files(spark, sf, "second", lambda k: "" if k % 5 == 1 else f"run {k}" + ("!" if k % 5 == 2 else ""))
    return R.compare_inventories(first, second)


@query("~ n AS (SELECT vol_id, z, count(*) AS n FROM sparse GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vol_id ORDER BY n DESC, z) AS k FROM n) SELECT vol_id, z, n FROM r WHERE k = 1")
def best_slice(spark, sf):
    return R.best_slice(sparse(spark, sf))


# ---- grids, maps and checks


@query("SELECT vol_id, z, y, x, v::SMALLINT AS v FROM grey")
def map_units_voxels(spark, sf):
    return V.map_units(grey(spark, sf))


@query("SELECT vol_id, z, y, x, v::FLOAT * 0.0607::FLOAT AS v FROM grey")
def map_units_mm(spark, sf):
    return V.map_units(grey(spark, sf), 0.0607)


_BOXED = "SELECT vol_id, min(z)::INT AS z0, max(z)::INT AS z1, min(y)::INT AS y0, max(y)::INT AS y1, min(x)::INT AS x0, max(x)::INT AS x1 FROM {t} GROUP BY 1"


@query(f"~ a AS ({_BOXED.format(t='part')}), b AS ({_BOXED.format(t='sparse')}) SELECT a.vol_id, a.z0 >= b.z0 AND a.z1 <= b.z1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AND a.x0 >= b.x0 AND a.x1 <= b.x1 AS inside FROM a LEFT JOIN b USING (vol_id)")
def grid_inside(spark, sf):
    return G.box_inside(G.boxes(part(spark, sf)), G.boxes(sparse(spark, sf)))


@query(f"""~ s AS (SELECT vol_id, z, min(y) AS a, max(y) AS b, min(x) AS c, max(x) AS d FROM part GROUP BY 1, 2),
r AS (SELECT vol_id, min(z)::INT AS z0, max(z)::INT AS z1, greatest(min(a) - 2, least(min(a), 0))::INT AS y0, (max(b + CASE WHEN (b - a + 1) % 2 = 0 THEN 1 ELSE 0 END) + 2)::INT AS y1,
  greatest(min(c) - 2, least(min(c), 0))::INT AS x0, (max(d + CASE WHEN (d - c + 1) % 2 = 0 THEN 1 ELSE 0 END) + 2)::INT AS x1 FROM s GROUP BY 1), g AS ({_BOXED.format(t='sparse')})
SELECT vol_id, 'render' AS grid, * EXCLUDE (vol_id) FROM r UNION ALL SELECT vol_id, 'seg', * EXCLUDE (vol_id) FROM g WHERE vol_id IN (SELECT vol_id FROM r)
UNION ALL SELECT r.vol_id, 'union', least(r.z0, g.z0), greatest(r.z1, g.z1), least(r.y0, g.y0), greatest(r.y1, g.y1), least(r.x0, g.x0), greatest(r.x1, g.x1) FROM r JOIN g USING (vol_id)""")
def cascade_grids(spark, sf):
    return G.cascade_boxes(part(spark, sf), sparse(spark, sf))


@query("""~ u AS (SELECT vol_id, z, y, x, max(p) AS p, max(c) AS c, max(t) AS t, max(s) AS s, max(m) AS m FROM (
  SELECT vol_id, z, y, x, 1 AS p, 0 AS c, 0 AS t, 0 AS s, 0 AS m FROM mask UNION ALL SELECT vol_id, z, y, x, 0, 1, 0, 0, 0 FROM part UNION ALL SELECT vol_id, z, y, x, 0, 0, 1, 0, 0 FROM shifted
  UNION ALL SELECT vol_id, z, y, x, 0, 0, 0, CASE WHEN x % 2 = 0 THEN 127 ELSE 126 END, 0 FROM sparse UNION ALL SELECT vol_id, z, y, x, 0, 0, 0, 0, 1 FROM sparse WHERE y > 4) GROUP BY 1, 2, 3, 4),
n AS (SELECT vol_id, count(*) FILTER (WHERE p = 1) AS periosteal, count(*) FILTER (WHERE c = 1) AS cort, count(*) FILTER (WHERE t = 1) AS trab, count(*) FILTER (WHERE c = 1 AND t = 1) AS "both",
  count(*) FILTER (WHERE p = 1 AND c = 0 AND t = 0) AS periosteal_only, count(*) FILTER (WHERE p = 0 AND (c = 1 OR t = 1)) AS compartments_only, count(*) FILTER (WHERE s > 0) AS seg, count(*) FILTER (WHERE s > 0 AND p = 0) AS seg_outside_periosteal,
  count(*) FILTER (WHERE s = 127 AND c = 0) AS seg127_outside_cort, count(*) FILTER (WHERE s = 126 AND t = 0) AS seg126_outside_trab, count(*) FILTER (WHERE s = 126 AND c = 1) AS seg126_inside_cort, count(*) FILTER (WHERE s = 127 AND t = 1) AS seg127_inside_trab,
  count(*) FILTER (WHERE m = 1) AS th_support, count(*) FILTER (WHERE m = 1 AND t = 0) AS th_outside, count(*) FILTER (WHERE m = 1 AND c = 1) AS th_inside_other,
  min(z) FILTER (WHERE s > 0) >= min(z) FILTER (WHERE p = 1) AND max(z) FILTER (WHERE s > 0) <= max(z) FILTER (WHERE p = 1) AND min(y) FILTER (WHERE s > 0) >= min(y) FILTER (WHERE p = 1) AND max(y) FILTER (WHERE s > 0) <= max(y) FILTER (WHERE p = 1) AND min(x) FILTER (WHERE s > 0) >= min(x) FILTER (WHERE p = 1) AND max(x) FILTER (WHERE s > 0) <= max(x) FILTER (WHERE p = 1) AS seg_box_inside_periosteal,
  min(z) FILTER (WHERE m = 1) = min(z) FILTER (WHERE s > 0) AND max(z) FILTER (WHERE m = 1) = max(z) FILTER (WHERE s > 0) AND min(y) FILTER (WHERE m = 1) = min(y) FILTER (WHERE s > 0) AND max(y) FILTER (WHERE m = 1) = max(y) FILTER (WHERE s > 0) AND min(x) FILTER (WHERE m = 1) = min(x) FILTER (WHERE s > 0) AND max(x) FILTER (WHERE m = 1) = max(x) FILTER (WHERE s > 0) AS th_box_is_segs
  FROM u GROUP BY 1)
SELECT *, periosteal_only = 0 AND compartments_only = 0 AND "both" = 0 AS partition, seg_outside_periosteal = 0 AND seg127_outside_cort = 0 AND seg126_outside_trab = 0 AS consistent FROM n""")
def evaluation_checks(spark, sf):
    seg = sparse(spark, sf).withColumn("v", F.when(F.col("x") % 2 == 0, 127).otherwise(126))
    return S.evaluation_checks(mask(spark, sf), part(spark, sf), shifted(spark, sf), seg, {"th": (sparse(spark, sf).where("y > 4"), "trab")})


@query("SELECT s.vol_id, s.z, s.y, s.x, 126 AS v FROM sparse s WHERE left(s.vol_id, 1) <> 'A' OR EXISTS (SELECT 1 FROM shifted m WHERE m.vol_id = s.vol_id AND m.z = s.z AND m.y = s.y AND m.x = s.x)")
def trabecular_object(spark, sf):
    cropped = grey(spark, sf).select("vol_id").distinct().withColumn("cropped", F.substring("vol_id", 1, 1) == "A")
    return D.trabecular_object(sparse(spark, sf), shifted(spark, sf), cropped)


@query("SELECT n_nationkey, c.config, CASE c.config WHEN 'A2' THEN 'reference, uncorrected contour' WHEN 'B' THEN 'own, from the outer contour' ELSE 'reference' END AS masks, CASE WHEN c.config IN ('A', 'A2') THEN 'reference' ELSE 'own' END AS segmentation, CASE WHEN c.config = 'C' AND n_nationkey % 3 = 0 THEN 'B' END AS same_as FROM nation, (VALUES ('A'), ('A2'), ('B'), ('C')) c(config) WHERE c.config <> 'A2' OR n_nationkey % 2 = 0")
def configurations(spark, sf):
    k = F.col("n_nationkey")
    return D.configurations(_t(spark, sf, "nation").select("n_nationkey"), k % 2 == 0, k % 3 == 0)


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'raw' END, CASE WHEN s_suppkey % 2 = 0 THEN 'derived' END, 'own') AS object, abs(s_acctbal - s_acctbal * (1 + (s_suppkey % 3) * 1e-9::DOUBLE)) <= greatest(1e-15::DOUBLE, 1e-9::DOUBLE * greatest(abs(s_acctbal), abs(s_acctbal * (1 + (s_suppkey % 3) * 1e-9::DOUBLE)))) AS close FROM supplier")
def stand_ins_and_tolerance(spark, sf):
    k, x = F.col("s_suppkey"), F.col("s_acctbal")
    other = x * (1 + (k % 3) * F.lit(1e-9))
    return _t(spark, sf, "supplier").select("s_suppkey", D.stand_in(F.when(k % 3 == 0, "raw"), F.when(k % 2 == 0, "derived"), F.lit("own")).alias("object"), S.within(x, other).alias("close"))


# ---- texts


@query("SELECT event_id, k::INT AS block, CASE k WHEN 0 THEN NULL WHEN 1 THEN event_type ELSE (event_id % 9)::VARCHAR END AS value FROM events, (VALUES (0), (1), (2)) b(k)")
def log_procedures(spark, sf):
    e = _t(spark, sf, "events")
    log = F.concat(F.lit("header\n!-----\nKind    "), "event_type", F.lit("\n!--------\nCount = "), (F.col("event_id") % 9).cast("string"), F.lit("\n"))
    blocks = X.procedures(e.select("event_id", log.alias("log")))
    return blocks.select("event_id", F.col("block").cast("int").alias("block"), F.coalesce(F.try_element_at("fields", F.lit("Kind")), F.try_element_at("fields", F.lit("Count"))).alias("value"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, (floor(epoch(lead(ts) OVER w)) - floor(epoch(ts)))::DOUBLE / 3600 AS hours FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def vms_times(spark, sf):
    e = _t(spark, sf, "events")
    text = F.concat(F.upper(F.date_format("ts", "d-MMM-yyyy HH:mm:ss")), F.lit(".34"))
    e = e.select("event_id", "user_id", text.alias("t")).withColumn("next", F.lead("t").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.select("event_id", X.vms_seconds(F.col("t")).alias("seconds"), X.interval_hours(F.col("t"), F.col("next")).alias("hours"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'patella' WHEN 1 THEN 'ultradistal radius' WHEN 2 THEN 'diaphyseal tibia' ELSE 'radius' END AS cohort FROM events")
def cohorts(spark, sf):
    site = F.element_at(F.array(*[F.lit(s) for s in ("Patella/x", "Distal/Radius", "Diaphyseal\\Tibia", "Radius")]), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, sf, "events").select("event_id", X.cohort(site).alias("cohort"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'both' WHEN event_id % 3 = 0 THEN 'maps' WHEN event_id % 5 = 0 THEN 'masks' ELSE 'other' END AS kind FROM events")
def section_kinds(spark, sf):
    k = F.col("event_id")
    commands = F.array_compact(F.array(F.when(k % 2 == 0, "seg"), F.when(k % 3 == 0, "dt"), F.when(k % 5 == 0, "gobj")))
    return _t(spark, sf, "events").select("event_id", D.section_kind(commands, {"both": ["seg", "dt"], "maps": ["dt"], "masks": ["gobj"]}).alias("kind"))


@query("SELECT c_custkey, 'Lab ' || c_nationkey AS \"group\", CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'CKD' END AS study, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'CKD_' || lpad((c_custkey % 100)::VARCHAR, 3, '0') END AS subject, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'UD' END AS region, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'tibia' ELSE 'radius' END AS bone FROM customer")
def patient_names(spark, sf):
    k = F.col("c_custkey")
    rest = F.when(k % 5 == 0, "unknown").otherwise(F.concat(F.lit("CkdStudy "), F.when(k % 3 == 0, "Cdk_").otherwise("CKD-"), (k % 100).cast("string"), F.lit(" ud "), F.when(k % 2 == 0, "Tibia").otherwise("RADIUS")))
    name = F.concat(F.lit("Lab "), F.col("c_nationkey").cast("string"), F.lit("; "), rest)
    return _t(spark, sf, "customer").select("c_custkey", D.patient_fields(name, {"CDK": "CKD"}).alias("f")).select("c_custkey", "f.*")


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def policy_columns(spark, sf):
    return X.select_known(_t(spark, sf, "supplier"), {"s_suppkey": "keep", "s_nationkey": "keep", "s_name": "drop", "s_acctbal": "drop"})


def _hmac_sql(message: str, key: bytes) -> str:
    pads = ["".join(f"{b ^ p:02X}" for b in key.ljust(64, b"\0")) for p in (0x36, 0x5C)]
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({message}))))"


def _rest_sql(full: str, modulus: int) -> str:
    rest = "0::BIGINT"
    for k in range(8):
        rest = f"(({rest}) * {(1 << 32) % modulus} + ('0x' || substr({full}, {8 * k + 1}, 8))::BIGINT) % {modulus}"
    return rest


_KEY = b"fixture key"


@query(f"""~ h AS (SELECT c_custkey, {_hmac_sql("c_mktsegment || '|' || c_name", _KEY)} AS a, c_mktsegment, {_hmac_sql("'MEAS|' || c_custkey", _KEY)} AS b, {_hmac_sql("'BASE|' || upper(c_name)", _KEY)} AS c FROM customer)
SELECT c_custkey, c_mktsegment || '-' || substr(a, 1, 6) AS subject, (100000 + {_rest_sql("b", 900_000)})::VARCHAR AS measurement, 'X' || (1000000 + {_rest_sql("c", 9_000_000)}) AS base FROM h""")
def pseudonyms(spark, sf):
    """Keyed names of subjects, measurement numbers and file base names."""
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", X.pseudonym(F.col("c_name"), _KEY, "hex", F.col("c_mktsegment")).alias("subject"), X.pseudonym(F.col("c_custkey").cast("string"), _KEY, "digits").alias("measurement"), X.pseudonym(F.lower("c_name"), _KEY, "code").alias("base"))


# ---- relational forms


@query("SELECT coalesce(l_returnflag, 'ALL') AS flag, coalesce(l_linestatus, 'ALL') AS status, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_summary(spark, sf):
    out = _t(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return out.select(F.coalesce("l_returnflag", F.lit("ALL")).alias("flag"), F.coalesce("l_linestatus", F.lit("ALL")).alias("status"), "n", "quantity")


@query("~ m AS (SELECT vol_id, avg(v) AS mean FROM grey GROUP BY 1) SELECT g.vol_id, g.z, count(*) AS voxels, (SELECT max(v) FROM grey)::INT AS highest FROM grey g JOIN m USING (vol_id) WHERE g.v > m.mean GROUP BY 1, 2")
def sql_text(spark, sf):
    """The same statement as SQL text over voxel tables: a CTE and a scalar subquery."""
    return spark.sql("WITH m AS (SELECT vol_id, avg(v) AS mean FROM {grey} GROUP BY 1) SELECT g.vol_id, g.z, count(*) AS voxels, CAST((SELECT max(v) FROM {grey}) AS INT) AS highest FROM {grey} g JOIN m USING (vol_id) WHERE g.v > m.mean GROUP BY 1, 2", grey=grey(spark, sf))


# ---- given masks


def _layer(voxels: DataFrame, name: str, grid: Grid = GRID) -> DataFrame:
    return VF.planes(voxels, Grid(grid.shape, grid.origin, _EL)).withColumn("name", F.lit(name))


_PLANES = """, moved AS (SELECT vol_id, 'TRAB_TH' AS name, z, y, x, v % 7 AS v FROM grey WHERE z < 11 AND v % 7 <> 0),
theirs AS (SELECT vol_id, 'TRAB_TH' AS name, z + 1 AS z, y, x - 2 AS x, v % 5 AS v FROM grey WHERE v % 5 <> 0)"""
_REPORT = """, box AS (SELECT vol_id, 'TRAB_TH' AS name, %s AS n FROM (SELECT DISTINCT vol_id FROM grey)),
cells AS (SELECT vol_id, name, z, coalesce(m.v, 0) AS p, coalesce(t.v, 0) AS q FROM moved m FULL JOIN theirs t USING (vol_id, name, z, y, x) WHERE %s),
diffs AS (SELECT vol_id, name, p - q AS d, count(*) AS n FROM cells WHERE p <> q GROUP BY 1, 2, 3)
SELECT vol_id, name, any_value(box.n)::BIGINT AS voxels, count(*) FILTER (p <> q) AS mismatches, count(*) FILTER (p <> q AND q = 0) AS ours_only, count(*) FILTER (p <> q AND p = 0) AS ref_only,
       count(*) FILTER (p > 0) AS ours_support, count(*) FILTER (q > 0) AS ref_support, coalesce(avg(p) FILTER (p > 0), 0)::DOUBLE AS ours_mean, coalesce(avg(q) FILTER (q > 0), 0)::DOUBLE AS ref_mean,
       array_to_string(list_slice(list_sort(list_distinct(list(z) FILTER (p <> q))), 1, 50), ' ') AS slices,
       (SELECT string_agg(d || ':' || n, ' ' ORDER BY d) FROM diffs WHERE diffs.vol_id = cells.vol_id) AS differences
FROM cells JOIN box USING (vol_id, name) GROUP BY vol_id, name"""


def _compared_planes(spark, sf, union: bool):
    value = F.col("v")
    ours = _layer(grey(spark, sf).where("z < 11").withColumn("v", value % 7).where("v <> 0"), "TRAB_TH")
    moved = grey(spark, sf).select("vol_id", (F.col("z") + 1).alias("z"), "y", (F.col("x") - 2).alias("x"), (value % 5).alias("v")).where("v <> 0")
    theirs = _layer(moved, "TRAB_TH", Grid(GRID.shape, (1, 0, -2)))
    out = GM.comparison(GM.joint_planes(ours, theirs, union)).drop("ours_mean_mm", "ref_mean_mm")
    text = F.array_join(F.transform(F.map_entries("differences"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), " ")
    return out.withColumns({"slices": F.array_join(F.col("slices").cast("array<string>"), " "), "differences": text})


@query(_PLANES + _REPORT % ("12 * 24 * 24", "z BETWEEN 0 AND 11 AND x BETWEEN 0 AND 23"))
def compare_planes_own(spark, sf):
    """Two maps plane by plane on the first one's grid: what the second holds outside is not compared."""
    return _compared_planes(spark, sf, False)


@query(_PLANES + _REPORT % ("13 * 24 * 26", "true"))
def compare_planes_union(spark, sf):
    """The same on the box around both."""
    return _compared_planes(spark, sf, True)


@query()
def given_masks(spark, sf):
    """Layers of every scan written as files, found again by their names, measured, and their maps compared with themselves, moved."""
    folder = _folder(spark, "given")
    layers = {"SEG": sparse(spark, sf), "TRAB_MASK": mask(spark, sf), "CORT_MASK": part(spark, sf), "TRAB_TH": shifted(spark, sf)}
    for name, voxels in layers.items():
        VF.write_volumes(VF.planes(voxels, Grid(GRID.shape, GRID.origin, _EL)).withColumn("vol_id", F.concat("vol_id", F.lit(f"_{name}"))), folder)
    found = GM.scan_files(spark, folder)
    results = GM.measure_given(found)
    metrics = results.where("data IS NULL").select("vol_id", "name", "value", "note")
    report = GM.compare_maps(results, found)
    long = report.select("vol_id", F.explode(F.array(*[F.struct(F.concat("name", F.lit(f" {c}")).alias("name"), F.col(c).cast("double").alias("value")) for c in ("voxels", "mismatches", "ours_only", "ref_only", "ours_support", "ref_support")])).alias("r"))
    return metrics.unionByName(long.select("vol_id", "r.*").withColumn("note", F.lit(None).cast("string")))


# ---- identifiers and nested records


@query('SELECT o_orderkey, p.k::INT AS "at", c_name AS term FROM orders JOIN customer ON c_custkey = o_custkey, (VALUES (51), (70)) p(k)')
def denylist_terms(spark, sf):
    """Every customer's name as a term, in a text for each order: alone in any case, before a digit (no hit), behind a letter (no hit)."""
    customers = _t(spark, sf, "customer")
    name = F.col("c_name")
    text = F.concat(F.lit("first "), F.upper(name), F.lit("7; x"), name, F.lit(" and "), F.lower(name), F.lit("\n"), name)
    texts = _t(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", text.alias("text"))
    return DL.join_terms(texts, "text", customers, "c_name").select("o_orderkey", "at", "term")


_RECORD = """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS site, CASE WHEN c_custkey % 5 <> 0 THEN 'r' || (c_custkey % 3) END AS first_role,
CASE WHEN c_custkey % 5 <> 0 THEN 2 ELSE 0 END AS roles, c_nationkey::BIGINT AS n, CASE WHEN c_custkey % 2 = 0 THEN 'line,note' ELSE 'line' END AS evidence FROM customer"""


@query(_RECORD)
def nested_policy(spark, sf):
    """A nested record of every customer: names and paths go at every depth, the rest stays."""
    k = F.col("c_custkey")
    role = lambda i: F.struct(F.concat(F.lit("r"), (k % 3 + i).cast("string")).alias("role"), F.col("c_name").alias("path"))
    record = _t(spark, sf, "customer").select(
        "c_custkey", F.when(k % 7 != 0, F.struct(F.col("c_mktsegment").alias("site"), F.col("c_name").alias("name"))).alias("meta"),
        F.when(k % 5 != 0, F.array(role(0), role(1))).otherwise(F.slice(F.array(role(0)), 1, 0)).alias("files"),
        F.create_map(F.lit("scan"), F.struct(F.col("c_name").alias("path"), F.col("c_nationkey").cast("long").alias("n"))).alias("inputs"),
        F.map_filter(F.create_map(F.lit("line"), F.lit(1), F.lit("log"), F.lit(2), F.lit("note"), F.lit(3)), lambda key, _: (key != "note") | (k % 2 == 0)).alias("evidence"), F.struct("c_name", "c_acctbal").alias("spare"),
    )
    policy = {"c_custkey": "keep", "meta.site": "keep", "meta.name": "drop", "files[].role": "keep", "files[].path": "drop", "inputs{}.path": "drop", "inputs{}.n": "keep", "evidence": "keep", "evidence{log}": "drop", "spare": "drop"}
    out = P.apply_policy(record, policy)
    return out.select("c_custkey", F.col("meta.site").alias("site"), F.get("files", F.lit(0))["role"].alias("first_role"), F.size("files").alias("roles"), F.col("inputs")["scan"]["n"].alias("n"), F.array_join(F.array_sort(F.map_keys("evidence")), ",").alias("evidence"))


# ---- sketches, table functions


@query("SELECT substr(vol_id, 2, 1) AS pool, count(*) AS n, count(DISTINCT v) AS kinds, true AS kinds_close, true AS median_close FROM grey GROUP BY 1")
def pooled_sketches(spark, sf):
    """Sketches of every volume, merged for pools of volumes, beside the exact numbers: both lie within the bounds."""
    voxels = grey(spark, sf)
    pool = F.substring("vol_id", 2, 1).alias("pool")
    merged = K.pooled_sketches(K.scan_sketches(voxels, "vol_id").withColumn("pool", pool), "pool")
    guess = merged.select("pool", "n", K.distinct_count().alias("guess"), K.quantile(0.5).alias("median"))
    exact = voxels.groupBy(pool).agg(F.countDistinct("v").alias("kinds"))
    beside = voxels.select(pool, "v").join(guess, "pool").groupBy("pool", "n", "guess").agg(F.avg((F.col("v") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("median")).cast("int")).alias("up_to"))
    e = K.rank_error()
    return exact.join(beside, "pool").select("pool", "n", "kinds", (F.abs(F.col("guess") - F.col("kinds")) <= F.ceil(F.col("kinds") * K.distinct_error())).alias("kinds_close"), ((F.col("below") <= 0.5 + e) & (F.col("up_to") >= 0.5 - e)).alias("median_close"))


@query()
def slice_chains_sql(spark, sf):
    """The contours of every slice by SQL alone."""
    VF.planes(_blob(spark, sf), Grid(GRID.shape, GRID.origin, _EL)).createOrReplaceTempView("slices")
    return TF.register(spark).sql("SELECT s.vol_id, s.z, c.* FROM slices s, LATERAL slice_chains(s.data, s.dtype, s.oy, s.ox, s.ny, s.nx) c")


# ---- variants


_EVENTS = """, b AS (SELECT user_id % 40 AS k, user_id::VARCHAR AS log, event_id % 3 AS run, event_id AS line, event_id % 5 <> 0 AS ok, (event_id % 2)::VARCHAR AS input,
  CASE event_type WHEN 'click' THEN 'mask' WHEN 'view' THEN 'extract' WHEN 'purchase' THEN 'filter' WHEN 'signup' THEN 'fill' ELSE 'other' END AS name,
  CASE WHEN event_id % 7 < 3 THEN 'X_TRAB_MASK.GOBJ' ELSE 'x.gobj' END AS gobj FROM events),
f AS (SELECT k, log, max(line) AS line, arg_max(run, line) AS run, arg_max(input, line) AS input FROM b WHERE name = 'filter' GROUP BY 1, 2),
s AS (SELECT b.*, f.line AS fl, f.input AS fi, min(CASE WHEN b.name = 'extract' THEN b.line END) OVER (PARTITION BY b.k, b.log) AS fx FROM b JOIN f ON b.k = f.k AND b.log = f.log AND b.run = f.run),
a AS (SELECT k, log, any_value(run) AS run, any_value(fl) AS filter_line, any_value(fi) AS fi, any_value(fx) AS extract_line,
  max(line) FILTER (name = 'fill' AND line < fl) AS fill_line, arg_max(ok, line) FILTER (name = 'fill' AND line < fl) AS fill_ok, arg_max(input, line) FILTER (name = 'fill' AND line < fl) AS fill_in,
  min(line) FILTER (name = 'mask' AND ok) AS mask_line, min(line) FILTER (name = 'mask' AND line > coalesce(fx, -1) AND gobj = 'X_TRAB_MASK.GOBJ') AS trab_line,
  arg_min(ok, line) FILTER (name = 'mask' AND line > coalesce(fx, -1) AND gobj = 'X_TRAB_MASK.GOBJ') AS trab_ok FROM s GROUP BY 1, 2),
t AS (SELECT k, log, run, CASE WHEN fill_ok AND fill_in = fi THEN 'duplicate' ELSE 'none' END AS border,
  CASE WHEN mask_line < extract_line THEN 'periosteal_first' WHEN mask_line IS NOT NULL AND extract_line IS NOT NULL THEN 'gobj_first' END AS "order",
  CASE WHEN trab_ok THEN 'gobj' WHEN trab_line IS NOT NULL THEN 'none' END AS trab_mask, filter_line, fill_line, mask_line, extract_line, trab_line FROM a)"""
_NAMES = VA.Commands("filter", "fill", "mask", "extract")


def _blocks(spark, sf) -> DataFrame:
    e, kind = _t(spark, sf, "events"), F.col("event_type")
    name = F.when(kind == "click", "mask").when(kind == "view", "extract").when(kind == "purchase", "filter").when(kind == "signup", "fill").otherwise("other")
    n = F.col("event_id")
    return e.select((F.col("user_id") % 40).alias("k"), F.col("user_id").cast("string").alias("log"), (n % 3).alias("run"), n.alias("line"), name.alias("name"), (n % 5 != 0).alias("ok"), (n % 2).cast("string").alias("input"), F.when(n % 7 < 3, "X_TRAB_MASK.GOBJ").otherwise("x.gobj").alias("gobj"))


@query(_EVENTS + " SELECT * FROM t")
def transcript_variants(spark, sf):
    """What each transcript says of the segmentation, with the lines that say it."""
    return VA.transcript_variants(_blocks(spark, sf), "k", commands=_NAMES)


@query(_EVENTS + """, r AS (SELECT user_id % 40 AS k, user_id::VARCHAR AS log, min(floor(epoch(ts)))::BIGINT AS start, min(floor(epoch(ts)))::BIGINT + 400000 AS stop FROM events GROUP BY 1, 2),
p AS (SELECT user_id % 40 AS k, event_id % 3 = 0 AS fill, event_id % 4 = 0 AS mask, floor(epoch(ts))::BIGINT AS ts FROM events WHERE event_type = 'error'),
v AS (SELECT k, count(*) FILTER (fill) AS fills, count(*) FILTER (mask) AS masks, count(*) AS files FROM p GROUP BY 1),
i AS (SELECT r.k, r.log, r.start, r.stop, count(*) FILTER (ts BETWEEN r.start AND r.stop) AS inside, count(*) FILTER (ts > r.stop) AS after FROM r LEFT JOIN p ON p.k = r.k GROUP BY ALL),
o AS (SELECT t.*, i.start, inside, after, CASE WHEN border = 'duplicate' THEN coalesce(fills, 0) ELSE coalesce(files, 0) - coalesce(fills, 0) END + CASE WHEN coalesce(trab_mask, '') = 'gobj' THEN coalesce(masks, 0) ELSE coalesce(files, 0) - coalesce(masks, 0) END AS agreements, 2 * coalesce(files, 0) AS of_all FROM t JOIN i ON i.k = t.k AND i.log = t.log LEFT JOIN v ON v.k = t.k),
q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN after > 0 THEN 1 ELSE 0 END, 2 * agreements - of_all DESC, inside DESC, start DESC, log) AS place FROM o),
n AS (SELECT n_nationkey + g AS k, n_nationkey % 3 = 0 AS has_seg, CASE WHEN n_nationkey % 6 = 0 THEN 'D3P_Cl_ExtractNumber_CPP' || CASE WHEN n_nationkey % 4 = 0 THEN ' D3P_GobjOrAimMaskAimPeel_OW D3P_Cl_Label_CPP' ELSE ' D3P_FillOffsetDuplicate' END END AS seg_log FROM nation, (VALUES (0), (25)) z(g))
SELECT n.k::BIGINT AS k, CASE WHEN has_seg AND seg_log IS NOT NULL THEN CASE WHEN seg_log LIKE '%Fill%' THEN 'duplicate' ELSE 'none' END WHEN NOT has_seg AND log IS NOT NULL THEN border ELSE 'duplicate' END AS border,
  CASE WHEN has_seg AND seg_log IS NOT NULL THEN CASE WHEN seg_log LIKE '%Mask%Label%' THEN 'periosteal_first' ELSE 'gobj_first' END WHEN NOT has_seg AND log IS NOT NULL THEN coalesce("order", 'periosteal_first') ELSE 'periosteal_first' END AS "order",
  CASE WHEN has_seg AND seg_log IS NOT NULL THEN CASE WHEN seg_log LIKE '%Extract%Mask%' THEN 'gobj' ELSE 'none' END WHEN NOT has_seg AND log IS NOT NULL THEN coalesce(trab_mask, 'gobj') ELSE 'gobj' END AS trab_mask,
  CASE WHEN has_seg AND seg_log IS NOT NULL THEN 'processing log' WHEN NOT has_seg AND log IS NOT NULL THEN 'evaluation log' ELSE 'default' END AS source, CASE WHEN NOT has_seg THEN log END AS log
FROM n LEFT JOIN q ON q.k = n.k AND q.place = 1""")
def scan_variants(spark, sf):
    """The variant of every scan: by its segmentation's log, by the run that made its files, or by default."""
    e = _t(spark, sf, "events").withColumns({"k": F.col("user_id") % 40, "t": F.unix_timestamp("ts")})
    runs = e.groupBy("k", F.col("user_id").cast("string").alias("log")).agg(F.min("t").alias("start")).withColumn("end", F.col("start") + 400000)
    products = e.where("event_type = 'error'").select("k", (F.col("event_id") % 3 == 0).alias("fill"), (F.col("event_id") % 4 == 0).alias("mask"), F.col("t").alias("ts"))
    n = F.col("n_nationkey")
    entry = F.concat(F.lit("D3P_Cl_ExtractNumber_CPP"), F.when(n % 4 == 0, " D3P_GobjOrAimMaskAimPeel_OW D3P_Cl_Label_CPP").otherwise(" D3P_FillOffsetDuplicate"))
    scans = _t(spark, sf, "nation").select(F.explode(F.array(n.cast("long"), n.cast("long") + 25)).alias("k"), (n % 3 == 0).alias("has_seg"), F.when(n % 6 == 0, entry).alias("seg_log"))
    facts = VA.transcript_variants(_blocks(spark, sf), "k", commands=_NAMES)
    return VA.variants(scans, VA.chosen_logs(facts, runs, products, "k"), "k")
