"""Registered queries: each operator on fixture volumes made from the driver's tables.

A query has a DataFrame form and, where SQL can say it, an independent DuckDB form over the
same fixture.  Fixtures: ``grey`` are six sparse 12 x 24 x 24 volumes of line items, ``mask``
and ``sparse`` their voxels above the average or above 1.6 of it, ``shifted`` the mask moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import statistics as S
from ..functions import text as X
from ..operators import grid as G
from ..operators import voxel as V
from ..operators import whole as W
from ..operators.grid import KEYS, Grid
from .compartments import Compartments, compartment_steps, compartments
from .morphometry import Maps
from .pores import Pores, pores
from .given import evaluate_apart
from .workflow import Evaluation

GRID = Grid((12, 24, 24))
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

_WITH = """
WITH RECURSIVE grey AS (
  SELECT concat(l_returnflag, l_linestatus) AS vol_id, CAST(l_orderkey % 12 AS INT) AS z, CAST(l_partkey % 24 AS INT) AS y,
         CAST((l_suppkey + 7 * l_linenumber) % 24 AS INT) AS x, CAST(sum(l_quantity) AS INT) AS v
  FROM lineitem GROUP BY 1, 2, 3, 4),
avged AS (SELECT *, avg(v) OVER (PARTITION BY vol_id) AS m FROM grey),
mask AS (SELECT vol_id, z, y, x, 127 AS v FROM avged WHERE v > m),
sparse AS (SELECT vol_id, z, y, x, 127 AS v FROM avged WHERE v > 1.6::DOUBLE * m),
shifted AS (SELECT vol_id, z + 2 AS z, y - 1 AS y, x + 3 AS x, v FROM mask),
part AS (SELECT * FROM mask WHERE x BETWEEN 5 AND 14 AND y BETWEEN 3 AND 16 AND z > 2),
lat AS (SELECT vol_id, a.range::INT AS z, b.range::INT AS y, c.range::INT AS x FROM (SELECT DISTINCT vol_id FROM grey), range(12) a, range(24) b, range(24) c),
s2 AS (SELECT a.range::INT - 8 AS dz, b.range::INT - 8 AS dy, c.range::INT - 8 AS dx FROM range(17) a, range(17) b, range(17) c),
cham AS (SELECT dz, dy, dx, list_sort([abs(dz), abs(dy), abs(dx)]) AS s FROM s2),
offs AS (SELECT dz, dy, dx, (5 * s[1] + 4 * (s[2] - s[1]) + 3 * (s[3] - s[2]))::INT AS d FROM cham),
field AS (SELECT vol_id, z, y, x, v % 5 - 2 AS vz, (v // 5) % 7 - 3 AS vy, (v // 35) % 5 - 2 AS vx FROM avged WHERE v > m AND (v % 5 <> 2 OR (v // 5) % 7 <> 3 OR (v // 35) % 5 <> 2)),
pairs AS (
  SELECT c_mktsegment AS cohort, c_custkey, sum(o_totalprice) AS x, sum(p) AS y
  FROM customer JOIN (SELECT o_custkey, o_totalprice, (SELECT NULL) AS q, p FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) ON o_custkey = c_custkey
  GROUP BY 1, 2),
joint AS (
  SELECT event_type AS vol_id, CAST(floor(value / 20) AS INT) AS ours, CAST(floor(CAST(json_extract_string(props, '$.k') AS INT) / 20) AS INT) AS ref, count(*) AS n
  FROM events GROUP BY 1, 2, 3)
"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = _WITH + (", " if sql.lstrip().startswith("~") else "") + sql.lstrip().lstrip("~")
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- fixtures


def _t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grey(spark, sf) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    vol = F.concat("l_returnflag", "l_linestatus").alias("vol_id")
    at = [(F.col("l_orderkey") % 12).cast("int").alias("z"), (F.col("l_partkey") % 24).cast("int").alias("y"), ((F.col("l_suppkey") + 7 * F.col("l_linenumber")) % 24).cast("int").alias("x")]
    return li.groupBy(vol, *at).agg(F.sum("l_quantity").cast("int").alias("v"))


def _above(spark, sf, factor: float) -> DataFrame:
    g = grey(spark, sf)
    mean = F.avg("v").over(Window.partitionBy("vol_id"))
    return g.withColumn("m", mean).where(F.col("v") > F.lit(factor) * F.col("m")).select(*KEYS, F.lit(127).alias("v"))


def mask(spark, sf):
    return _above(spark, sf, 1.0)


def sparse(spark, sf):
    return _above(spark, sf, 1.6)


def shifted(spark, sf):
    return mask(spark, sf).select("vol_id", (F.col("z") + 2).alias("z"), (F.col("y") - 1).alias("y"), (F.col("x") + 3).alias("x"), "v")


def part(spark, sf):
    return mask(spark, sf).where("x BETWEEN 5 AND 14 AND y BETWEEN 3 AND 16 AND z > 2")


def field(spark, sf):
    g = grey(spark, sf).withColumn("m", F.avg("v").over(Window.partitionBy("vol_id"))).where("v > m")
    g = g.select(*KEYS, (F.col("v") % 5 - 2).alias("vz"), (F.floor(F.col("v") / 5) % 7 - 3).cast("int").alias("vy"), (F.floor(F.col("v") / 35) % 5 - 2).cast("int").alias("vx"))
    return g.where("vz <> 0 OR vy <> 0 OR vx <> 0")


def pairs(spark, sf):
    per_order = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("p"))
    o = _t(spark, sf, "orders").join(per_order, F.col("l_orderkey") == F.col("o_orderkey"))
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("cohort"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("cohort", "c_custkey").agg(F.sum("o_totalprice").alias("x"), F.sum("p").alias("y"))


def joint(spark, sf):
    e = _t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy(F.col("event_type").alias("vol_id"), F.floor(F.col("value") / 20).cast("int").alias("ours"), F.floor(k / 20).cast("int").alias("ref")).agg(F.count("*").alias("n"))


# ---- grids


@query("SELECT vol_id, min(z)::INT AS z0, max(z)::INT AS z1, min(y)::INT AS y0, max(y)::INT AS y1, min(x)::INT AS x0, max(x)::INT AS x1 FROM (SELECT * FROM mask UNION ALL SELECT * FROM shifted) GROUP BY 1")
def union_grid(spark, sf):
    return G.union_boxes(G.boxes(mask(spark, sf)), G.boxes(shifted(spark, sf)))


@query("SELECT * FROM shifted WHERE z BETWEEN 0 AND 11 AND y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 23")
def align_crop(spark, sf):
    return G.crop(shifted(spark, sf), GRID)


@query("SELECT lat.vol_id, lat.z, lat.y, lat.x, coalesce(grey.v, -1)::INT AS v FROM lat LEFT JOIN grey USING (vol_id, z, y, x)")
def align_fill(spark, sf):
    return G.dense(grey(spark, sf), GRID, -1)


_BOX = "SELECT vol_id, {z0} AS z0, {z1} AS z1, {y0} AS y0, {y1} AS y1, {x0} AS x0, {x1} AS x1 FROM part GROUP BY 1"


@query(_BOX.format(z0="min(z)::INT", z1="max(z)::INT", y0="min(y)::INT", y1="max(y)::INT", x0="min(x)::INT", x1="max(x)::INT"))
def bounding_box(spark, sf):
    return G.boxes(part(spark, sf))


@query(_BOX.format(z0="greatest(min(z) - 1, 0)::INT", z1="least(max(z) + 1, 11)::INT", y0="greatest(min(y) - 5, 0)::INT", y1="least(max(y) + 5, 23)::INT", x0="greatest(min(x) - 3, 0)::INT", x1="least(max(x) + 3, 23)::INT"))
def bounding_box_border(spark, sf):
    return G.boxes(part(spark, sf), (1, 5, 3), GRID)


@query(_BOX.format(z0="min(z)::INT", z1="max(z)::INT", y0="0::INT", y1="23::INT", x0="0::INT", x1="23::INT"))
def bounding_box_slices(spark, sf):
    return G.boxes(part(spark, sf), (0, 0, 0), GRID, z_only=True)


@query("""~ s AS (SELECT vol_id, z, min(y) AS a, max(y) AS b, min(x) AS c, max(x) AS d FROM part GROUP BY 1, 2)
SELECT vol_id, min(z)::INT AS z0, max(z)::INT AS z1,
  greatest(min(a) - 2, least(min(a), 0))::INT AS y0, (max(b + CASE WHEN (b - a + 1) % 2 = 0 THEN 1 ELSE 0 END) + 2)::INT AS y1,
  greatest(min(c) - 2, least(min(c), 0))::INT AS x0, (max(d + CASE WHEN (d - c + 1) % 2 = 0 THEN 1 ELSE 0 END) + 2)::INT AS x1
FROM s GROUP BY 1""")
def render_grid(spark, sf):
    return G.render_boxes(part(spark, sf))


@query("SELECT vol_id, z, y, x, v FROM mask WHERE z > 2 AND EXISTS (SELECT 1 FROM (SELECT vol_id AS w, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM part GROUP BY 1) b WHERE w = vol_id AND z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1)")
def bounding_box_cut(spark, sf):
    return G.cut(mask(spark, sf).where("z > 2"), G.boxes(part(spark, sf)))


# ---- mask arithmetic


@query("SELECT vol_id, z, y, x, 2 AS v FROM mask")
def set_value(spark, sf):
    return V.set_value(mask(spark, sf), 2)


@query("SELECT lat.vol_id, lat.z, lat.y, lat.x, 127 AS v FROM lat ANTI JOIN mask USING (vol_id, z, y, x)")
def invert_mask(spark, sf):
    return V.set_value(mask(spark, sf), 0, 127, GRID, grey(spark, sf))


_CHAR = """~ t AS (SELECT vol_id, z, y, x, greatest(-127, least(127, coalesce(a.v, 0) {sign} coalesce(b.v, 0)))::INT AS v
  FROM (SELECT vol_id, z, y, x, v % 100 + 60 AS v FROM grey) a FULL JOIN shifted b USING (vol_id, z, y, x))
"""


def _char(spark, sf):
    return grey(spark, sf).withColumn("v", F.col("v") % 100 + 60)


@query(_CHAR.format(sign="-") + "SELECT * FROM t WHERE v <> 0")
def subtract_saturated(spark, sf):
    return V.subtract(_char(spark, sf), shifted(spark, sf))


@query(_CHAR.format(sign="+") + "SELECT * FROM t WHERE v <> 0")
def add_saturated(spark, sf):
    return V.add(_char(spark, sf), shifted(spark, sf))


@query(_CHAR.format(sign="-") + "SELECT vol_id, count(*) FILTER (WHERE v <> 0) AS voxels, count(*) FILTER (WHERE v < 0) AS negative FROM t GROUP BY 1")
def stage_counts(spark, sf):
    out = V.subtract(_char(spark, sf), shifted(spark, sf))
    return out.groupBy("vol_id").agg(F.count("*").alias("voxels"), F.count_if(F.col("v") < 0).alias("negative"))


@query("SELECT grey.* FROM grey SEMI JOIN shifted USING (vol_id, z, y, x)")
def mask_by_contour(spark, sf):
    return V.mask_by(grey(spark, sf), shifted(spark, sf))


_PEEL = """SELECT m.* FROM mask m WHERE (SELECT count(*) FROM mask n WHERE n.vol_id = m.vol_id AND n.z = m.z AND abs(n.y - m.y) + abs(n.x - m.x) <= {n}) = {all}"""


@query(_PEEL.format(n=1, all=5))
def peel_contour(spark, sf):
    return V.peel(mask(spark, sf), 1)


@query("~ big AS (SELECT * FROM (SELECT vol_id, z, y, x, 127 AS v FROM lat WHERE (y - 12) * (y - 12) + (x - 11) * (x - 11) <= 90 + z)) SELECT m.* FROM big m WHERE (SELECT count(*) FROM big n WHERE n.vol_id = m.vol_id AND n.z = m.z AND abs(n.y - m.y) + abs(n.x - m.x) <= 3) = 25")
def peel_contour_3(spark, sf):
    disc = G.lattice(grey(spark, sf), GRID).where("(y - 12) * (y - 12) + (x - 11) * (x - 11) <= 90 + z").withColumn("v", F.lit(127))
    return V.peel(disc, 3)


@query("SELECT vol_id, count(*) FILTER (WHERE a.v IS NULL) AS added, count(*) FILTER (WHERE b.v IS NULL) AS removed FROM mask a FULL JOIN shifted b USING (vol_id, z, y, x) GROUP BY 1")
def mask_changes(spark, sf):
    return V.mask_changes(mask(spark, sf), shifted(spark, sf))


@query("SELECT vol_id, z, y, x, 1 AS v FROM mask ANTI JOIN shifted USING (vol_id, z, y, x) UNION ALL SELECT vol_id, z, y, x, 2 FROM shifted")
def labels_from_masks(spark, sf):
    m, s = mask(spark, sf), shifted(spark, sf)
    return V.labels_from_masks(V.without(m, s), s)


@query("SELECT vol_id, count(*) AS outside FROM mask ANTI JOIN shifted USING (vol_id, z, y, x) GROUP BY 1")
def support_outside(spark, sf):
    return V.outside(mask(spark, sf), shifted(spark, sf))


@query("SELECT vol_id, z, y, x, CASE WHEN b.v IS NOT NULL THEN 126 ELSE 127 END AS v FROM mask a FULL JOIN shifted b USING (vol_id, z, y, x)")
def seg_overlap(spark, sf):
    return V.overlay(mask(spark, sf), shifted(spark, sf).withColumn("v", F.lit(126)))


@query("SELECT vol_id, z, y, x, (CASE a.v WHEN 127 THEN 1 ELSE 0 END + CASE b.v WHEN 127 THEN 2 ELSE 0 END)::INT AS v FROM mask a FULL JOIN shifted b USING (vol_id, z, y, x)")
def seg_labels(spark, sf):
    both = mask(spark, sf).withColumn("bit", F.lit(1)).unionByName(shifted(spark, sf).withColumn("bit", F.lit(2)))
    return both.groupBy(*KEYS).agg(F.sum("bit").cast("int").alias("v"))


# ---- pointwise


@query("SELECT vol_id, z, y, x, round_even((v::DOUBLE - (-394.095001)::DOUBLE) / 1619.07703::DOUBLE * 8192, 0)::INT AS native FROM grey")
def calibrate_threshold(spark, sf):
    return grey(spark, sf).select(*KEYS, V.native_threshold(F.col("v"), 1619.07703, -394.095001).alias("native"))


@query("SELECT vol_id, z, y, x, 127 AS v FROM grey WHERE v BETWEEN 20 AND 60")
def band_threshold(spark, sf):
    return V.band(grey(spark, sf), 20, 60)


@query("SELECT vol_id, z, y, x, greatest(-32768, least(32767, trunc(-1000::DOUBLE + (v * 97)::DOUBLE / 8192 * (1000 / 0.2409::DOUBLE))))::INT AS hu FROM grey")
def hu_from_native(spark, sf):
    return grey(spark, sf).select(*KEYS, V.hounsfield(F.col("v") * 97, 8192.0, 0.2409).alias("hu"))


@query("SELECT DISTINCT v, trunc(v::DOUBLE / 1000 * 32767)::INT AS short FROM grey")
def permille_to_short(spark, sf):
    return grey(spark, sf).select("v").distinct().select("v", V.permille_to_short(F.col("v")).alias("short"))


@query("SELECT DISTINCT v, greatest(-32767::FLOAT, least(32767::FLOAT, trunc((v * 911)::FLOAT * (32767::FLOAT / 200000::FLOAT))))::INT AS short FROM grey")
def normalise_short(spark, sf):
    return grey(spark, sf).select("v").distinct().select("v", V.normalised_short(F.col("v") * 911).alias("short"))


_ODD = " + ".join(f"(CASE WHEN v{a} <> 0 THEN (2 * abs(v{a}) - 1) * (2 * abs(v{a}) - 1) ELSE 0 END)" for a in "zyx")


@query(f"SELECT vol_id, z, y, x, sqrt(({_ODD})::DOUBLE) * 0.5 AS s FROM field")
def surface_distance(spark, sf):
    return field(spark, sf).select(*KEYS, V.surface_distance(F.col("vz"), F.col("vy"), F.col("vx")).alias("s"))


# ---- smoothing and morphology


def _taps():
    from ..operators.raster import gauss_taps

    return [f"({float(t)!r}::FLOAT)" for t in gauss_taps(2.0, 3)]


def _gauss_sql(source: str, axis: str) -> str:
    t = _taps()
    rest = ", ".join(a for a in ("vol_id", "z", "y", "x") if a != axis)
    pair = lambda k: f"(coalesce(lag(v, {k}) OVER w, 0::FLOAT) + coalesce(lead(v, {k}) OVER w, 0::FLOAT))"
    total = f"v * {t[0]}"
    for k in (1, 2, 3):
        total = f"({total} + {pair(k)} * {t[k]})"
    return f"(SELECT vol_id, z, y, x, trunc({total})::FLOAT AS v FROM {source} WINDOW w AS (PARTITION BY {rest} ORDER BY {axis}))"


_DENSE = "(SELECT lat.vol_id, lat.z, lat.y, lat.x, (coalesce(grey.v, 0) * 50)::FLOAT AS v FROM lat LEFT JOIN grey USING (vol_id, z, y, x))"


def _bright(spark, sf):
    return grey(spark, sf).withColumn("v", F.col("v") * 50)


@query(f"SELECT vol_id, z, y, x, v::INT AS v FROM {_gauss_sql(_DENSE, 'x')}")
def gauss_taps_x(spark, sf):
    return V.gauss(_bright(spark, sf), GRID, axes=("x",)).withColumn("v", F.col("v").cast("int"))


_SMOOTH = _gauss_sql(_gauss_sql(_gauss_sql(_DENSE, "x"), "y"), "z")


@query(f"SELECT vol_id, z, y, x, v::INT AS v FROM {_SMOOTH}")
def gauss_separable(spark, sf):
    return V.gauss(_bright(spark, sf), GRID).withColumn("v", F.col("v").cast("int"))


@query(f"SELECT vol_id, z, y, x, 127 AS v FROM {_SMOOTH} WHERE v BETWEEN 1500 AND 1900 AND z BETWEEN 3 AND 8 AND y BETWEEN 3 AND 20 AND x BETWEEN 3 AND 20")
def seg_gauss(spark, sf):
    return V.gauss_band(_bright(spark, sf), GRID, 1500, 1900)


@query(f"SELECT vol_id, z, y, x, 127 AS v FROM {_SMOOTH} WHERE v BETWEEN 1500 AND 1900 AND z BETWEEN 3 AND 8 AND y BETWEEN 3 AND 20 AND x BETWEEN 3 AND 20")
def seg_gauss_kernel(spark, sf):
    return W.gauss_band(_bright(spark, sf), GRID, 1500, 1900, height=4)


def _near_sql(source: str, n: int) -> str:
    return f"(SELECT DISTINCT s.vol_id, (s.z + o.dz)::INT AS z, (s.y + o.dy)::INT AS y, (s.x + o.dx)::INT AS x FROM {source} s, offs o WHERE o.d < {3 * n + 2})"


def _box_sql(source: str, m: int) -> str:
    return f"(SELECT * FROM {source} WHERE z BETWEEN {-m} AND {11 + m} AND y BETWEEN {-m} AND {23 + m} AND x BETWEEN {-m} AND {23 + m})"


def _lat_sql(m: int) -> str:
    return f"(SELECT vol_id, a.range::INT - {m} AS z, b.range::INT - {m} AS y, c.range::INT - {m} AS x FROM (SELECT DISTINCT vol_id FROM grey), range({12 + 2 * m}) a, range({24 + 2 * m}) b, range({24 + 2 * m}) c)"


def _erode_sql(source: str, n: int, m: int = 0) -> str:
    empty = f"(SELECT l.* FROM {_lat_sql(m)} l ANTI JOIN {source} s USING (vol_id, z, y, x))"
    return f"(SELECT e.vol_id, e.z, e.y, e.x FROM {source} e ANTI JOIN {_near_sql(empty, n)} k USING (vol_id, z, y, x))"


_DENSE_MASK = "~ thick AS (SELECT lat.vol_id, lat.z, lat.y, lat.x FROM lat ANTI JOIN sparse USING (vol_id, z, y, x) UNION SELECT vol_id, z, y, x FROM sparse WHERE z < 8)\n"


def _thick(spark, sf):
    """A mask with few holes, so that something survives an erosion; a volume with nothing sparse is full."""
    s = sparse(spark, sf)
    return V.background(s, GRID, grey(spark, sf)).unionByName(s.where("z < 8").select(*KEYS)).withColumn("v", F.lit(127))


def _with_value(sql: str) -> str:
    return f"SELECT vol_id, z, y, x, 127 AS v FROM {sql}"


@query(_DENSE_MASK + _with_value(_erode_sql("thick", 1)))
def erosion_1(spark, sf):
    return V.erode(_thick(spark, sf), GRID, 1)


@query(_DENSE_MASK + _with_value(_erode_sql("thick", 3)))
def erosion_3(spark, sf):
    return W.erode(_thick(spark, sf), GRID, 3, height=4)


@query(_DENSE_MASK + _with_value(_erode_sql("thick", 3)))
def erosion_3_kernel(spark, sf):
    return W.erode(_thick(spark, sf), GRID, 3)


@query(_with_value(_near_sql("sparse", 1)))
def dilation_1(spark, sf):
    return V.dilate(sparse(spark, sf), 1)


@query(_with_value(_near_sql("sparse", 2)))
def dilation_2_kernel(spark, sf):
    return W.dilate(sparse(spark, sf), GRID, 2)


def _mirror_sql(source: str, n: int, axes: str = "zyx") -> str:
    size = {"z": 12, "y": 24, "x": 24}
    out = f"(SELECT vol_id, z, y, x FROM {source})"
    for a in axes:
        cols = lambda e: ", ".join(["vol_id"] + [f"({e}) AS {c}" if c == a else c for c in "zyx"])  # noqa: B023, E731
        out = f"(SELECT * FROM {out} UNION ALL SELECT {cols(f'-1 - {a}')} FROM {out} WHERE {a} < {n} UNION ALL SELECT {cols(f'{2 * size[a] - 1} - {a}')} FROM {out} WHERE {a} >= {size[a] - n})"
    return out


@query(_with_value(_near_sql(_mirror_sql("sparse", 3, "z"), 1)) + " k WHERE z BETWEEN -2 AND 13 AND y BETWEEN -2 AND 25 AND x BETWEEN -2 AND 25")
def dilation_mirror(spark, sf):
    return G.crop(V.dilate(V.mirrored(sparse(spark, sf), GRID, 3, ("z",)), 1), GRID.widened(2))


_CLOSED = f"(SELECT * FROM {_erode_sql(_box_sql(_near_sql('sparse', 1) + ' q', 3), 1, 3)} WHERE z BETWEEN 0 AND 11 AND y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 23)"


@query(_with_value(_CLOSED))
def close_1(spark, sf):
    return W.close(sparse(spark, sf), GRID, 1, height=4)


@query(_with_value(_CLOSED))
def close_1_kernel(spark, sf):
    return W.close(sparse(spark, sf), GRID, 1)


_OPENED = f"(SELECT * FROM {_near_sql(_erode_sql(_mirror_sql('thick', 3), 1, 3), 1)} WHERE z BETWEEN 0 AND 11 AND y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 23)"


@query(_DENSE_MASK + _with_value(_OPENED))
def open_1_mirror(spark, sf):
    return V.open_(_thick(spark, sf), GRID, 1)


@query(_DENSE_MASK + _with_value(_OPENED))
def open_1_kernel(spark, sf):
    return W.open_(_thick(spark, sf), GRID, 1)


@query(_DENSE_MASK + """, empty AS (SELECT lat.* FROM lat ANTI JOIN thick USING (vol_id, z, y, x)),
near AS (SELECT s.vol_id, (s.z + o.dz)::INT AS z, (s.y + o.dy)::INT AS y, (s.x + o.dx)::INT AS x, min(o.d) AS d FROM empty s, offs o WHERE o.d < 14 GROUP BY 1, 2, 3, 4)
SELECT t.vol_id, t.z, t.y, t.x, coalesce(near.d, 14)::INT AS v FROM thick t LEFT JOIN near USING (vol_id, z, y, x)""")
def chamfer_dt(spark, sf):
    return V.chamfer(_thick(spark, sf), GRID, 4)


# ---- components


_COMPONENTS = """~ nodes AS (SELECT vol_id, z, y, x, (z * 576 + y * 24 + x)::INT AS i FROM sparse),
links AS (SELECT a.vol_id, a.i, b.i AS j FROM nodes a JOIN nodes b ON a.vol_id = b.vol_id AND {near}),
reach AS (SELECT vol_id, i, i AS r FROM nodes UNION SELECT reach.vol_id, links.j, reach.r FROM reach JOIN links ON links.vol_id = reach.vol_id AND links.i = reach.i),
comp AS (SELECT vol_id, i, min(r) AS r FROM reach GROUP BY 1, 2),
sized AS (SELECT nodes.*, comp.r, count(*) OVER (PARTITION BY nodes.vol_id, comp.r) AS n FROM nodes JOIN comp USING (vol_id, i))
"""
_SIX = _COMPONENTS.format(near="abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1")
_FOUR = _COMPONENTS.format(near="a.z = b.z AND abs(a.y - b.y) + abs(a.x - b.x) = 1")
_EIGHT = _COMPONENTS.format(near="a.z = b.z AND greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1")


@query(_SIX + "SELECT vol_id, z, y, x, (dense_rank() OVER (PARTITION BY vol_id ORDER BY r))::INT AS v FROM sized")
def label6(spark, sf):
    return W.labels(sparse(spark, sf), GRID, height=3)


@query(_EIGHT + "SELECT vol_id, z, y, x, (dense_rank() OVER (PARTITION BY vol_id, z ORDER BY r))::INT AS v FROM sized")
def label8_slices(spark, sf):
    return W.slice_labels(sparse(spark, sf), GRID, eight=True)


@query(_SIX + "SELECT vol_id, (dense_rank() OVER (PARTITION BY vol_id ORDER BY r))::INT AS label, count(*) AS n FROM sized GROUP BY vol_id, r")
def label6_sizes(spark, sf):
    return W.labels(sparse(spark, sf), GRID).groupBy("vol_id", F.col("v").alias("label")).agg(F.count("*").alias("n"))


@query(_SIX + "SELECT vol_id, z, y, x, 127 AS v FROM sized WHERE n BETWEEN 3 AND 20")
def nr_extract(spark, sf):
    return W.keep_sizes(sparse(spark, sf), GRID, 3, 20, height=3)


@query(_SIX + "SELECT vol_id, z, y, x FROM sized WHERE n BETWEEN 3 AND 20")
def nr_extract_relational(spark, sf):
    labels = W.labels(sparse(spark, sf), GRID).withColumnRenamed("v", "label")
    return V.size_filter(labels, 3, 20).select(*KEYS)


@query(_FOUR + ", share AS (SELECT *, 100.0::DOUBLE * n / count(*) OVER (PARTITION BY vol_id, z) AS s FROM sized) SELECT vol_id, z, y, x, 127 AS v FROM share WHERE s BETWEEN 2 AND 40")
def slicewise_extract(spark, sf):
    return W.keep_shares(sparse(spark, sf), GRID, 2.0, 40.0)


@query(_FOUR + ", share AS (SELECT *, 100.0::DOUBLE * n / count(*) OVER (PARTITION BY vol_id, z) AS s FROM sized) SELECT vol_id, z, y, x FROM share WHERE s BETWEEN 2 AND 40")
def slicewise_extract_relational(spark, sf):
    labels = W.slice_labels(sparse(spark, sf), GRID).withColumnRenamed("v", "label")
    return V.share_filter(labels, 2.0, 40.0).select(*KEYS)


_BARS = "x <= 6 * (z // 3) + (y // 4) AND z % 3 = 0 AND y % 4 = 1"


@query(f"~ bars AS (SELECT *, 1 + 6 * (z // 3) + (y // 4) AS n FROM lat WHERE {_BARS}), r AS (SELECT *, dense_rank() OVER (PARTITION BY vol_id ORDER BY n DESC) AS k FROM bars) SELECT vol_id, z, y, x, 127 AS v FROM r WHERE k BETWEEN 2 AND 4")
def rank_extract(spark, sf):
    """Components by rank of size: bars of 1 to 24 voxels, so no two are of one size."""
    bars = G.lattice(grey(spark, sf), GRID).where("x <= 6 * (z DIV 3) + (y DIV 4) AND z % 3 = 0 AND y % 4 = 1").withColumn("v", F.lit(1))
    return W.keep_ranks(bars, GRID, 2, 4, height=3)


@query(_SIX + """, edge AS (SELECT DISTINCT vol_id, r FROM sized WHERE z IN (0, 11) OR y IN (0, 23) OR x IN (0, 23))
SELECT s.vol_id, s.z, s.y, s.x, 127 AS v FROM sized s SEMI JOIN edge USING (vol_id, r)""")
def rank_extract_joined(spark, sf):
    return W.keep_ranks(sparse(spark, sf), GRID, 1, 1, join_border=True, height=5)


_HYST = """~ d AS (SELECT lat.vol_id, lat.z, lat.y, lat.x, coalesce(grey.v, 0) AS v FROM lat LEFT JOIN grey USING (vol_id, z, y, x)),
k AS (SELECT *, z - row_number() OVER (PARTITION BY vol_id, y, x ORDER BY z) AS run FROM d WHERE v {op} {weak}),
h AS (SELECT *, max(CASE WHEN v {op} {seed} THEN 1 ELSE 0 END) OVER (PARTITION BY vol_id, y, x, run) AS hit FROM k)
SELECT vol_id, z, y, x, 127 AS v FROM h WHERE hit = 1"""


@query(_HYST.format(op="<=", weak=30, seed=5))
def hysteresis_z(spark, sf):
    return V.hysteresis_z(grey(spark, sf), GRID, 5, 30)


@query(_HYST.format(op=">=", weak=20, seed=70))
def hysteresis_z_high(spark, sf):
    return V.hysteresis_z(grey(spark, sf), GRID, 20, 70, mode=1)


@query(_HYST.format(op="<=", weak=30, seed=5))
def hysteresis_kernel(spark, sf):
    return W.hysteresis(grey(spark, sf), GRID, 5, 30)


# ---- spheres


@query(f"""~ own AS (SELECT *, sqrt(({_ODD})::DOUBLE) * 0.5 AS s FROM field)
SELECT a.vol_id, a.z, a.y, a.x FROM own a WHERE a.s > 0 AND NOT EXISTS (SELECT 1 FROM own b, s2 o WHERE abs(o.dz) <= 1 AND abs(o.dy) <= 1 AND abs(o.dx) <= 1 AND (o.dz <> 0 OR o.dy <> 0 OR o.dx <> 0)
  AND b.vol_id = a.vol_id AND b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx AND b.s > 0 AND sqrt((o.dz * o.dz + o.dy * o.dy + o.dx * o.dx)::DOUBLE) + a.s - b.s <= 0.9::DOUBLE + 1e-9::DOUBLE)""")
def ridge_given_field(spark, sf):
    return V.ridge(field(spark, sf)).select(*KEYS)


_P = ", ".join(f"sign(v{a}) * greatest(abs(v{a}) - 0.5::DOUBLE, 0::DOUBLE) AS p{a}" for a in "zyx")
_DIAM = f"""~ own AS (SELECT *, sqrt(pz * pz + py * py + px * px) AS s FROM (SELECT vol_id, z, y, x, {_P} FROM field)),
st AS (SELECT *, floor(2 * s + 0.5::DOUBLE + 1e-9::DOUBLE)::INT AS plain, {", ".join(f"-round_even(p{a} / (CASE WHEN s = 0 THEN 1 ELSE s END), 0) AS t{a}" for a in "zyx")} FROM own),
j AS (SELECT st.*, b.vol_id IS NOT NULL AS object, {", ".join(f"coalesce(b.p{a}, 0) AS q{a}" for a in "zyx")} FROM st LEFT JOIN own b ON b.vol_id = st.vol_id AND b.z = st.z + st.tz AND b.y = st.y + st.ty AND b.x = st.x + st.tx),
f AS (SELECT *, floor(sqrt({" + ".join(f"(p{a} - t{a} - q{a}) * (p{a} - t{a} - q{a})" for a in "zyx")}) + 0.5::DOUBLE + 1e-9::DOUBLE)::INT AS full_d,
  sqrt({" + ".join(f"(p{a} + t{a} + q{a}) * (p{a} + t{a} + q{a}) / 4" for a in "zyx")}) AS mid, sqrt(qz * qz + qy * qy + qx * qx) AS nq FROM j)
"""


@query(_DIAM + "SELECT vol_id, z, y, x, plain AS v FROM f")
def diameters_v1(spark, sf):
    return V.diameters(field(spark, sf), 1)


@query(_DIAM + "SELECT vol_id, z, y, x, CASE WHEN object AND nq > 0 AND -(qz * pz + qy * py + qx * px) / (greatest(nq, 1e-12::DOUBLE) * greatest(s, 1e-12::DOUBLE)) >= 0.5::DOUBLE - 1e-9::DOUBLE THEN full_d ELSE plain END AS v FROM f")
def diameters_v2(spark, sf):
    return V.diameters(field(spark, sf), 2)


@query(_DIAM + "SELECT vol_id, z, y, x, CASE WHEN mid < 1 - 1e-9::DOUBLE THEN full_d ELSE plain END AS v FROM f")
def diameters_v3(spark, sf):
    return V.diameters(field(spark, sf), 3)


@query("""~ cen AS (SELECT vol_id, z, y, x, ((z + y + x) % 5 + 1)::INT AS d FROM sparse)
SELECT c.vol_id, (c.z + o.dz)::INT AS z, (c.y + o.dy)::INT AS y, (c.x + o.dx)::INT AS x, max(c.d)::INT AS v FROM cen c, s2 o
WHERE 4 * (o.dz * o.dz + o.dy * o.dy + o.dx * o.dx) <= (c.d + 1) * (c.d + 1) + 1e-6::DOUBLE AND c.z + o.dz BETWEEN 0 AND 11 AND c.y + o.dy BETWEEN 0 AND 23 AND c.x + o.dx BETWEEN 0 AND 23 GROUP BY 1, 2, 3, 4""")
def sphere_cover(spark, sf):
    return V.cover(sparse(spark, sf).withColumn("v", ((F.col("z") + F.col("y") + F.col("x")) % 5 + 1).cast("int")), GRID, 5)


@query()
def vector_dt(spark, sf):
    return W.nearest_contact(_thick(spark, sf), GRID)


def _region(spark, sf):
    return G.lattice(grey(spark, sf), GRID).where("y BETWEEN 2 AND 21 AND x BETWEEN 2 AND 21").withColumn("v", F.lit(127))


@query()
def dt_thickness(spark, sf):
    return W.sphere_map(_thick(spark, sf), _region(spark, sf), GRID, "thickness")


@query()
def dt_spacing(spark, sf):
    return W.sphere_map(sparse(spark, sf), _region(spark, sf), GRID, "spacing")


@query()
def dt_number(spark, sf):
    return W.sphere_map(_thick(spark, sf), _region(spark, sf), GRID, "number")


# ---- contours


@query("""SELECT m.vol_id, m.z, m.y, m.x, 127 AS v FROM sparse m WHERE EXISTS (SELECT 1 FROM sparse n WHERE n.vol_id = m.vol_id AND n.z = m.z AND n.y = m.y AND abs(n.x - m.x) = 1)
  OR (SELECT count(*) FROM sparse n WHERE n.vol_id = m.vol_id AND n.z = m.z AND n.x = m.x AND abs(n.y - m.y) = 1) = 2""")
def phase1(spark, sf):
    return V.without_spikes(sparse(spark, sf))


_DIAMOND = """~ chain AS (SELECT vol_id, z, 0 AS contour, t.range::INT AS i, (12 + CASE WHEN k < r THEN k WHEN k < 3 * r THEN 2 * r - k ELSE k - 4 * r END)::INT AS x, (11 + CASE WHEN k < 2 * r THEN k - r ELSE 3 * r - k END)::INT AS y
  FROM (SELECT DISTINCT vol_id, z, 3 + z % 7 AS r FROM grey), range(40) t, (SELECT 0) q, LATERAL (SELECT t.range::INT AS k) WHERE k < 4 * r)
"""


def _diamond(spark, sf):
    k, r = F.col("i"), F.col("r")
    c = grey(spark, sf).select("vol_id", "z").distinct().withColumn("r", 3 + F.col("z") % 7).withColumn("i", F.explode(F.sequence(F.lit(0), 4 * r - 1)))
    x = F.lit(12) + F.when(k < r, k).when(k < 3 * r, 2 * r - k).otherwise(k - 4 * r)
    y = F.lit(11) + F.when(k < 2 * r, k - r).otherwise(3 * r - k)
    return c.select("vol_id", "z", F.lit(0).alias("contour"), "i", x.cast("int").alias("x"), y.cast("int").alias("y"))


@query(_DIAMOND + """, e AS (SELECT *, lead(x, 1, first_x) OVER w AS x1, lead(y, 1, first_y) OVER w AS y1 FROM (SELECT *, first(x) OVER w AS first_x, first(y) OVER w AS first_y FROM chain WINDOW w AS (PARTITION BY vol_id, z ORDER BY i)) WINDOW w AS (PARTITION BY vol_id, z ORDER BY i)),
c AS (SELECT vol_id, z, least(y, y1) AS y, CASE WHEN y < y1 THEN x ELSE x1 END AS cx FROM e WHERE y <> y1)
SELECT l.vol_id, l.z, 0 AS contour, l.y, l.x FROM lat l WHERE (SELECT count(*) FROM c WHERE c.vol_id = l.vol_id AND c.z = l.z AND c.y = l.y AND c.cx < l.x) % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM chain h WHERE h.vol_id = l.vol_id AND h.z = l.z AND h.y = l.y AND h.x = l.x)""")
def polygon_fill(spark, sf):
    return V.polygon_fill(_diamond(spark, sf), 24)


@query(_DIAMOND + """, s AS (SELECT *, lead(x, 1, first_x) OVER w - x AS dx, lead(y, 1, first_y) OVER w - y AS dy FROM (SELECT *, first(x) OVER w AS first_x, first(y) OVER w AS first_y FROM chain WINDOW w AS (PARTITION BY vol_id, z ORDER BY i)) WINDOW w AS (PARTITION BY vol_id, z ORDER BY i))
SELECT vol_id, z, i, (CASE WHEN dx = 1 AND dy = 0 THEN 0 WHEN dx = 1 AND dy = -1 THEN 1 WHEN dx = 0 AND dy = -1 THEN 2 WHEN dx = -1 AND dy = -1 THEN 3 WHEN dx = -1 AND dy = 0 THEN 4 WHEN dx = -1 AND dy = 1 THEN 5 WHEN dx = 0 AND dy = 1 THEN 6 ELSE 7 END)::INT AS code FROM s""")
def chain_encode(spark, sf):
    return X.chain_codes(_diamond(spark, sf), "vol_id", "z")


@query(_DIAMOND + "SELECT vol_id, z, i, x, y FROM chain")
def chain_decode(spark, sf):
    d = _diamond(spark, sf)
    first = Window.partitionBy("vol_id", "z").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = d.select("vol_id", "z", "i", F.first("x").over(first).alias("x0"), F.first("y").over(first).alias("y0"))
    return X.chain_path(X.chain_codes(d, "vol_id", "z").join(start, ["vol_id", "z", "i"]), "vol_id", "z")


def _blob(spark, sf):
    disc = G.lattice(grey(spark, sf), GRID).where("(2 * y - 23) * (2 * y - 23) + (2 * x - 23) * (2 * x - 23) <= 420").withColumn("v", F.lit(127))
    return V.without(disc, sparse(spark, sf).where("y > 8"))


@query()
def contour_chains(spark, sf):
    return W.chains(_blob(spark, sf), GRID)


@query()
def render_volume(spark, sf):
    return W.render(_blob(spark, sf), GRID)


# ---- frequency and pipelines


@query()
def lh_threshold(spark, sf):
    grid = Grid(GRID.shape, el=(0.0607, 0.0607, 0.0607))
    return W.frequency_threshold(grey(spark, sf).withColumn("v", F.col("v") * 400), grid)


@query(_SIX + ", cort AS (SELECT s.* FROM sized s SEMI JOIN shifted USING (vol_id, z, y, x) WHERE n >= 3), trab AS (SELECT s.* FROM sized s ANTI JOIN shifted USING (vol_id, z, y, x) WHERE n >= 5) SELECT vol_id, z, y, x, 127 AS v FROM cort UNION ALL SELECT vol_id, z, y, x, 126 FROM trab")
def seg_assembly(spark, sf):
    labels = W.labels(sparse(spark, sf), GRID).withColumnRenamed("v", "label")
    s = shifted(spark, sf)
    cort = V.mask_by(V.size_filter(labels, 3), s).select(*KEYS, F.lit(127).alias("v"))
    trab = V.without(V.size_filter(labels, 5), s).select(*KEYS, F.lit(126).alias("v"))
    return V.overlay(cort, trab)


def cylinder(spark, sf: str) -> tuple[DataFrame, DataFrame, Grid]:
    """Analytic scans, one for every 200 suppliers: a shell, marrow with rods of a density from their balances, and soft tissue."""
    grid = Grid((40, 90, 90), (300, 200, 100), (0.06069973,) * 3)
    group = F.concat(F.lit("cyl"), F.floor(F.col("s_suppkey") / 200).cast("string")).alias("vol_id")
    scans = _t(spark, sf, "supplier").groupBy(group).agg((9000 + F.pmod(F.floor(F.sum("s_acctbal")), F.lit(600))).cast("int").alias("rod"))
    y, x = F.col("y") - 200, F.col("x") - 100
    r2 = (2 * y - 89) * (2 * y - 89) + (2 * x - 89) * (2 * x - 89)
    v = F.when(r2 > 6400, 300).when(r2 >= 4096, 12000).when((r2 < 3136) & (x % 8 < 3) & (y % 8 < 3), F.col("rod")).otherwise(1000)
    return G.lattice(scans, grid, "rod").select(*KEYS, v.cast("int").alias("v")), G.lattice(scans, grid).where(r2 <= 6400).withColumn("v", F.lit(127)), grid


_SMALL = Compartments(corner_least=200, close_last=15)


@query()
def compartment_labels(spark, sf):
    scan, contour, grid = cylinder(spark, sf)
    return compartments(scan, contour, grid, _SMALL)


@query()
def compartment_stages(spark, sf):
    scan, contour, grid = cylinder(spark, sf)
    return compartment_steps(scan, contour, grid, _SMALL)


@query()
def pore_cascade(spark, sf):
    scan, contour, grid = cylinder(spark, sf)
    y, x = F.col("y") - 200, F.col("x") - 100
    r2 = (2 * y - 89) * (2 * y - 89) + (2 * x - 89) * (2 * x - 89)
    ring = contour.where(r2 >= 4096)
    hole = (F.col("z") % 9 < 5) & (y.between(42, 44) | x.between(42, 44)) & r2.between(4900, 5476)
    return pores(ring, ring.where(~hole), grid, Pores(least=5))


@query("""~ p AS (SELECT * FROM mask WHERE (z + y + x) % 7 = 0)
SELECT vol_id, count(p.v) AS pore_voxels, count(CASE WHEN p.v IS NOT NULL AND s.v IS NOT NULL THEN 1 END) AS pore_in_mask, count(s.v) AS mask_voxels, count(CASE WHEN p.v IS NOT NULL AND s.v IS NOT NULL THEN 1 END)::DOUBLE / count(s.v) AS ct_po
FROM p FULL JOIN shifted s USING (vol_id, z, y, x) GROUP BY 1""")
def ct_po(spark, sf):
    return S.ct_po(mask(spark, sf).where("(z + y + x) % 7 = 0"), shifted(spark, sf))


@query()
def morphometry(spark, sf):
    scan, contour, grid = cylinder(spark, sf)
    return evaluate_apart(scan, contour, grid, Evaluation(compartments=_SMALL, maps=Maps(which=("TRAB_TH", "TRAB_SP", "TRAB_1N", "CORT_TH", "TRAB_TH_old"))))


# ---- statistics


@query("""~ d AS (SELECT vol_id, v * 0.0607::DOUBLE AS mm FROM grey WHERE v > 30), mm AS (SELECT vol_id, avg(mm) AS mean FROM d GROUP BY 1),
k AS (SELECT d.vol_id, count(*) AS n, any_value(mean) AS mean, max(mm) AS mx, avg(pow(mm - mean, 2)) AS m2, avg(pow(mm - mean, 3)) AS m3, avg(pow(mm - mean, 4)) AS m4 FROM d JOIN mm USING (vol_id) GROUP BY 1),
o AS (SELECT vol_id, count(*) AS size FROM grey GROUP BY 1)
SELECT o.vol_id, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean_mm, coalesce(sqrt(m2), 0) AS sd_mm, coalesce(mx, 0) AS max_mm, CASE WHEN n > 2 AND m2 > 0 THEN m3 / pow(m2, 1.5::DOUBLE) ELSE 0 END AS skew,
  CASE WHEN n > 2 AND m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END AS kurtosis, coalesce(n, 0)::DOUBLE / greatest(size, 1) AS valid_fraction FROM o LEFT JOIN k USING (vol_id)""")
def map_statistics(spark, sf):
    g = G.crop(grey(spark, sf), GRID)
    return S.map_statistics(g.where("v > 30"), g, 0.0607)


@query("SELECT vol_id, count(m.v) AS bv, count(*) AS tv, count(m.v)::DOUBLE / count(*) AS bv_tv, count(m.v) * pow(0.0607::DOUBLE, 3) AS bv_mm3, count(*) * pow(0.0607::DOUBLE, 3) AS tv_mm3 FROM shifted s LEFT JOIN mask m USING (vol_id, z, y, x) GROUP BY 1")
def bv_tv(spark, sf):
    return S.volume_fraction(mask(spark, sf), shifted(spark, sf), 0.0607)


@query("SELECT vol_id, avg(coalesce(g.v, 0)::DOUBLE / 8192 * 1619.07703::DOUBLE + (-394.095001)::DOUBLE) AS bmd_mean, stddev_pop(coalesce(g.v, 0)::DOUBLE / 8192 * 1619.07703::DOUBLE + (-394.095001)::DOUBLE) AS bmd_sd, count(*) AS n FROM shifted s LEFT JOIN grey g USING (vol_id, z, y, x) GROUP BY 1")
def density(spark, sf):
    return S.density(grey(spark, sf), shifted(spark, sf), 1619.07703, -394.095001, 8192.0)


@query("SELECT vol_id, v % 9 AS v, count(*) AS n FROM grey GROUP BY 1, 2")
def value_histogram(spark, sf):
    return S.value_histogram(grey(spark, sf).withColumn("v", F.col("v") % 9))


_JOINT = """~ a AS (SELECT vol_id, z, y, x, v // 20 AS p FROM grey), b AS (SELECT vol_id, z, y, (x + 1) % 24 AS x, v // 20 AS q FROM grey),
jh AS (SELECT vol_id, coalesce(p, 0)::INT AS ours, coalesce(q, 0)::INT AS ref, count(*) AS n FROM a FULL JOIN b USING (vol_id, z, y, x) GROUP BY 1, 2, 3)
"""


def _two_maps(spark, sf):
    a = grey(spark, sf).withColumn("v", F.floor(F.col("v") / 20).cast("int"))
    return a, a.withColumn("x", (F.col("x") + 1) % 24)


@query(_JOINT + "SELECT * FROM jh WHERE NOT (ours = 0 AND ref = 0) UNION ALL SELECT vol_id, 0, 0, (6912 - sum(n) FILTER (WHERE NOT (ours = 0 AND ref = 0)))::BIGINT FROM jh GROUP BY 1")
def joint_histogram(spark, sf):
    return S.joint_histogram(*_two_maps(spark, sf), GRID)


_SUMM = ", ".join(
    f"coalesce(sum(n * {v}) FILTER (WHERE {v} > 0) / sum(n) FILTER (WHERE {v} > 0)::DOUBLE, 0) AS {n}_mean, coalesce(sqrt(greatest(sum(n * {v} * {v}) FILTER (WHERE {v} > 0) / sum(n) FILTER (WHERE {v} > 0)::DOUBLE - pow(sum(n * {v}) FILTER (WHERE {v} > 0) / sum(n) FILTER (WHERE {v} > 0)::DOUBLE, 2), 0)), 0) AS {n}_sd, coalesce(max({v}) FILTER (WHERE {v} > 0), 0)::INT AS {n}_max"
    for v, n in (("ours", "ours"), ("ref", "ref"))
)
_COUNT = lambda w: f"coalesce(sum(n) FILTER (WHERE {w}), 0)::BIGINT"


@query(f"""~ s AS (SELECT vol_id, sum(n)::BIGINT AS total, {_COUNT("ours <> ref")} AS mismatches, {_COUNT("ours <> 0 AND ref = 0")} AS ours_only, {_COUNT("ours = 0 AND ref <> 0")} AS ref_only, {_COUNT("ours <> 0 AND ref <> 0 AND ours <> ref")} AS both_differ,
  {_COUNT("ours <> 0")} AS ours_support, {_COUNT("ref <> 0")} AS ref_support, {_SUMM}, CASE WHEN {_COUNT("ours <> 0 OR ref <> 0")} = 0 THEN 1 ELSE {_COUNT("ours = ref AND ours <> 0")}::DOUBLE / {_COUNT("ours <> 0 OR ref <> 0")} END AS exact_fraction FROM joint GROUP BY 1)
SELECT *, ours_mean * 0.0607::DOUBLE AS ours_mean_mm, ref_mean * 0.0607::DOUBLE AS ref_mean_mm FROM s""")
def summarize_joint(spark, sf):
    return S.summarize_joint(joint(spark, sf), 0.0607)


@query("SELECT ours, ref, sum(n)::BIGINT AS n FROM joint GROUP BY 1, 2")
def pooled_joint(spark, sf):
    return S.pooled_joint(joint(spark, sf))


@query("""~ c AS (SELECT vol_id, n::DOUBLE AS w, ours::DOUBLE AS p, ref::DOUBLE AS q FROM joint WHERE NOT (ours = 0 AND ref = 0)),
m AS (SELECT vol_id, sum(w * p) / sum(w) AS mp, sum(w * q) / sum(w) AS mq FROM c GROUP BY 1),
g AS (SELECT vol_id, sum(w)::BIGINT AS n, sum(w * (q - mq) * (q - mq)) AS sqq, sum(w * (p - mp) * (q - mq)) AS spq, sum(w * (p - mp) * (p - mp)) AS spp, any_value(mp) AS mp, any_value(mq) AS mq, sum(CASE WHEN p = q THEN w ELSE 0 END) / sum(w) AS exact_fraction FROM c JOIN m USING (vol_id) GROUP BY 1)
SELECT vol_id, n, spq / sqq AS slope, mp - spq / sqq * mq AS intercept, spq * spq / (sqq * spp) AS r2, exact_fraction FROM g""")
def voxelwise_regression(spark, sf):
    return S.voxelwise_regression(joint(spark, sf), "vol_id")


@query("""~ c AS (SELECT vol_id, count(a.v) AS ours, count(b.v) AS ref, count(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 1 END) AS shared FROM mask a FULL JOIN shifted b USING (vol_id, z, y, x) GROUP BY 1)
SELECT vol_id, ours, ref, ours + ref - 2 * shared AS mismatch, ours - shared AS ours_only, ref - shared AS ref_only, 2.0::DOUBLE * shared / (ours + ref) AS dice FROM c""")
def compare_masks(spark, sf):
    return S.compare_masks(mask(spark, sf), shifted(spark, sf))


@query("SELECT vol_id, count(*) AS both_set, count(*) FILTER (WHERE a.v % 3 <> b.v % 3) AS differ FROM grey a JOIN (SELECT vol_id, z, y, (x + 1) % 24 AS x, v FROM grey) b USING (vol_id, z, y, x) WHERE a.v % 3 <> 0 AND b.v % 3 <> 0 GROUP BY 1")
def compare_labels(spark, sf):
    a = grey(spark, sf).withColumn("v", F.col("v") % 3)
    return S.compare_labels(a, a.withColumn("x", (F.col("x") + 1) % 24))


@query("~ r AS (SELECT *, (row_number() OVER (PARTITION BY vol_id ORDER BY n DESC, ours, ref))::INT AS rank FROM joint WHERE ours <> ref) SELECT * FROM r WHERE rank <= 12")
def value_pairs_topk(spark, sf):
    return S.value_pairs(joint(spark, sf))


@query("~ d AS (SELECT vol_id, z, y, x, coalesce(a.v // 20, 0)::INT AS ours, coalesce(b.q, 0)::INT AS ref FROM grey a FULL JOIN (SELECT vol_id, z, y, (x + 1) % 24 AS x, v // 20 AS q FROM grey) b USING (vol_id, z, y, x)) SELECT * FROM d WHERE ours <> ref ORDER BY vol_id, z, y, x LIMIT 40")
def mismatch_locations(spark, sf):
    return S.mismatches(*_two_maps(spark, sf), 40)


@query("SELECT cohort, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM pairs GROUP BY 1")
def ols_pair(spark, sf):
    return S.ols(pairs(spark, sf), "cohort")


@query("""~ m AS (SELECT cohort, avg(x) AS mx, avg(y) AS my FROM pairs GROUP BY 1),
g AS (SELECT cohort, count(*)::DOUBLE AS n, sum(2 * pow((x + y) / 2 - (mx + my) / 2, 2)) AS rws, sum(pow(x - (x + y) / 2 - mx + (mx + my) / 2, 2) + pow(y - (x + y) / 2 - my + (mx + my) / 2, 2)) AS err, any_value(mx) AS mx, any_value(my) AS my FROM pairs JOIN m USING (cohort) GROUP BY 1),
k AS (SELECT cohort, n, rws / (n - 1) AS msr, err / (n - 1) AS mse, n * (pow(mx - (mx + my) / 2, 2) + pow(my - (mx + my) / 2, 2)) AS msc FROM g)
SELECT cohort, n::BIGINT AS n, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc FROM k""")
def icc21(spark, sf):
    return S.icc(pairs(spark, sf), "cohort")


@query("SELECT cohort, count(*) AS n, avg(y - x) AS bias, stddev_samp(y - x) AS sd, max(abs(y - x)) AS max_abs, avg(y - x) - 1.96::DOUBLE * stddev_samp(y - x) AS loa_low, avg(y - x) + 1.96::DOUBLE * stddev_samp(y - x) AS loa_high FROM pairs GROUP BY 1")
def bland_altman(spark, sf):
    return S.bland_altman(pairs(spark, sf), "cohort")


@query("""~ d AS (SELECT *, CASE WHEN abs(y - x) <= 1e-12::DOUBLE * greatest(1, abs(x)) THEN 0 ELSE y - x END AS d FROM pairs)
SELECT cohort, count(*) AS n, count(*) FILTER (WHERE d = 0) AS identical, avg(d) AS bias, stddev_samp(d) AS sd, max(abs(d)) AS max_abs, avg(abs(d)) AS mean_abs, max(CASE WHEN x <> 0 THEN abs(d / x) * 100 END) AS max_rel_pct, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM d GROUP BY 1""")
def stats_pair(spark, sf):
    return S.stats_pair(pairs(spark, sf), "cohort")


@query("""~ d AS (SELECT cohort, round(y / 1000) - round(x / 1000) AS d FROM pairs), r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY cohort, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM d WHERE d <> 0 WINDOW w AS (PARTITION BY cohort ORDER BY abs(d))),
t AS (SELECT cohort, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT cohort, abs(d) AS a, count(*) AS c FROM d WHERE d <> 0 GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT cohort, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus FROM r GROUP BY 1)
SELECT g.cohort, n, w_plus, (w_plus - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM g JOIN t USING (cohort)""")
def wilcoxon(spark, sf):
    p = pairs(spark, sf).select("cohort", F.round(F.col("x") / 1000).alias("x"), F.round(F.col("y") / 1000).alias("y"))
    return S.wilcoxon(p, "cohort")


@query("SELECT cohort, count(y) AS n, min(y) AS min, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3, max(y) AS max, avg(y) AS mean FROM pairs GROUP BY 1")
def quantiles(spark, sf):
    return S.quantiles(pairs(spark, sf), "y", "cohort")


@query("""~ g AS (SELECT o_orderstatus AS a, o_orderpriority AS b, o_totalprice AS p FROM orders)
SELECT CASE WHEN grouping(a) = 0 THEN 'a' WHEN grouping(b) = 0 THEN 'b' ELSE '' END AS block, coalesce(a, b, 'ALL') AS value, count(*) AS n, avg(p) AS mean_p FROM g GROUP BY GROUPING SETS ((), (a), (b))""")
def grouping_sets_summary(spark, sf):
    g = _t(spark, sf, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_totalprice").alias("p"))
    return S.grouping_summary(g, ["p"], ["a", "b"])


@query("""~ b AS (SELECT s_nationkey AS k, s_suppkey, s_nationkey % 5 AS mismatch, 1000 + s_suppkey AS voxels, 1 - (s_suppkey % 7) / 50000.0::DOUBLE AS dice FROM supplier)
SELECT (k % 3)::INT AS grp, count(*) AS scans, sum(mismatch)::BIGINT AS mismatch, sum(voxels)::BIGINT AS voxels, count(*) FILTER (WHERE mismatch = 0) AS exact, quantile_cont(dice, 0.5) AS dice_median, min(dice) AS dice_min, count(*) FILTER (WHERE dice >= 0.9999::DOUBLE) AS dice_high, 1e6::DOUBLE * sum(mismatch) / sum(voxels) AS ppm FROM b GROUP BY 1""")
def group_summary(spark, sf):
    s = _t(spark, sf, "supplier").select((F.col("s_nationkey") % 3).cast("int").alias("grp"), (F.col("s_nationkey") % 5).alias("mismatch"), (1000 + F.col("s_suppkey")).alias("voxels"), (F.lit(1.0) - (F.col("s_suppkey") % 7) / F.lit(50000.0)).alias("dice"))
    return S.pooled_block(s, "grp")


@query("""~ p AS (SELECT o_orderpriority AS priority, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END), NULL)::BIGINT AS F, sum(CASE WHEN o_orderstatus = 'O' THEN 1 END)::BIGINT AS O, sum(CASE WHEN o_orderstatus = 'P' THEN 1 END)::BIGINT AS P FROM orders GROUP BY 1)
SELECT * FROM p UNION ALL SELECT 'TOTAL', sum(F)::BIGINT, sum(O)::BIGINT, sum(P)::BIGINT FROM p""")
def sample_pivot(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderstatus", F.lit(1).alias("one"))
    return S.pivot_with_total(o, "priority", "o_orderstatus", "one", ["F", "O", "P"])


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def exclusions(spark, sf):
    return S.exclude(_t(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("~ c AS (SELECT vol_id, v % 5 AS k, count(*) AS n FROM grey GROUP BY 1, 2) SELECT vol_id, string_agg(k || ' ' || n, ', ' ORDER BY k) AS breakdown FROM c GROUP BY 1")
def breakdown(spark, sf):
    return S.breakdown(grey(spark, sf).withColumn("k", F.col("v") % 5), "k", "vol_id")


@query("""~ u AS (SELECT vol_id, z, y, x, 1 AS b FROM mask UNION ALL SELECT vol_id, z, y, x, 2 FROM shifted UNION ALL SELECT vol_id, z, y, x, 4 FROM sparse), b AS (SELECT vol_id, bit_or(b) AS b FROM u GROUP BY vol_id, z, y, x)
SELECT vol_id, count(*) FILTER (WHERE b & 1 > 0 AND b & 2 > 0) AS mask_and_shifted, count(*) FILTER (WHERE b & 1 > 0 AND b & 4 > 0) AS mask_and_sparse, count(*) FILTER (WHERE b & 2 > 0 AND b & 4 > 0) AS shifted_and_sparse,
 count(*) FILTER (WHERE b & 1 > 0 AND b & 2 = 0) AS mask_not_shifted, count(*) FILTER (WHERE b & 1 > 0 AND b & 4 = 0) AS mask_not_sparse, count(*) FILTER (WHERE b & 2 > 0 AND b & 1 = 0) AS shifted_not_mask,
 count(*) FILTER (WHERE b & 2 > 0 AND b & 4 = 0) AS shifted_not_sparse, count(*) FILTER (WHERE b & 4 > 0 AND b & 1 = 0) AS sparse_not_mask, count(*) FILTER (WHERE b & 4 > 0 AND b & 2 = 0) AS sparse_not_shifted FROM b GROUP BY 1""")
def consistency_checks(spark, sf):
    return S.consistency({"mask": mask(spark, sf), "shifted": shifted(spark, sf), "sparse": sparse(spark, sf)})


# ---- text and logs


_LOG = "concat('Created by scan', chr(10), 'Mu_Scaling   ', event_id % 9000 + 1, chr(10), 'Density: slope ', (user_id % 97 + 1) * 16, '.5', chr(10), 'Density: intercept -', event_id % 400, '.25  ', chr(10))"


def _logs(spark, sf):
    e = _t(spark, sf, "events")
    text = F.concat(F.lit("Created by scan\nMu_Scaling   "), F.col("event_id") % 9000 + 1, F.lit("\nDensity: slope "), (F.col("user_id") % 97 + 1) * 16, F.lit(".5\nDensity: intercept -"), F.col("event_id") % 400, F.lit(".25  \n"))
    return e.select("event_id", text.alias("log"))


@query(f"SELECT event_id, regexp_extract(log, 'Density:\\s*slope\\s+([-+0-9.eE]+)', 1)::DOUBLE AS slope, regexp_extract(log, 'Density:\\s*intercept\\s+([-+0-9.eE]+)', 1)::DOUBLE AS intercept, regexp_extract(log, 'Mu_Scaling\\s+([-+0-9.eE]+)', 1)::DOUBLE AS mu_scaling, regexp_extract(log, '(?m)^Density: intercept\\s+(.*?)\\s*$', 1) AS line FROM (SELECT event_id, {_LOG} AS log FROM events)")
def proclog_fields(spark, sf):
    logs = _logs(spark, sf)
    fields = X.calibration(F.col("log"))
    return logs.select("event_id", *[c.alias(n) for n, c in fields.items()], X.log_field(F.col("log"), "Density: intercept").alias("line"))


@query("""~ b AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS block, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, block::BIGINT AS block, max(run)::BIGINT AS run, count(*) AS lines, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::INT AS failed FROM b GROUP BY 1, 2""")
def log_blocks(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_id", "event_type")
    b = X.command_blocks(e, F.col("event_type") == "signup", F.col("event_type") == "purchase", "user_id", order="event_id")
    return b.groupBy("user_id", "block").agg(F.max("run").alias("run"), F.count("*").alias("lines"), F.max((F.col("event_type") == "error").cast("int")).alias("failed"))


@query("""~ r AS (SELECT user_id % 50 AS k, event_id AS run, floor(epoch(ts))::BIGINT AS start, floor(epoch(ts))::BIGINT + 40000 AS stop FROM events WHERE event_type = 'signup'), p AS (SELECT user_id % 50 AS k, floor(epoch(ts))::BIGINT AS ts FROM events WHERE event_type = 'error'),
s AS (SELECT r.k, run, start, stop, count(*) FILTER (WHERE ts BETWEEN start AND stop) AS inside, count(*) FILTER (WHERE ts > stop) AS after FROM r LEFT JOIN p ON r.k = p.k GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN after > 0 THEN 1 ELSE 0 END, inside - after DESC, inside DESC, start DESC, run) AS place FROM s)
SELECT k, run, start, stop AS "end", inside, after FROM o WHERE place = 1""")
def run_choice_interval(spark, sf):
    e = _t(spark, sf, "events").withColumn("k", F.col("user_id") % 50).withColumn("t", F.unix_timestamp("ts"))
    runs = e.where("event_type = 'signup'").select("k", F.col("event_id").alias("run"), F.col("t").alias("start"), (F.col("t") + 40000).alias("end"))
    return X.choose_run(runs, e.where("event_type = 'error'").select("k", F.col("t").alias("ts")), "k")


@query("SELECT event_id, 'Tb_' || (event_id % 9) AS name, (user_id / 8.0::DOUBLE) AS value, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'mm' END AS unit FROM events UNION ALL SELECT event_id, 'Count', -event_id::DOUBLE, '' FROM events")
def metric_lines(spark, sf):
    e = _t(spark, sf, "events")
    text = F.concat(F.lit("header\n!> Tb_"), F.col("event_id") % 9, F.lit(" = "), F.col("user_id") / 8.0, F.when(F.col("event_id") % 3 == 0, "").otherwise(" [mm]"), F.lit("\nother = 4\n!> Count = -"), F.col("event_id"), F.lit("\n"))
    return e.select("event_id", F.explode(X.metric_lines(text)).alias("m")).select("event_id", "m.name", "m.value", "m.unit")


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'segmentation' WHEN 1 THEN 'trabecular mask' WHEN 2 THEN 'cortical contour' WHEN 3 THEN 'thickness map' WHEN 4 THEN 'log' WHEN 5 THEN 'image' WHEN 6 THEN 'contour' ELSE 'other' END AS kind FROM events""")
def file_classify(spark, sf):
    names = ["X1_SEG.AIM", "X1_trab_mask.aim", "X1_CORT_MASK.GOBJ;1", "X1_TH.AIM", "JOB.LOG", "X1.AIM;2", "A.GOBJ", "notes.pdf"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 8 + 1).cast("int"))
    return _t(spark, sf, "events").select("event_id", X.file_kind(name).alias("kind"))


@query("SELECT page_id, 'scan.id' AS parameter, page_id::VARCHAR AS value FROM pages UNION ALL SELECT page_id, 'scan.size', (page_id % 7) || ' ' || (page_id % 3) FROM pages UNION ALL SELECT page_id, 'url', url FROM pages")
def record_flatten(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", "url", F.struct(F.col("page_id").alias("id"), F.array(F.col("page_id") % 7, F.col("page_id") % 3).alias("size")).alias("scan"))
    return X.long_form(p, "page_id")


def _runs(spark, sf):
    e = _t(spark, sf, "events")
    return e.select((F.col("user_id") % 20).alias("k"), F.col("event_id").alias("i"), F.length("event_type").cast("int").alias("value"), (1 + F.col("event_id") % 7).cast("int").alias("n"))


@query("""~ r AS (SELECT user_id % 20 AS k, event_id AS i, length(event_type)::INT AS v, 1 + event_id % 7 AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY i) - n AS start FROM r)
SELECT k, v, (start + unnest(range(n)))::BIGINT AS pos FROM s""")
def rle_char_decode(spark, sf):
    return X.run_length(_runs(spark, sf), "k")


@query("""~ r AS (SELECT user_id % 20 AS k, event_id AS i, CASE WHEN event_id % 5 = 0 THEN 255 ELSE 1 + event_id % 9 END AS n FROM events),
s AS (SELECT *, sum(CASE WHEN n = 255 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) - CASE WHEN n = 255 THEN 0 ELSE 1 END AS t FROM r)
SELECT k, i, (t % 2)::INT AS bit, (CASE WHEN n = 255 THEN 254 ELSE n END)::INT AS n FROM s""")
def rle_bits_decode(spark, sf):
    r = _runs(spark, sf).withColumn("n", F.when(F.col("i") % 5 == 0, 255).otherwise((1 + F.col("i") % 9).cast("int")))
    return X.bit_runs(r, "k")


@query("""~ u AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS u FROM events), w AS (SELECT event_id, u % 65536 AS lo, u // 65536 AS hi FROM u), f AS (SELECT event_id, lo // 32768 AS s, (lo // 128) % 256 AS e, (lo % 128) * 65536 + hi AS m FROM w)
SELECT event_id, CASE WHEN e = 0 THEN 0 ELSE (CASE WHEN s = 1 THEN -1 ELSE 1 END) * (0.5::DOUBLE + m / 16777216::DOUBLE) * pow(2::DOUBLE, (e - 128)::DOUBLE) END AS value FROM f""")
def vax_float(spark, sf):
    return _t(spark, sf, "events").select("event_id", X.vax_float((F.col("event_id") * 2654435761) % 4294967296).alias("value"))


@query("SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+\\.[a-z]+') THEN 'mail' END, CASE WHEN regexp_matches(text, '[0-9]{3}[- ][0-9]{3}[- ][0-9]{4}') THEN 'phone' END], lambda x: x IS NOT NULL).array_to_string(' ') AS found FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+\\.[a-z]+') OR regexp_matches(text, '[0-9]{3}[- ][0-9]{3}[- ][0-9]{4}')")
def identifier_scan(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "text")
    found = X.find_identifiers(d, "text", {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+", "phone": "[0-9]{3}[- ][0-9]{3}[- ][0-9]{4}"})
    return found.select("doc_id", F.array_join("found", " ").alias("found"))


# ---- decisions


_SCORES = "SELECT l_orderkey AS vol_id, 'p' || l_linenumber AS preset, sum(l_quantity) AS score, l_linenumber = 1 AS first FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(f"""~ s AS ({_SCORES}), b AS (SELECT *, max(CASE WHEN first THEN score END) OVER (PARTITION BY vol_id) AS base FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY vol_id ORDER BY CASE WHEN first OR score < 0.5::DOUBLE * base THEN score END ASC NULLS LAST, first::INT DESC, preset) AS place FROM b)
SELECT vol_id, preset, score FROM r WHERE place = 1""")
def preset_fallback(spark, sf):
    li = _t(spark, sf, "lineitem")
    s = li.groupBy(F.col("l_orderkey").alias("vol_id"), "l_linenumber").agg(F.sum("l_quantity").alias("score"))
    return D.choose_preset(s.select("vol_id", F.concat(F.lit("p"), "l_linenumber").alias("preset"), "score", (F.col("l_linenumber") == 1).alias("first")))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'derived' WHEN s_nationkey < s_suppkey % 20 THEN 'raw' ELSE 'derived' END AS cortical, CASE WHEN s_suppkey % 3 = 0 THEN 'seg' ELSE 'tight' END AS grid,
CASE WHEN s_suppkey % 5 = 0 AND s_nationkey % 2 = 0 THEN 'automatic' WHEN s_suppkey % 7 = 0 OR s_nationkey % 2 > 0 THEN 'corrected' ELSE 'undecided' END AS contour FROM supplier""")
def rule_decisions(spark, sf):
    s, k, n = _t(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_nationkey")
    return s.select("s_suppkey", D.cortical_rule(k % 4 == 0, n, k % 20).alias("cortical"), D.grid_rule(k % 3 == 0).alias("grid"), D.contour_verdict(k % 5, k % 7, n % 2).alias("contour"))


@query("SELECT o_custkey, (min(struct_pack(m := o_orderkey % 50, p := o_orderpriority))).p AS choice, min(o_orderkey % 50) AS mismatch FROM orders GROUP BY 1")
def assembly_best(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("choice"), (F.col("o_orderkey") % 50).alias("mismatch"))
    return D.best_of(o, "o_custkey", "choice", "mismatch")


@query("""~ a AS (SELECT user_id AS k, event_type AS fact, max(event_id % 3) AS value FROM events GROUP BY 1, 2), b AS (SELECT user_id AS k, event_type AS fact, min(event_id % 3) AS value FROM events GROUP BY 1, 2)
SELECT k, count(*) FILTER (WHERE a.value = b.value) AS agree, count(*) FILTER (WHERE a.value <> b.value) AS disagree FROM a JOIN b USING (k, fact) GROUP BY 1""")
def chain_votes(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("fact"), (F.col("event_id") % 3).alias("value"))
    return D.votes(e.groupBy("k", "fact").agg(F.max("value").alias("value")), e.groupBy("k", "fact").agg(F.min("value").alias("value")), "k")


_LEVELS = ["exact", "caveat", "manual", "inconsistent", "none"]
_PICK = lambda e: "['exact', 'caveat', 'manual', 'inconsistent', 'none'][" + e + " % 5 + 1]"


@query(f"""~ p AS (SELECT c_custkey, {_PICK('c_custkey')} AS m, {_PICK('(c_custkey // 5)')} AS s, {_PICK('(c_custkey // 25)')} AS t FROM customer)
SELECT c_custkey, CASE WHEN m = 'none' THEN 'missing' WHEN 'inconsistent' IN (m, s, t) THEN 'inconsistent' WHEN m = 'manual' THEN 'manual masks' WHEN 'none' IN (s, t) THEN 'partial' WHEN 'caveat' IN (m, s, t) OR 'manual' IN (m, s, t) THEN 'usable with a note' ELSE 'complete' END AS status FROM p""")
def plan_status(spark, sf):
    level = lambda e: F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.floor(e) % 5 + 1).cast("int"))
    k = F.col("c_custkey")
    return _t(spark, sf, "customer").select("c_custkey", D.plan_status(level(k), level(k / 5), level(k / 25)).alias("status"))


@query("""~ l AS (SELECT user_id AS k, event_id AS line, 'set ' || event_type || ' = ' || (event_id % 10) AS text FROM events), f AS (SELECT k, line, fact, regexp_extract(text, pattern, 1) AS value FROM l, (VALUES ('clicks', 'set click = (\\d+)'), ('errors', 'set error = (\\d+)')) p(fact, pattern))
SELECT k, fact, arg_max(value, line) AS value, max(line) AS at FROM f WHERE value <> '' GROUP BY 1, 2""")
def log_facts(spark, sf):
    lines = _t(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("line"), F.concat(F.lit("set "), "event_type", F.lit(" = "), F.col("event_id") % 10).alias("text"))
    return D.log_facts(lines, {"clicks": r"set click = (\d+)", "errors": r"set error = (\d+)"}, "k")


@query("""~ d AS (SELECT event_id, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)
SELECT event_id, CASE WHEN s IS NULL THEN 'unknown' WHEN s < -120 THEN 'older than its source' WHEN s <= 120 THEN 'same run' WHEN s <= 3600 THEN 'within the hour' WHEN s <= 86400 THEN 'same day' ELSE 'later' END AS reading FROM d""")
def contour_timeline(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _t(spark, sf, "events").withColumn("t", F.unix_timestamp("ts"))
    return e.select("event_id", D.interval_reading(F.col("t") - F.lag("t").over(w)).alias("reading"))


from . import catalog_files  # noqa: E402, F401  (registers its queries)
