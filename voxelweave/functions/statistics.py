"""Map statistics, comparison of volumes, and agreement of paired measurements.

All are aggregations with partial results on the map side; two-pass moments (mean first,
then differences from it) keep them exact where one pass of sums would cancel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grid import AXES, KEYS, Grid


def _all(*keys: str) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _centred(df: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """``df`` with the difference of ``column`` from its group's mean: an aggregate and a join.

    Groups grow with the data, so the engine chooses the join by their size as measured; only
    the one row of a mean over everything is broadcast in any case.
    """
    means = df.groupBy(*keys).agg(F.avg(column).alias("__m"))
    joined = df.join(means, keys) if keys else df.crossJoin(F.broadcast(means))
    return joined.withColumn(name, F.col(column) - F.col("__m")).drop("__m")


# ---- maps


def map_statistics(voxels: DataFrame, objects: DataFrame, voxel_mm: float = 1.0) -> DataFrame:
    """Per volume: n, mean, SD (population), max, skewness, excess kurtosis, valid fraction.

    Over the map's positive values, in mm.  Moments of two values or fewer, or of equal
    ones, are 0; the valid fraction is n by the number of object voxels.
    """
    mm = F.col("v").cast("double") * F.lit(float(voxel_mm))
    values = _centred(voxels.where("v > 0").select("vol_id", mm.alias("mm")), "mm", ["vol_id"], "d")
    power = lambda k: F.avg(F.pow("d", F.lit(float(k))))
    out = values.groupBy("vol_id").agg(F.count("*").alias("n"), F.avg("mm").alias("mean"), F.max("mm").alias("max"), power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"))
    size = objects.where("v <> 0").groupBy("vol_id").agg(F.count("*").alias("size"))
    full = (F.col("n") > 2) & (F.col("m2") > 0)
    out = size.join(out, "vol_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(
        "vol_id", "n", F.coalesce("mean", F.lit(0.0)).alias("mean_mm"), F.coalesce(F.sqrt("m2"), F.lit(0.0)).alias("sd_mm"), F.coalesce("max", F.lit(0.0)).alias("max_mm"),
        F.when(full, F.col("m3") / F.pow("m2", F.lit(1.5))).otherwise(0.0).alias("skew"),
        F.when(full, F.col("m4") / (F.col("m2") * F.col("m2")) - 3.0).otherwise(0.0).alias("kurtosis"),
        (F.col("n") / F.greatest("size", F.lit(1))).alias("valid_fraction"),
    )


def volume_fraction(seg: DataFrame, region: DataFrame, voxel_mm: float = 1.0) -> DataFrame:
    """BV/TV: the set voxels of ``seg`` inside the region by all of the region's."""
    both = region.where("v <> 0").select(*KEYS).join(seg.where("v <> 0").select(*KEYS, F.lit(1).alias("b")), list(KEYS), "left")
    out = both.groupBy("vol_id").agg(F.count("b").alias("bv"), F.count("*").alias("tv"))
    return out.select("vol_id", "bv", "tv", (F.col("bv") / F.col("tv")).alias("bv_tv"), (F.col("bv") * F.lit(float(voxel_mm) ** 3)).alias("bv_mm3"), (F.col("tv") * F.lit(float(voxel_mm) ** 3)).alias("tv_mm3"))


def trabecular_number(mean: Column) -> Column:
    return F.when(mean > 0, 1.0 / mean).otherwise(0.0)


def density(voxels: DataFrame, mask: DataFrame, slope: float, intercept: float, scaling: float) -> DataFrame:
    """Mean and population SD of the calibrated values inside a mask."""
    inside = mask.where("v <> 0").select(*KEYS).join(voxels, list(KEYS), "left")
    mg = F.coalesce("v", F.lit(0)).cast("double") / F.lit(float(scaling)) * F.lit(float(slope)) + F.lit(float(intercept))
    return inside.groupBy("vol_id").agg(F.avg(mg).alias("bmd_mean"), F.stddev_pop(mg).alias("bmd_sd"), F.count("*").alias("n"))


def value_histogram(voxels: DataFrame, most: int = 12) -> DataFrame:
    """Distinct values and counts, for volumes with at most ``most`` of them."""
    counts = voxels.groupBy("vol_id", "v").agg(F.count("*").alias("n"))
    return counts.withColumn("kinds", F.count("*").over(Window.partitionBy("vol_id"))).where(F.col("kinds") <= most).drop("kinds")


# ---- two volumes


def joint_histogram(ours: DataFrame, reference: DataFrame, grid: Grid | None = None) -> DataFrame:
    """``vol_id, ours, ref, n``: how often values meet; with a grid, (0, 0) as the rest of it."""
    both = ours.select(*KEYS, F.col("v").alias("p")).join(reference.select(*KEYS, F.col("v").alias("q")), list(KEYS), "full")
    counts = both.groupBy("vol_id", F.coalesce("p", F.lit(0)).alias("ours"), F.coalesce("q", F.lit(0)).alias("ref")).agg(F.count("*").alias("n"))
    if grid is None:
        return counts
    rest = counts.groupBy("vol_id").agg((F.lit(grid.voxels) - F.sum(F.when((F.col("ours") == 0) & (F.col("ref") == 0), 0).otherwise(F.col("n")))).alias("n"))
    zero = rest.select("vol_id", F.lit(0).alias("ours"), F.lit(0).alias("ref"), "n")
    return counts.where("NOT (ours = 0 AND ref = 0)").unionByName(zero.select(*counts.columns))


def summarize_joint(counts: DataFrame, voxel_mm: float = 1.0) -> DataFrame:
    """Mismatches, supports, exact fraction, and mean, SD and maximum over each own support."""
    n, p, q = F.col("n"), F.col("ours"), F.col("ref")
    sums = lambda when: F.sum(F.when(when, n).otherwise(0))
    same = (p == q) & (p != 0)

    def moments(v, name):
        w = F.when(v > 0, n).otherwise(0).cast("double")
        total, mean = F.sum(w), F.sum(w * v) / F.sum(w)
        return [F.coalesce(mean, F.lit(0.0)).alias(f"{name}_mean"), F.coalesce(F.sqrt(F.greatest(F.sum(w * v * v) / total - mean * mean, F.lit(0.0))), F.lit(0.0)).alias(f"{name}_sd"), F.coalesce(F.max(F.when(v > 0, v)), F.lit(0)).alias(f"{name}_max")]

    out = counts.groupBy("vol_id").agg(
        F.sum(n).alias("total"), sums(p != q).alias("mismatches"), sums((p != 0) & (q == 0)).alias("ours_only"), sums((p == 0) & (q != 0)).alias("ref_only"),
        sums((p != 0) & (q != 0) & (p != q)).alias("both_differ"), sums(p != 0).alias("ours_support"), sums(q != 0).alias("ref_support"), sums(same).alias("__same"), sums((p != 0) | (q != 0)).alias("__any"),
        *moments(p, "ours"), *moments(q, "ref"),
    )
    out = out.withColumn("exact_fraction", F.when(F.col("__any") == 0, 1.0).otherwise(F.col("__same") / F.col("__any"))).drop("__same", "__any")
    return out.withColumns({"ours_mean_mm": F.col("ours_mean") * F.lit(float(voxel_mm)), "ref_mean_mm": F.col("ref_mean") * F.lit(float(voxel_mm))})


def pooled_joint(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys, "ours", "ref").agg(F.sum("n").alias("n"))


def voxelwise_regression(counts: DataFrame, *keys: str) -> DataFrame:
    """Weighted least squares of ours on the reference over all cells but (0, 0)."""
    cells = counts.where("NOT (ours = 0 AND ref = 0)").select(*keys, F.col("n").cast("double").alias("w"), F.col("ours").cast("double").alias("p"), F.col("ref").cast("double").alias("q"))
    means = cells.groupBy(*keys).agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("mp"), (F.sum(F.col("w") * F.col("q")) / F.sum("w")).alias("mq"))
    joined = cells.join(means, list(keys)) if keys else cells.crossJoin(F.broadcast(means))
    dp, dq = F.col("p") - F.col("mp"), F.col("q") - F.col("mq")
    out = joined.groupBy(*keys).agg(F.sum("w").cast("long").alias("n"), F.sum(F.col("w") * dq * dq).alias("sqq"), F.sum(F.col("w") * dp * dq).alias("spq"), F.sum(F.col("w") * dp * dp).alias("spp"), F.first("mp").alias("mp"), F.first("mq").alias("mq"), (F.sum(F.when(F.col("p") == F.col("q"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("exact_fraction"))
    slope = F.when(F.col("sqq") > 0, F.col("spq") / F.col("sqq"))
    return out.select(*keys, "n", slope.alias("slope"), (F.col("mp") - slope * F.col("mq")).alias("intercept"), F.when((F.col("sqq") > 0) & (F.col("spp") > 0), F.col("spq") * F.col("spq") / (F.col("sqq") * F.col("spp"))).alias("r2"), "exact_fraction")


def compare_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mismatches, one-sided voxels and the Dice score (1 if both are empty)."""
    both = a.where("v <> 0").select(*KEYS, F.lit(1).alias("p")).join(b.where("v <> 0").select(*KEYS, F.lit(1).alias("q")), list(KEYS), "full")
    out = both.groupBy("vol_id").agg(F.count("p").alias("ours"), F.count("q").alias("ref"), F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull()).alias("shared"))
    return out.select("vol_id", "ours", "ref", (F.col("ours") + F.col("ref") - 2 * F.col("shared")).alias("mismatch"), (F.col("ours") - F.col("shared")).alias("ours_only"), (F.col("ref") - F.col("shared")).alias("ref_only"), F.when(F.col("ours") + F.col("ref") == 0, 1.0).otherwise(2.0 * F.col("shared") / (F.col("ours") + F.col("ref"))).alias("dice"))


def compare_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many voxels both set, and how many of them with other values."""
    both = a.where("v <> 0").select(*KEYS, F.col("v").alias("p")).join(b.where("v <> 0").select(*KEYS, F.col("v").alias("q")), list(KEYS))
    return both.groupBy("vol_id").agg(F.count("*").alias("both_set"), F.count_if(F.col("p") != F.col("q")).alias("differ"))


def mismatches(ours: DataFrame, reference: DataFrame, limit: int) -> DataFrame:
    """The first mismatches in raster order (a report: the limit is the feature)."""
    both = ours.select(*KEYS, F.col("v").alias("p")).join(reference.select(*KEYS, F.col("v").alias("q")), list(KEYS), "full").select(*KEYS, F.coalesce("p", F.lit(0)).alias("ours"), F.coalesce("q", F.lit(0)).alias("ref"))
    return both.where("ours <> ref").orderBy(*KEYS).limit(limit)


def value_pairs(counts: DataFrame, limit: int = 12) -> DataFrame:
    """The most frequent pairs of unlike values of each volume; ties by value."""
    w = Window.partitionBy("vol_id").orderBy(F.desc("n"), "ours", "ref")
    return counts.where("ours <> ref").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def ct_po(pore: DataFrame, contour: DataFrame, bone: DataFrame | None = None) -> DataFrame:
    """Porosity: pores inside the contour by its voxels, or, with ``bone``, pores by pores and bone."""
    p = pore.where("v <> 0").select(*KEYS, F.lit(1).alias("p"))
    m = (contour if bone is None else bone).where("v <> 0").select(*KEYS, F.lit(1).alias("m"))
    out = p.join(m, list(KEYS), "full").groupBy("vol_id").agg(F.count("p").alias("pore_voxels"), F.count_if(F.col("p").isNotNull() & F.col("m").isNotNull()).alias("pore_in_mask"), F.count("m").alias("mask_voxels"))
    if bone is None:
        return out.withColumn("ct_po", F.when(F.col("mask_voxels") > 0, F.col("pore_in_mask") / F.col("mask_voxels")).otherwise(F.lit(float("nan"))))
    total = F.col("pore_voxels") + F.col("mask_voxels")
    return out.withColumn("ct_po", F.when(total > 0, F.col("pore_voxels") / total).otherwise(F.lit(float("nan"))))


# ---- paired measurements: columns ``x`` (reference) and ``y`` (ours)


def ols(pairs: DataFrame, *keys: str) -> DataFrame:
    """Slope, intercept and R2 of y on x; no spread in x gives NaN, all but equal values R2 = 1."""
    nan = F.lit(float("nan"))
    close = F.abs(F.col("y") - F.col("x")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("x")
    out = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop("x").alias("sxx"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("y", "x").alias("r"), F.bool_and(close).alias("same"))
    flat = F.col("sxx") == 0
    return out.select(*keys, "n", F.when(flat, nan).otherwise(F.col("b")).alias("slope"), F.when(flat, nan).otherwise(F.col("a")).alias("intercept"), F.when(F.col("same"), 1.0).when(flat, nan).otherwise(F.col("r")).alias("r2"))


def icc(pairs: DataFrame, *keys: str, degenerate: float = float("nan")) -> DataFrame:
    """ICC(2,1): two-way random effects, absolute agreement, two raters."""
    means = pairs.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    joined = pairs.join(means, list(keys)) if keys else pairs.crossJoin(F.broadcast(means))
    grand, row = (F.col("mx") + F.col("my")) / 2, (F.col("x") + F.col("y")) / 2
    error = lambda v, m: (F.col(v) - row - F.col(m) + grand) * (F.col(v) - row - F.col(m) + grand)
    out = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(2 * (row - grand) * (row - grand)).alias("rows"), F.sum(error("x", "mx") + error("y", "my")).alias("errors"), F.first(grand).alias("g"), F.first("mx").alias("mx"), F.first("my").alias("my"))
    n = F.col("n").cast("double")
    columns = n * ((F.col("mx") - F.col("g")) * (F.col("mx") - F.col("g")) + (F.col("my") - F.col("g")) * (F.col("my") - F.col("g")))
    msr, mse = F.col("rows") / (n - 1), F.col("errors") / (n - 1)
    den = msr + mse + 2 * (columns - mse) / n
    return out.select(*keys, "n", F.when((n > 1) & (den > 0), (msr - mse) / den).otherwise(F.lit(float(degenerate))).alias("icc"))


def bland_altman(pairs: DataFrame, *keys: str) -> DataFrame:
    """Bias, SD (n - 1), limits of agreement and the largest difference of y - x."""
    d = F.col("y") - F.col("x")
    out = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"), F.max(F.abs(d)).alias("max_abs"))
    return out.withColumns({"loa_low": F.col("bias") - F.lit(1.96) * F.col("sd"), "loa_high": F.col("bias") + F.lit(1.96) * F.col("sd")})


def stats_pair(pairs: DataFrame, *keys: str) -> DataFrame:
    """Agreement block: differences of rounding size count as none; identity if all are."""
    raw = F.col("y") - F.col("x")
    d = F.when(F.abs(raw) <= F.lit(1e-12) * F.greatest(F.lit(1.0), F.abs("x")), 0.0).otherwise(raw)
    base = pairs.withColumn("d", d)
    out = base.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("identical"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"), F.max(F.abs("d")).alias("max_abs"), F.avg(F.abs("d")).alias("mean_abs"),
        F.max(F.when(F.col("x") != 0, F.abs(F.col("d") / F.col("x")) * 100.0)).alias("max_rel_pct"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("y", "x").alias("r"),
    )
    same = F.col("identical") == F.col("n")
    return out.select(*keys, "n", "identical", "bias", "sd", "max_abs", "mean_abs", "max_rel_pct", F.when(same, 1.0).otherwise(F.col("b")).alias("slope"), F.when(same, 0.0).otherwise(F.col("a")).alias("intercept"), F.when(same, 1.0).otherwise(F.col("r")).alias("r2"))


def wilcoxon(pairs: DataFrame, *keys: str) -> DataFrame:
    """Signed-rank test: zeros left out, mean ranks of ties, normal approximation, two-sided.

    Ranks need an order over all of a group, so one sort of its differences is unavoidable;
    equal differences are first folded to counts.
    """
    d = pairs.select(*keys, (F.col("y") - F.col("x")).alias("d")).where("d <> 0")
    folded = d.groupBy(*keys, F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("n").over(_all(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = folded.withColumn("rank", before + (F.col("n") + 1) / 2.0)
    out = ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return out.select(*keys, "n", F.col("w").alias("w_plus"), z.alias("z"))


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def quantiles(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """n, min, q1, median, q3, max and mean; exact, linear between neighbours."""
    at = lambda p: F.percentile(column, F.lit(p))
    return df.groupBy(*keys).agg(F.count(column).alias("n"), F.min(column).alias("min"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max(column).alias("max"), F.avg(column).alias("mean"))


def pooled_block(df: DataFrame, *keys: str) -> DataFrame:
    """Pooled mismatches in parts per million, exact scans, and the spread of Dice scores."""
    out = df.groupBy(*keys).agg(F.count("*").alias("scans"), F.sum("mismatch").alias("mismatch"), F.sum("voxels").alias("voxels"), F.count_if(F.col("mismatch") == 0).alias("exact"), F.percentile("dice", F.lit(0.5)).alias("dice_median"), F.min("dice").alias("dice_min"), F.count_if(F.col("dice") >= 0.9999).alias("dice_high"))
    return out.withColumn("ppm", F.lit(1e6) * F.col("mismatch") / F.col("voxels"))


def grouping_summary(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Counts and means over all rows and for each key alone, in one pass."""
    kind = F.concat_ws(",", *[F.when(F.grouping(k) == 0, k) for k in keys])
    aggregates = [F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values]]
    out = df.groupingSets([[], *[[k] for k in keys]], *keys).agg(kind.alias("block"), *aggregates)
    return out.select("block", F.coalesce(*keys, F.lit("ALL")).alias("value"), "n", *[f"mean_{v}" for v in values])


def pivot_with_total(df: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide, with a TOTAL row."""
    wide = df.groupBy(row).pivot(column, names).agg(F.sum(value))
    total = wide.agg(*[F.sum(n).alias(n) for n in names]).select(F.lit("TOTAL").alias(row), *names)
    return wide.unionByName(total)


def exclude(df: DataFrame, key: str, ids: list[str]) -> DataFrame:
    return df.where(~F.col(key).isin(ids)) if ids else df


def breakdown(df: DataFrame, key: str, *keys: str) -> DataFrame:
    """``k n, k n`` in the order of the keys."""
    counts = df.groupBy(*keys, key).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col("n"))))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: F.concat_ws(" ", p["k"], p["n"].cast("string"))), ", ").alias("breakdown"))


def within(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-15) -> Column:
    """Whether two floats agree to a relative or an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))


def consistency(layers: dict[str, DataFrame]) -> DataFrame:
    """Per volume, voxels of each combination of two layers: in both, and in the first only.

    One full aggregation over the union of all layers, not a join for each pair.
    """
    union: DataFrame | None = None
    for k, df in enumerate(layers.values()):
        part = df.where("v <> 0").select(*KEYS, F.lit(1 << k).alias("bit"))
        union = part if union is None else union.unionByName(part)
    bits = union.groupBy(*KEYS).agg(F.bit_or("bit").alias("bits"))
    has = [(F.col("bits").bitwiseAND(1 << k)) > 0 for k in range(len(layers))]
    names = list(layers)
    return bits.groupBy("vol_id").agg(*[F.count_if(has[i] & has[j]).alias(f"{names[i]}_and_{names[j]}") for i in range(len(names)) for j in range(i + 1, len(names))], *[F.count_if(has[i] & ~has[j]).alias(f"{names[i]}_not_{names[j]}") for i in range(len(names)) for j in range(len(names)) if i != j])


def evaluation_checks(periosteal: DataFrame, cort: DataFrame, trab: DataFrame, seg: DataFrame, maps: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Whether the products of an evaluation fit together, one row for each volume.

    (a) the contour against the two compartments, (b) the labels (127 cortical, 126 trabecular)
    against the renderings, (c) the support of each map against the rendering it is drawn in
    (``maps``: the map, and ``cort`` or ``trab``), (d) the boxes of the segmentation and the maps.
    One aggregation over the union of all layers.
    """
    layers = [("p", periosteal, F.col("v") != 0), ("c", cort, F.col("v") != 0), ("t", trab, F.col("v") != 0), ("s127", seg, F.col("v") == 127), ("s126", seg, F.col("v") == 126)]
    layers += [(name, df, F.col("v") != 0) for name, (df, _) in maps.items()]
    bit = {name: 1 << k for k, (name, *_) in enumerate(layers)}
    union: DataFrame | None = None
    for name, df, on in layers:
        part = df.where(on).select(*KEYS, F.lit(bit[name]).alias("bit"))
        union = part if union is None else union.unionByName(part)
    bits = union.groupBy(*KEYS).agg(F.bit_or("bit").alias("bits"))
    has = {name: F.col("bits").bitwiseAND(b) > 0 for name, b in bit.items()}
    p, c, t, s127, s126 = (has[n] for n in ("p", "c", "t", "s127", "s126"))
    s = s127 | s126
    counts = {
        "periosteal": p, "cort": c, "trab": t, "both": c & t, "periosteal_only": p & ~(c | t), "compartments_only": (c | t) & ~p,
        "seg": s, "seg_outside_periosteal": s & ~p, "seg127_outside_cort": s127 & ~c, "seg126_outside_trab": s126 & ~t, "seg126_inside_cort": s126 & c, "seg127_inside_trab": s127 & t,
    }
    for name, (_, home) in maps.items():
        own, other = (c, t) if home == "cort" else (t, c)
        counts |= {f"{name}_support": has[name], f"{name}_outside": has[name] & ~own, f"{name}_inside_other": has[name] & other}
    box = lambda name, on: [f(F.when(on, F.col(a))).alias(f"{name}_{a}{k}") for a in AXES for k, f in enumerate((F.min, F.max))]
    found = bits.groupBy("vol_id").agg(*[F.count_if(on).alias(n) for n, on in counts.items()], *box("bp", p), *box("bs", s), *[b for name in maps for b in box(f"b{name}", has[name])])
    inside, same = F.lit(True), {name: F.lit(True) for name in maps}
    for a in AXES:
        inside = inside & (F.col(f"bs_{a}0") >= F.col(f"bp_{a}0")) & (F.col(f"bs_{a}1") <= F.col(f"bp_{a}1"))
        for name in maps:
            same[name] = same[name] & (F.col(f"b{name}_{a}0") == F.col(f"bs_{a}0")) & (F.col(f"b{name}_{a}1") == F.col(f"bs_{a}1"))
    equal = (F.col("periosteal_only") == 0) & (F.col("compartments_only") == 0)
    fits = (F.col("seg_outside_periosteal") == 0) & (F.col("seg127_outside_cort") == 0) & (F.col("seg126_outside_trab") == 0)
    return found.select("vol_id", *counts, (equal & (F.col("both") == 0)).alias("partition"), fits.alias("consistent"), inside.alias("seg_box_inside_periosteal"), *[e.alias(f"{n}_box_is_segs") for n, e in same.items()])


def empty_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "x double, y double")
