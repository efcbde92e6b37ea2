"""Log, header and record functions: all of them column expressions or window plans."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"([-+0-9.eE]+)"


def calibration(log: Column) -> dict[str, Column]:
    """Slope, intercept and scaling from a processing log; null where a field is absent."""
    find = lambda pattern: F.nullif(F.regexp_extract(log, pattern + r"\s+" + _NUMBER, 1), F.lit("")).try_cast("double")
    return {"slope": find(r"Density:\s*slope"), "intercept": find(r"Density:\s*intercept"), "mu_scaling": find("Mu_Scaling")}


def log_field(log: Column, key: str) -> Column:
    """The rest of the line that starts with ``key``."""
    return F.nullif(F.regexp_extract(log, rf"(?m)^{key}\s+(.*?)\s*$", 1), F.lit(""))


def procedures(logs: DataFrame, log: str = "log") -> DataFrame:
    """``..., block, fields``: one row for each block between ``!-----`` lines, as a map."""
    blocks = logs.select(*[c for c in logs.columns if c != log], F.posexplode(F.split(F.col(log), r"(?m)^!-+\s*$")).alias("block", "body"))
    pairs = F.filter(F.transform(F.split("body", r"\n"), lambda s: F.split(F.btrim(s), r"\s{2,}|\s*=\s*", 2)), lambda p: F.size(p) == 2)
    entries = F.transform(pairs, lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))
    return blocks.withColumn("fields", F.map_from_entries(F.array_distinct(entries))).drop("body")


def command_blocks(lines: DataFrame, command: Column, banner: Column, *keys: str, order: str = "line") -> DataFrame:
    """``block`` and ``run`` of each line: running counts of commands and of banners."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(command.cast("int")).over(w)).withColumn("run", F.sum(banner.cast("int")).over(w))


def run_scores(runs: DataFrame, products: DataFrame, *keys: str) -> DataFrame:
    """How many time stamps of products lie ``inside`` each run, and ``after`` its end.

    Starts, ends and stamps of a key stand in one order of time, and running counts of the
    stamps at a run's two ends give both numbers, so runs and stamps are never paired.
    """
    k = list(keys)
    columns = [*k, "at", "kind", "run", "start", "end"]
    # Stamps at a start count as inside, and so do those at an end.
    starts = runs.select(*k, F.col("start").alias("at"), F.lit(0).alias("kind"), "run", "start", "end")
    ends = runs.select(*k, F.col("end").alias("at"), F.lit(2).alias("kind"), "run", "start", "end")
    none = {c: F.lit(None).cast(runs.schema[c].dataType) for c in ("run", "start", "end")}
    stamps = products.where("ts IS NOT NULL").select(*k, F.col("ts").alias("at"), F.lit(1).alias("kind")).withColumns(none)
    line = starts.select(*columns).unionByName(ends.select(*columns)).unionByName(stamps.select(*columns))
    before = Window.partitionBy(*k).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("seen", F.count_if(F.col("kind") == 1).over(before)).withColumn("all", F.count_if(F.col("kind") == 1).over(Window.partitionBy(*k)))
    per = line.where("kind <> 1").groupBy(*k, "run", "start", "end").agg(F.max(F.when(F.col("kind") == 0, F.col("seen"))).alias("early"), F.max(F.when(F.col("kind") == 2, F.col("seen"))).alias("late"), F.max("all").alias("all"))
    inside = F.greatest(F.col("late") - F.col("early"), F.lit(0))
    return per.select(*k, "run", "start", "end", inside.alias("inside"), (F.col("all") - F.col("late")).alias("after"))


def choose_run(runs: DataFrame, products: DataFrame, *keys: str) -> DataFrame:
    """The run that fits the time stamps of products best.

    A stamp inside a run speaks for it, one after its end against it; stamps before it say
    nothing.  Ranked by no refutation, agreement less disagreement, stamps inside, and start.
    """
    k, scored = list(keys), run_scores(runs, products, *keys)
    w = Window.partitionBy(*k).orderBy((F.col("after") > 0).cast("int"), F.desc(F.col("inside") - F.col("after")), F.desc("inside"), F.desc("start"), "run")
    return scored.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def metric_lines(log: Column) -> Column:
    """``(name, value, unit)`` of all ``!> NAME = v [unit]`` lines."""
    name = F.regexp_extract_all(log, F.lit(r"!>\s*(\w+)\s*=\s*[-+0-9.eE]+"), 1)
    value = F.regexp_extract_all(log, F.lit(r"!>\s*\w+\s*=\s*([-+0-9.eE]+)"), 1)
    unit = F.regexp_extract_all(log, F.lit(r"!>\s*\w+\s*=\s*[-+0-9.eE]+[ \t]*(?:\[([^\]]*)\])?"), 1)
    return F.transform(F.arrays_zip(name.alias("name"), value.alias("value"), unit.alias("unit")), lambda p: F.struct(p["name"].alias("name"), p["value"].try_cast("double").alias("value"), p["unit"].alias("unit")))


def vms_seconds(text: Column) -> Column:
    """Seconds since 1970 of ``17-SEP-2014 10:11:12.34``."""
    return F.unix_timestamp(F.try_to_timestamp(F.initcap(F.regexp_replace(F.btrim(text), r"\.\d+$", "")), F.lit("d-MMM-yyyy HH:mm:ss")))


def interval_hours(first: Column, second: Column) -> Column:
    """Hours from one VMS time to another."""
    return (vms_seconds(second) - vms_seconds(first)) / F.lit(3600.0)


def file_kind(name: Column) -> Column:
    """What a file of a scan's folder is, by its name."""
    upper = F.upper(name)
    rules = [("%_SEG.%", "segmentation"), ("%_TRAB_MASK%.GOBJ%", "trabecular contour"), ("%_CORT_MASK%.GOBJ%", "cortical contour"), ("%_TRAB_MASK%", "trabecular mask"), ("%_CORT_MASK%", "cortical mask"), ("%_TH.%", "thickness map"), ("%_SP.%", "spacing map"), ("%_1N.%", "number map"), ("%.GOBJ%", "contour"), ("%.LOG%", "log"), ("%.TXT", "log"), ("%.AIM%", "image")]
    out = F.when(upper.like(rules[0][0]), rules[0][1])
    for pattern, kind in rules[1:]:
        out = out.when(upper.like(pattern), kind)
    return out.otherwise("other")


def cohort(site: Column) -> Column:
    """Patella, ultradistal or diaphyseal with the bone, from a site path."""
    part = F.lower(F.element_at(F.split(site, "[/\\\\]"), -1))
    where = F.when(F.lower(site).contains("diaphyseal"), "diaphyseal ").when(F.lower(site).contains("distal"), "ultradistal ").otherwise("")
    return F.when(F.lower(site).contains("patella"), "patella").otherwise(F.concat(where, part))


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as dotted columns, arrays as words between spaces."""
    out: list[Column] = []

    def walk(kind, path, column):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, [*path, f.name], column.getField(f.name))
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
            out.append(F.array_join(column.cast("array<string>"), " ").alias(separator.join(path)))
        else:
            out.append(column.alias(separator.join(path)))

    for f in df.schema.fields:
        walk(f.dataType, [f.name], F.col(f"`{f.name}`"))
    return df.select(*out)


def long_form(df: DataFrame, key: str) -> DataFrame:
    """``key, parameter, value``: a row for each column of the flattened record."""
    flat = flatten(df)
    names = [c for c in flat.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])
    return flat.select(key, F.explode(pairs).alias("p")).select(key, "p.parameter", "p.value")


def select_known(df: DataFrame, policy: Mapping[str, str]) -> DataFrame:
    """Columns by a policy of ``keep`` or ``drop``; a column without a rule is refused."""
    unknown = sorted(set(df.columns) - policy.keys())
    if unknown:
        raise ValueError(f"no rule for {', '.join(unknown)}")
    return df.select(*[c for c in df.columns if policy[c] == "keep"])


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed hash as lowercase hex, of built-in functions alone."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pads = [F.unhex(F.lit(bytes(b ^ p for b in block).hex())) for p in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(pads[0], F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pads[1], inner), 256)


#: Name space, offset and modulus of the decimal forms of a pseudonym.
_FORMS = {"digits": ("MEAS", 100_000, 900_000), "code": ("BASE", 1_000_000, 9_000_000)}


def pseudonym(code: Column, key: bytes, form: str = "hex", study: Column | None = None) -> Column:
    """A keyed name for a code: of a subject of a ``study`` (``hex``: the study and six digits of
    the keyed hash), of a measurement number (``digits``: six decimal ones) or of a file's base
    name in any case (``code``: X and seven decimal ones).

    What is hashed is the name space, a bar and the code.  The decimal forms are the remainder of
    the whole 256-bit number, taken eight hex digits at a time so that it never leaves a long.
    """
    if form == "hex":
        space = F.lit("") if study is None else study
        return F.concat(space, F.lit("-"), F.substring(hmac_sha256(F.concat(space, F.lit("|"), code), key), 1, 6))
    if form not in _FORMS:
        raise ValueError(f"form is hex, digits or code, not {form!r}")
    space, low, modulus = _FORMS[form]
    full = hmac_sha256(F.concat(F.lit(space + "|"), F.upper(code) if form == "code" else code), key)
    rest = F.lit(0).cast("long")
    for k in range(8):
        part = F.conv(F.substring(full, 8 * k + 1, 8), 16, 10).cast("long")
        rest = (rest * F.lit((1 << 32) % modulus) + part) % F.lit(modulus)
    out = (rest + F.lit(low)).cast("string")
    return out if form == "digits" else F.concat(F.lit("X"), out)


def find_identifiers(df: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """Rows with the names of the patterns that their text matches; the others go."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    return df.withColumn("found", hits).where(F.size("found") > 0)


# ---- run-length and chain codes


def run_length(runs: DataFrame, *keys: str, order: str = "i", value: str = "value", count: str = "n") -> DataFrame:
    """``keys, pos, v``: each run's value, as often as it counts, with its position."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = runs.withColumn("__start", F.coalesce(F.sum(count).over(w), F.lit(0)))
    return start.where(F.col(count) > 0).select(*keys, F.col(value).alias("v"), F.explode(F.sequence(F.col("__start"), F.col("__start") + F.col(count) - 1)).alias("pos"))


def bit_runs(lengths: DataFrame, *keys: str, order: str = "i", length: str = "n") -> DataFrame:
    """Runs of two values in turn: ``keys, i, bit, n``; 255 gives 254 and keeps the value."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    toggles = F.coalesce(F.sum(F.when(F.col(length) == 255, 0).otherwise(1)).over(w), F.lit(0))
    return lengths.select(*keys, order, (toggles % 2).cast("int").alias("bit"), F.when(F.col(length) == 255, 254).otherwise(F.col(length)).alias("n"))


def vax_float(bits: Column) -> Column:
    """The number behind a 32-bit VAX F field read as a little-endian integer."""
    u = bits.cast("long").bitwiseAND(0xFFFFFFFF)
    low, high = u.bitwiseAND(0xFFFF), F.shiftright(u, 16)
    sign, power = F.shiftright(low, 15), F.shiftright(low, 7).bitwiseAND(255)
    part = F.shiftleft(low.bitwiseAND(127), 16).bitwiseOR(high)
    value = (F.lit(0.5) + part / F.lit(float(1 << 24))) * F.pow(F.lit(2.0), (power - 128).cast("double"))
    return F.when(power == 0, 0.0).otherwise(F.when(sign == 1, -value).otherwise(value))


def element_size(sizes: list[Column], nominal: tuple[float, float, float]) -> list[Column]:
    """The header's sizes if all of them make sense, else the nominal ones."""
    good = F.lit(True)
    for s in sizes:
        good = good & (s > 0.001) & (s < 10.0)
    return [F.when(good, s).otherwise(n) for s, n in zip(sizes, nominal, strict=True)]


def chain_path(codes: DataFrame, *keys: str) -> DataFrame:
    """``keys, i, x, y`` from start ``x0, y0`` and codes 0 to 7: running sums of the steps."""
    dx, dy = (1, 1, 0, -1, -1, -1, 0, 1), (0, -1, -1, -1, 0, 1, 1, 1)  # fixed values: the chain code's steps
    pick = lambda t: F.element_at(F.array(*[F.lit(v) for v in t]), F.col("code") + 1)
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return codes.select(*keys, "i", (F.col("x0") + F.coalesce(F.sum(pick(dx)).over(w), F.lit(0))).cast("int").alias("x"), (F.col("y0") + F.coalesce(F.sum(pick(dy)).over(w), F.lit(0))).cast("int").alias("y"))


def chain_codes(vertices: DataFrame, *keys: str) -> DataFrame:
    """``keys, i, code``: the step to the next vertex of a closed chain; -1 if not adjacent."""
    w = Window.partitionBy(*keys).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = [F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) - F.col(c) for c in ("x", "y")]
    code = F.lit(-1)
    for k, (a, b) in enumerate(((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))):
        code = F.when((step[0] == a) & (step[1] == b), k).otherwise(code)
    return vertices.select(*keys, "i", code.alias("code"))
