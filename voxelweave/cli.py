"""``python -m voxelweave.cli run|batch|redo|export|params|version``: exit code 0, 1 if a scan failed, 2 for bad arguments."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.grid import Grid
from .plans import params as P
from .plans.workflow import evaluate_scans, layers_of, metrics_of, stack
from .sources import images
from .sources.records import write_report

VERSION = "0.2"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="voxelweave")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", aliases=["batch"], help="evaluate all scans of a folder and its subfolders")
    run.add_argument("scans", help="folder of volumes")
    run.add_argument("contours", help="folder of periosteal masks with the same file names")
    run.add_argument("out", help="folder for the results and reports")
    redo = commands.add_parser("redo", help="measure scans anew with edited masks")
    redo.add_argument("scans", help="folder of volumes")
    redo.add_argument("before", help="folder that run or redo has written")
    redo.add_argument("out", help="folder for the results and reports")
    for kind in ("periosteal", "trab", "cort"):
        redo.add_argument(f"--{kind}", metavar="FOLDER", help=f"folder of edited {kind} masks with the scans' file names")
    for c in (run, redo, commands.add_parser("params", help="print all parameters")):
        c.add_argument("--preset", default="tibia", choices=sorted(P.PRESETS))
        c.add_argument("--params", help="JSON file of parameters")
        c.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    export = commands.add_parser("export", help="write one scan's compartments as a segmentation file")
    export.add_argument("results", help="folder that run or redo has written")
    export.add_argument("scan", help="the scan's file name, with its subfolder")
    export.add_argument("file", help="a new .seg.nrrd, .nii, .nii.gz or volume file")
    export.add_argument("--layer", default="compartments", help="compartments (1 cortical, 2 trabecular), or a mask, map or seg")
    commands.add_parser("version")
    return out


def read_named(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of all volumes under a folder; ``vol_id`` is the path below it, without the ending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    below = F.expr(f"substring(path, {len(root) + 2})")
    return images.read_volumes(spark, folder, "*.{[aA][iI][mM],nrrd,NRRD,nii,NII,nii.gz}", deep=True).withColumn("vol_id", F.regexp_replace(below, r"(?i)(\.seg)?\.(nrrd|nii|nii\.gz|aim)$", ""))


def export(spark: SparkSession, results: str, scan: str, file: str, layer: str) -> None:
    """One scan's layer as a file: its slices are gathered, which is one volume."""
    names = ("cort", "trab") if layer == "compartments" else (layer,)
    rows = [r.asDict() | {"dtype": "i2"} for r in layers_of(spark.read.parquet(f"{results}/results"), *names).where(F.col("vol_id") == scan).collect()]
    if not rows:
        raise ValueError(f"{results} holds no {layer} of {scan}")
    whole, el = stack(rows)
    data = np.zeros(whole.shape, np.int16)
    for value, name in enumerate(names, 1):
        if some := [r for r in rows if r["name"] == name]:
            own = stack(some)[0].like(whole)
            data = np.where(own != 0, value if len(names) > 1 else own, data)
    segments = {f"Segment{k}_{f}": str(v) for k, n in enumerate(names) for f, v in (("ID", n), ("Name", n), ("LabelValue", k + 1))} if len(names) > 1 else {}
    grid = Grid(data.shape, whole.origin, el)
    low = data.astype(np.uint8) if data.max(initial=0) < 256 else data
    raw = images.encode_nrrd(low, grid, segments) if file.lower().endswith(".nrrd") else images.encode_any(file, low, grid)
    images.put(spark, file, raw)


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "export":
        try:
            export(SparkSession.builder.getOrCreate(), args.results, args.scan, args.file, args.layer)
        except ValueError as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
        return 0
    try:
        file = json.loads(Path(args.params).read_text()) if args.params else None
        resolved = P.resolve(args.preset, file, dict(P.parse_setting(s) for s in args.set))
    except (P.ParameterError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if args.command == "params":
        print(resolved.to_json())
        return 0
    # Only calibration values that were given replace those of a scan's own log.
    given = {n: getattr(resolved.values.calibration, n) for n in ("slope", "intercept", "mu_scaling") if f"calibration.{n}" in resolved.sources}
    spark = SparkSession.builder.getOrCreate()
    scans = read_named(spark, args.scans)
    if args.command == "redo":
        edits = {k: read_named(spark, folder) for k in ("periosteal", "trab", "cort") if (folder := getattr(args, k))}
        if not edits:
            print("error: give a folder of edited masks", file=sys.stderr)
            return 2
        results = evaluate_scans(scans, scans, resolved.values, given, edits, layers_of(spark.read.parquet(f"{args.before}/results")))
    else:
        results = evaluate_scans(scans, read_named(spark, args.contours), resolved.values, given)
    results.write.parquet(f"{args.out}/results")
    report = metrics_of(spark.read.parquet(f"{args.out}/results"))
    write_report(report, args.out)
    return int(report.where("parameter = 'error'").count() > 0)


if __name__ == "__main__":
    sys.exit(main())
