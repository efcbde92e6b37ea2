"""Scans that arrive one by one.

``evaluate_arrivals`` keeps what has come of each scan as state, by ``vol_id``: its slices and its contour's
may come in any number of batches and any order, and the scan is evaluated once both are complete.
One that is not complete when the watermark passes its last arrival by the patience given is an error
row, and rows that come after a scan's result are counted.  State and results survive a restart.
``evaluate_stream`` is for batches that hold whole scans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import calibration
from ..operators.grid import VOXELS, Grid
from ..plans.workflow import CALIBRATION, RESULT, Evaluation, evaluate, scan_rows

#: What arrives: slices as the readers give them, their layer (grey or contour), how many planes the layer has, and when it was sent.
ARRIVALS = "vol_id string, layer string, planes int, arrived timestamp, z int, oy int, ox int, ny int, nx int, ez double, ey double, ex double, dtype string, log string, data binary"
LAYERS = ("grey", "contour")
_KEPT = ("oy", "ox", "ny", "nx", "ez", "ey", "ex", "dtype", "data")
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Voxel tables written as Parquet into ``folder``, with a ``layer`` of scan or contour."""
    return spark.readStream.schema(VOXELS + ", layer string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def evaluate_stream(source: DataFrame, sink: str, checkpoint: str, grid: Grid, params: Evaluation | None = None) -> StreamingQuery:
    """Append each batch's metrics to ``sink``; a batch that is run again replaces its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        scan = batch.where("layer = 'scan'").drop("layer")
        contour = batch.where("layer = 'contour'").drop("layer")
        evaluate(scan, contour, grid, params).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Arrivals(StatefulProcessor):
    """The state of one scan: its slices by layer and plane, how many there are and will be, its calibration, and whether it is done."""

    def __init__(self, params: Evaluation, patience_ms: int, evaluated=scan_rows):
        self.params, self.patience, self.evaluated = params, patience_ms, evaluated

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", "layer string, z int", "oy int, ox int, ny int, nx int, ez double, ey double, ex double, dtype string, data binary")
        self.counts = handle.getMapState("counts", "layer string", "have int, want int")
        self.scan = handle.getValueState("scan", "done boolean, late long, timer long, " + ", ".join(f"{c} double" for c in CALIBRATION))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in RESULT.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int32" for c in ("z", "oy", "ox", "ny", "nx")})

    def _close(self, vol_id: str, state: list, rows: list[tuple]) -> pd.DataFrame:
        self.slices.clear()
        self.counts.clear()
        if state[2]:
            self.handle.deleteTimer(state[2])
        self.scan.update((True, 0, 0, *state[3:]))
        return self._frame(rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        vol_id = key[0]
        state = list(self.scan.get() or (False, 0, 0, *(None,) * len(CALIBRATION))) if self.scan.exists() else [False, 0, 0, *(None,) * len(CALIBRATION)]
        counts = {layer: list(self.counts.getValue((layer,))) if self.counts.containsKey((layer,)) else [0, 0] for layer in LAYERS}
        newest, late = 0, 0
        for frame in rows:
            if state[0]:
                late += len(frame)
                continue
            newest = max(newest, int(frame["arrived"].max().timestamp() * 1000))
            for r in frame.to_dict("records"):
                for k, name in enumerate(CALIBRATION):
                    if r[name] is not None and not np.isnan(r[name]):
                        state[3 + k] = float(r[name])
                if r["layer"] not in counts:
                    continue
                place, count = (r["layer"], int(r["z"])), counts[r["layer"]]
                count[0] += not self.slices.containsKey(place)  # a plane that is sent again takes the place of the first
                count[1] = max(count[1], int(r["planes"]))
                self.slices.updateValue(place, tuple(r[c] if c in ("dtype", "data") else float(r[c]) if c[0] == "e" else int(r[c]) for c in _KEPT))
        if state[0]:
            self.scan.update((True, state[1] + late, 0, *state[3:]))
            yield self._frame([(vol_id, "late", float(state[1] + late), None, *(None,) * 9)])
            return
        if all(have >= want > 0 for have, want in counts.values()):
            layers: dict[str, list[dict]] = {}
            for (layer, z), value in self.slices.iterator():
                layers.setdefault(layer, []).append({"z": z} | dict(zip(_KEPT, value, strict=True)))
            values = dict(zip(CALIBRATION, state[3:], strict=True)) | {"source": "log"}
            yield self._close(vol_id, state, self.evaluated(vol_id, layers, values, self.params))
            return
        for layer, (have, want) in counts.items():
            self.counts.updateValue((layer,), (have, want))
        if state[2]:
            self.handle.deleteTimer(state[2])
        state[2] = max(newest + self.patience, state[2] + 1 if state[2] else 0)
        self.handle.registerTimer(state[2])
        self.scan.update(tuple(state))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counts = {layer: self.counts.getValue((layer,)) if self.counts.containsKey((layer,)) else (0, 0) for layer in LAYERS}
        missing = ", ".join(f"{have} of {want or 'some'} planes of the {layer}" for layer, (have, want) in counts.items() if not have >= want > 0)
        state = list(self.scan.get())
        state[2] = 0  # it has just gone off
        yield self._close(key[0], state, [(key[0], "error", None, f"incomplete: {missing}", *(None,) * 9)])

    def close(self) -> None:
        pass


def arriving_slices(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Slices (ARRIVALS) written as Parquet into ``folder``."""
    return spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def arrivals(source: DataFrame, params: Evaluation | None = None, patience: str = "1 hour", delay: str = "10 minutes", evaluated=scan_rows) -> DataFrame:
    """RESULT rows of a stream of ARRIVALS, each scan's once it is complete.

    ``delay``: how late rows may be behind the newest (older ones are dropped by the watermark and counted in the
    query's progress).  ``patience``: how long a scan waits, in event time, after its last row.  A plane that is sent again
    replaces the first; rows after the result give a row ``late`` with their number so far; other layers are left out.
    ``evaluated(vol_id, slices by layer, calibration, params)`` gives the rows of a complete scan.
    """
    source.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    own = calibration(F.col("log"))
    rows = source.withColumns({n: own[n] for n in CALIBRATION}).drop("log").withWatermark("arrived", delay)
    return rows.groupBy("vol_id").transformWithStateInPandas(_Arrivals(params or Evaluation(), wait, evaluated), RESULT, "Append", "EventTime")


def evaluate_arrivals(source: DataFrame, sink: str, checkpoint: str, params: Evaluation | None = None, **how) -> StreamingQuery:
    """Write the results of what has arrived as Parquet to ``sink``; called again with the same checkpoint it goes on (``how``: see ``arrivals``)."""
    out = arrivals(source, params, **how)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
