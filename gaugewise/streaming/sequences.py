"""Sequences of measurements that arrive row by row: summaries go out when a sequence is whole, or when no more comes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugewise.operators.sequence import Sequence

#: What is kept of a measurement, and what is told of a sequence.
VALUES = ("cd_nm", "angle", "delta_s", "delta_e", "s_resid", "e_resid", "mid_x", "mid_y", "px_nm")
SUMMARY = ("cd_median", "cd_mad", "delta_median_s", "delta_median_e", "traj_rms_s", "traj_rms_e", "angle_median", "angle_spread", "pitch_median", "span_nm")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def summary_of(rows: pd.DataFrame) -> dict[str, float]:
    """The columns of sequence.summarize() and max_run for the rows of one sequence in order; NaN where nothing is known."""
    v = {c: rows[c].to_numpy(float) for c in VALUES}
    finite = {c: x[np.isfinite(x)] for c, x in v.items()}
    median = lambda x: float(np.median(x)) if len(x) else np.nan
    out = {"cd_median": median(finite["cd_nm"]), "cd_mad": median(np.abs(finite["cd_nm"] - median(finite["cd_nm"])))}
    for side in "se":
        out[f"delta_median_{side}"] = median(finite[f"delta_{side}"])
        r = finite[f"{side}_resid"]
        out[f"traj_rms_{side}"] = float(np.sqrt(np.mean(r * r))) if len(r) else np.nan
    a = np.radians(finite["angle"])
    turn = np.degrees(np.arctan2(median(np.sin(2 * a)), median(np.cos(2 * a)))) / 2
    out["angle_median"], out["angle_spread"] = float(turn), median(np.abs((finite["angle"] - turn + 90) % 180 - 90))
    step, n = np.hypot(np.diff(v["mid_x"]), np.diff(v["mid_y"])), len(rows)
    px = v["px_nm"][0] if n else np.nan
    out["pitch_median"] = median(step) * px if n >= 2 and not np.isnan(step).any() else np.nan
    out["span_nm"] = float(np.hypot(v["mid_x"][-1] - v["mid_x"][0], v["mid_y"][-1] - v["mid_y"][0])) * px if n >= 2 else np.nan
    run = best = 0
    for flag in rows["flag"].fillna(False).astype(bool):
        run = run + 1 if flag else 0
        best = max(best, run)
    return out | {"max_run": best}


class _Sequences(StatefulProcessor):
    """Keeps the rows of a sequence until it has as many as it says, or until its last event is `gap` old."""

    def __init__(self, keys: tuple[str, ...], kept: T.StructType, gap_ms: int):
        self.keys, self.kept, self.gap_ms, self.columns = keys, kept, gap_ms, kept.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.kept)
        self.told = handle.getValueState("told", T.StructType([T.StructField("told", T.BooleanType())]))

    def _wait(self, until: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until)

    def _held(self) -> pd.DataFrame:
        rows = pd.DataFrame(list(self.rows.get()), columns=self.columns) if self.rows.exists() else pd.DataFrame(columns=self.columns)
        return rows.drop_duplicates("ord").sort_values("ord", ignore_index=True)

    def _result(self, key: tuple, rows: pd.DataFrame, whole: bool) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(self.keys, key)) | {"n_cd": len(rows), "complete": whole} | summary_of(rows)])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        more = pd.concat(list(rows), ignore_index=True)
        now = timerValues.getCurrentWatermarkInMs()
        self._wait(max(int(more["event_ms"].max()), now) + self.gap_ms)
        if self.told.exists():  # rows of a sequence that has been told
            return
        self.rows.appendList(list(more[self.columns].itertuples(index=False, name=None)))
        expected = more["expected"].max()
        if not pd.isna(expected):
            held = self._held()
            if len(held) >= expected:
                self.rows.clear()
                self.told.update((True,))
                yield self._result(key, held, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.told.exists():
            self.told.clear()
            return
        held = self._held()
        self.rows.clear()
        if len(held):
            yield self._result(key, held, False)

    def close(self) -> None:
        pass


def completed_sequences(measurements: DataFrame, time: str, flag: str = "flag", expected: str | None = None, gap: int = 600, late: str = "10 minutes", seq: Sequence = Sequence()) -> DataFrame:
    """A row for each sequence that ends: its keys, n_cd, complete, the summaries of sequence.summarize(), and max_run of the flag.

    measurements: a stream with the sequence's keys and order, an event time, and any of VALUES (those that lack are
    null). A sequence ends when it has `expected` rows (a column with their number; complete is then true), or when
    the watermark is `gap` seconds past its last event. Rows may come in any order and more than once: of one order
    the first counts. Rows later than `late` are left out, and so are rows that come within `gap` after their sequence
    was told. State is the open sequences' rows, by sequence; it needs the RocksDB state store, which is set here.
    """
    from pyspark.sql import functions as F

    measurements.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keys, have = list(seq.keys), set(measurements.columns)
    value = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    kept = T.StructType.fromDDL(", ".join(["ord long", *(f"{c} double" for c in VALUES), "flag boolean"]))
    rows = measurements.withWatermark(time, late).select(
        *keys, time, F.unix_millis(F.col(time).cast("timestamp")).alias("event_ms"), F.col(seq.order).cast("long").alias("ord"), *[value(c).alias(c) for c in VALUES],
        (F.col(flag) if flag in have else F.lit(None)).cast("boolean").alias("flag"), (F.col(expected) if expected else F.lit(None)).cast("double").alias("expected"),
    )
    schema = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(", ".join(["n_cd long", "complete boolean", *(f"{c} double" for c in SUMMARY), "max_run long"])).fields])
    return rows.groupBy(*keys).transformWithStateInPandas(_Sequences(tuple(keys), kept, 1000 * gap), schema, "Append", "EventTime")
