"""Scoring measurements as they arrive, against statistics fitted before; runs of flags by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.operators import score
from gaugewise.registry import Params


def score_stream(measurements: DataFrame, stats: DataFrame, *keys: str, features: list[str] | None = None, params: Params = Params()) -> DataFrame:
    """apply_z and top_feature on a streaming frame: a stream-static join without state, so results go out row by row."""
    return score.top_feature(score.apply_z(measurements, stats, *keys, features=features, params=params), features)


def flagged_runs(scored: DataFrame, threshold: float, time: str, *keys: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of flagged rows: keys, start, end, n_flagged, worst. Rows later than `late` are left out, and state is dropped with them."""
    flagged = scored.withWatermark(time, late).where(F.col("top_z") > threshold)
    out = flagged.groupBy(*keys, F.session_window(F.col(time), gap).alias("w")).agg(F.count("*").alias("n_flagged"), F.max("top_z").alias("worst"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_flagged", "worst")


def flagged_fraction(scored: DataFrame, threshold: float, time: str, *keys: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """frac_flagged over tumbling windows of event time."""
    w = scored.withWatermark(time, late).groupBy(*keys, F.window(F.col(time), window).alias("w"))
    out = w.agg(F.count("*").alias("n"), F.avg((F.col("top_z") > threshold).cast("double")).alias("frac_flagged"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "frac_flagged")
