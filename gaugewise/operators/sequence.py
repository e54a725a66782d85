"""Ordered sequences of measurements: windows over (keys) in order of an explicit index.

All windows of one call have the same partitioning and order, so Spark shuffles and sorts a sequence once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewise.operators.convert import finite, length_px
from gaugewise.registry import Params


@dataclass(frozen=True)
class Sequence:
    """Which columns name a sequence, and which orders it."""

    keys: tuple[str, ...] = ("image_id", "category_id")
    order: str = "cd_index"

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def rows(self, half: int) -> WindowSpec:
        return self.window.rowsBetween(-half, half)

    @property
    def whole(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _unit(x: Column, y: Column) -> tuple[Column, Column]:
    n = F.hypot(x, y)
    n = F.when(n == 0, 1.0).otherwise(n)
    return x / n, y / n


def unit_tangents(df: DataFrame, x: str, y: str, tx: str, ty: str, seq: Sequence = Sequence()) -> DataFrame:
    """Adds tx and ty: the direction from the point before to the point after; (1, 0) for a sequence of one."""
    w = seq.window
    d = [F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in (x, y)]
    one = F.count("*").over(seq.whole) == 1
    df = df.withColumns({"_dx": d[0], "_dy": d[1], "_one": one})
    ux, uy = _unit(F.col("_dx"), F.col("_dy"))
    return df.withColumns({tx: F.when(F.col("_one"), 1.0).otherwise(ux), ty: F.when(F.col("_one"), 0.0).otherwise(uy)}).drop("_dx", "_dy", "_one")


@F.arrow_udf(T.DoubleType())
def _theil_sen(index: pa.Array, values: pa.Array, at: pa.Array) -> pa.Array:
    """The fit at `at` of the line through a window: medians of the pairwise slopes and of the intercepts."""
    n = len(at)
    sizes = np.diff(values.offsets.to_numpy())
    width = int(sizes.max()) if n else 0
    if not width:
        return pa.nulls(n, pa.float64())
    t, v = np.full((n, width), np.nan), np.full((n, width), np.nan)
    slot = np.arange(width) < sizes[:, None]
    t[slot] = index.flatten().to_numpy(zero_copy_only=False)
    v[slot] = values.flatten().to_numpy(zero_copy_only=False)
    x = at.to_numpy(zero_copy_only=False).astype(np.float64)
    t -= x[:, None]

    def median(a: np.ndarray) -> np.ndarray:
        a = np.sort(a, axis=1)  # NaN last
        k = (~np.isnan(a)).sum(axis=1)
        r = np.arange(len(a))
        return np.where(k > 0, (a[r, np.maximum(k - 1, 0) // 2] + a[r, np.minimum(k // 2, a.shape[1] - 1)]) / 2, np.nan)

    i, j = np.triu_indices(width, 1)
    slope = median((v[:, j] - v[:, i]) / (t[:, j] - t[:, i])) if width > 1 else np.full(n, np.nan)
    line = median(v - slope[:, None] * t)
    fit = np.where((~np.isnan(v)).sum(axis=1) < 3, median(v), line)
    return pa.array(fit, mask=np.isnan(fit))


def local_fit(column: str, params: Params = Params(), seq: Sequence = Sequence()) -> Column:
    """The local trend of a column at each row: the median of a window, or the Theil-Sen line through it."""
    w = seq.rows(params.local_window // 2)
    v = finite(F.col(column))
    if params.method == "hampel":
        return F.percentile(v, F.lit(0.5)).over(w)
    return _theil_sen(F.collect_list(F.col(seq.order).cast("double")).over(w), F.transform(F.collect_list(F.struct(v.alias("v"))).over(w), lambda s: s["v"]), F.col(seq.order).cast("double"))


def local_residual(df: DataFrame, column: str, out: str, params: Params = Params(), seq: Sequence = Sequence()) -> DataFrame:
    """Adds the column less its local trend; null in sequences shorter than the least length. Orders are 0, 1, 2, ..."""
    df = df.withColumns({"_fit": local_fit(column, params, seq), "_n": F.count("*").over(seq.whole)})
    return df.withColumn(out, F.when(F.col("_n") >= params.min_seq_len, finite(F.col(column)) - F.col("_fit"))).drop("_fit", "_n")


def normal_residual(df: DataFrame, x: str, y: str, out: str, params: Params = Params(), seq: Sequence = Sequence()) -> DataFrame:
    """Adds the residual of a trajectory along its normal, signed."""
    df = unit_tangents(df, x, y, "_tx", "_ty", seq)
    df = df.withColumns({"_fx": local_fit(x, params, seq), "_fy": local_fit(y, params, seq), "_n": F.count("*").over(seq.whole)})
    along = (F.col(x) - F.col("_fx")) * -F.col("_ty") + (F.col(y) - F.col("_fy")) * F.col("_tx")
    return df.withColumn(out, F.when(F.col("_n") >= params.min_seq_len, along)).drop("_tx", "_ty", "_fx", "_fy", "_n")


def step_normal(df: DataFrame, x: str, y: str, out: str, seq: Sequence = Sequence()) -> DataFrame:
    """Adds the size of the step to a neighbour along the trajectory's normal: the smaller one of both, null for a sequence of one.

    Directions are medians of seven tangents by component, so that a jump does not turn the normal that it is measured on.
    """
    df = unit_tangents(df, x, y, "_tx", "_ty", seq)
    smooth = [F.percentile(c, F.lit(0.5)).over(seq.rows(3)) for c in ("_tx", "_ty")]
    df = df.withColumns({"_mx": smooth[0], "_my": smooth[1], "_n": F.count("*").over(seq.whole)})
    ux, uy = _unit(F.col("_mx"), F.col("_my"))
    df = df.withColumns({"_ux": F.when(F.col("_n") < 3, F.col("_tx")).otherwise(ux), "_uy": F.when(F.col("_n") < 3, F.col("_ty")).otherwise(uy)})
    w = seq.window
    after = {c: F.lead(c).over(w) for c in (x, y, "_ux", "_uy")}
    gap = F.abs((after[x] - F.col(x)) * -0.5 * (F.col("_uy") + after["_uy"]) + (after[y] - F.col(y)) * 0.5 * (F.col("_ux") + after["_ux"]))
    df = df.withColumn("_gap", gap)
    return df.withColumn(out, F.least("_gap", F.lag("_gap").over(w))).drop("_tx", "_ty", "_mx", "_my", "_n", "_ux", "_uy", "_gap")


def curvature(x: str, y: str, seq: Sequence = Sequence()) -> Column:
    """Size of the second difference; null at both ends."""
    w = seq.window
    return F.hypot(*[F.lag(c).over(w) - 2 * F.col(c) + F.lead(c).over(w) for c in (x, y)])


def obliquity(df: DataFrame, out: str, seq: Sequence = Sequence()) -> DataFrame:
    """Adds how far a segment's angle to the edges' mean direction is from the sequence's median, in degrees; also ribbon_tx and ribbon_ty."""
    df = unit_tangents(unit_tangents(df, "sx", "sy", "_sx", "_sy", seq), "ex", "ey", "_ex", "_ey", seq)
    sign = F.when(F.col("_sx") * F.col("_ex") + F.col("_sy") * F.col("_ey") < 0, -1.0).otherwise(1.0)
    mx, my = _unit(F.col("_sx") + sign * F.col("_ex"), F.col("_sy") + sign * F.col("_ey"))
    df = df.withColumns({"ribbon_tx": mx, "ribbon_ty": my})
    length = length_px()
    dot = ((F.col("ex") - F.col("sx")) * F.col("ribbon_tx") + (F.col("ey") - F.col("sy")) * F.col("ribbon_ty")) / F.when(length == 0, 1.0).otherwise(length)
    df = df.withColumn("_theta", F.degrees(F.asin(F.least(F.abs(dot), F.lit(1.0)))))
    return df.withColumn(out, F.abs(F.col("_theta") - F.percentile("_theta", F.lit(0.5)).over(seq.whole))).drop("_sx", "_sy", "_ex", "_ey", "_theta")


def segment_angle() -> Column:
    """Degrees, above -180 to 180."""
    return F.degrees(F.atan2(F.col("ey") - F.col("sy"), F.col("ex") - F.col("sx")))


def geometry(df: DataFrame, px_nm: str = "px_nm", value_nm: str | None = None, params: Params = Params(), seq: Sequence = Sequence()) -> DataFrame:
    """Adds all features of measurements that need no image: lengths in nm, residuals, steps, angles, midpoints."""
    px = F.col(px_nm)
    df = df.withColumns({"cd_nm": length_px() * px, "angle": segment_angle(), "mid_x": (F.col("sx") + F.col("ex")) / 2, "mid_y": (F.col("sy") + F.col("ey")) / 2})
    df = local_residual(df, "cd_nm", "cd_resid", params, seq)
    for side in "se":
        x, y = f"{side}x", f"{side}y"
        df = normal_residual(df, x, y, f"{side}_resid", params, seq)
        df = step_normal(df, x, y, f"dstep_{side}", seq)
        df = df.withColumn(f"curv_{side}", curvature(x, y, seq))
    df = obliquity(df, "obliquity", seq)
    scaled = {c: F.col(c) * px for c in ("s_resid", "e_resid", "dstep_s", "dstep_e", "curv_s", "curv_e")}
    if value_nm:
        scaled["value_mismatch_nm"] = F.col(value_nm) - F.col("cd_nm")
    return df.withColumns(scaled)


def circular_median(angle: Column) -> Column:
    """Median direction of angles that are the same half a turn on, in degrees; an aggregate."""
    r = F.radians(angle)
    return F.degrees(F.atan2(F.median(F.sin(2 * r)), F.median(F.cos(2 * r)))) / 2


def circular_distance(angle: Column, median: Column) -> Column:
    return F.abs(F.pmod(angle - median + 90.0, F.lit(180.0)) - 90.0)


def summarize(df: DataFrame, seq: Sequence = Sequence()) -> DataFrame:
    """One row a sequence: count, medians, spread, trajectory noise, direction, pitch and span. Columns that df lacks are null.

    Rows with a null key are left out.
    """
    keys = list(seq.keys)
    w = seq.window
    have = set(df.columns)
    col = lambda c: finite(F.col(c)) if c in have else F.lit(None).cast("double")
    df = df.where(" and ".join(f"{k} is not null" for k in keys))
    names = ["cd_nm", "angle", "delta_s", "delta_e", "s_resid", "e_resid"]
    df = df.select(*keys, seq.order, *[col(c).alias(c) for c in names], *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in ("mid_x", "mid_y", "px_nm")])
    df = df.withColumns({"_step": F.hypot(F.lead("mid_x").over(w) - F.col("mid_x"), F.lead("mid_y").over(w) - F.col("mid_y")), "_cd": F.percentile("cd_nm", F.lit(0.5)).over(seq.whole)})
    first, last = (f(F.struct("mid_x", "mid_y", "px_nm"), F.col(seq.order)) for f in (F.min_by, F.max_by))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n_cd"), F.median("cd_nm").alias("cd_median"), F.median(F.abs(F.col("cd_nm") - F.col("_cd"))).alias("cd_mad"),
        F.median("delta_s").alias("delta_median_s"), F.median("delta_e").alias("delta_median_e"),
        F.sqrt(F.avg(F.col("s_resid") * F.col("s_resid"))).alias("traj_rms_s"), F.sqrt(F.avg(F.col("e_resid") * F.col("e_resid"))).alias("traj_rms_e"),
        circular_median(F.col("angle")).alias("angle_median"), F.median("_step").alias("_pitch"), F.count("_step").alias("_steps"), first.alias("_first"), last.alias("_last"),
        F.collect_list("angle").alias("_angles"),
    )
    spread = F.sort_array(F.transform("_angles", lambda a: circular_distance(a, F.col("angle_median"))))
    n = F.size("_angles")
    middle = (F.try_element_at(spread, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(spread, F.floor(n / 2 + 1).cast("int"))) / 2
    px = F.col("_first.px_nm")
    whole = F.col("_steps") == F.col("n_cd") - 1
    span = F.hypot(F.col("_last.mid_x") - F.col("_first.mid_x"), F.col("_last.mid_y") - F.col("_first.mid_y")) * px
    return out.withColumns({"angle_spread": F.when(n > 0, middle), "pitch_median": F.when((F.col("n_cd") >= 2) & whole, F.col("_pitch") * px), "span_nm": F.when(F.col("n_cd") >= 2, span)}).drop("_pitch", "_steps", "_first", "_last", "_angles")
