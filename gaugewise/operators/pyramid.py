"""All features of measurements in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.functions import kernels
from gaugewise.operators import convert, image, sequence, validate
from gaugewise.registry import FEATURES, Params

KEYS = ("image_id", "category_id", "cd_index")


def extract_l3(measurements: DataFrame, images: DataFrame | None = None, masks: DataFrame | None = None, px_nm: str = "px_nm", value_nm: str | None = None, params: Params = Params(), alone: tuple[float, float] = (1.0, 0.0), beyond: bool = False) -> DataFrame:
    """KEYS, the features of a measurement in the order of the registry, and mid_x, mid_y, px_nm.

    measurements: KEYS, sx, sy, ex, ey and a column of nm a pixel, which must be finite and above 0 (E-ARG-06 when the
    row is computed); value_nm adds value_mismatch_nm. Images add the edge evidence, masks the distances from their
    boundaries. Without images evidence is null and edge_valid is false. Measurements carry their geometry along when
    they meet their image and mask, so there is one exchange of pixels and no join. alone: the direction of the edge (a
    unit vector) for a sequence of one, which has none of its own. beyond: see kernels.mask_evidence().
    """
    px = F.col(px_nm).cast("double")
    bad = F.concat(F.lit("E-ARG-06: px_nm "), F.coalesce(px.cast("string"), F.lit("null")))
    checked = F.when(convert.finite(px) > 0, px).otherwise(F.raise_error(bad).cast("double"))
    own = measurements.withColumn("px_nm", checked)
    out = sequence.geometry(own, "px_nm", value_nm, params)
    for side, name in (("s", "_s"), ("e", "_e")):
        out = sequence.unit_tangents(out, f"{side}x", f"{side}y", f"tx{name}", f"ty{name}")
    same = F.when(F.col("tx_s") * F.col("tx_e") + F.col("ty_s") * F.col("ty_e") < 0, -1.0).otherwise(1.0)
    x, y = F.col("tx_s") + same * F.col("tx_e"), F.col("ty_s") + same * F.col("ty_e")
    size = F.when(F.hypot(x, y) > 0, F.hypot(x, y)).otherwise(1.0)
    one = F.count("*").over(sequence.Sequence().whole) == 1
    out = out.withColumns({n: F.when(one, c).otherwise(v / size) for n, c, v in (("ribbon_tx", alone[0], x), ("ribbon_ty", alone[1], y))}).drop("tx_s", "ty_s", "tx_e", "ty_e")
    if images is not None:
        found = image.segment_evidence(out, images, masks, params=params, beyond=beyond)
    else:
        found = out.withColumns({c: F.lit(False) if c.startswith("edge_valid") else F.lit(None).cast("double") for c in kernels.EVIDENCE})
    names = [f.name for f in FEATURES if f.level == "l3" and f.name in found.columns]
    return found.select(*KEYS, *names, "mid_x", "mid_y", "px_nm")


def extract_l3_checked(measurements: DataFrame, images: DataFrame | None = None, masks: DataFrame | None = None, px_nm: str = "px_nm", value: str | None = None, unit: str | None = None, params: Params = Params()) -> tuple[DataFrame, validate.Validated]:
    """extract_l3() of the rows that are sound, and what the check found.

    Rejected are rows without coordinates (E-ARG-04), with some only (E-ARG-01), with a scale that is not above 0
    (E-ARG-06) and, if value and unit are named, with an unknown unit (E-ARG-03); values are brought to nm. The table
    is read once. A sequence goes on over rejected rows: its neighbours are those that stay.
    """
    rules = [validate.some_ends(), validate.whole_ends(), validate.positive(px_nm)] + ([validate.known_unit(unit)] if unit else [])
    found = validate.validated(measurements, *rules)
    good, value_nm = found.good, None
    if value and unit:
        value_nm = "value_nm"
        good = good.withColumn(value_nm, convert.to_nm(F.col(value), F.col(unit)))
    return extract_l3(good, images, masks, px_nm, value_nm, params), found
