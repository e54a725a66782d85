"""Units, coordinates, scale and bit depth."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.registry import MAD_SCALE, MetrologyError

#: Spellings of either unit, after trimming, folding and lower case.
ANGSTROM, NM = ("å", "a", "angstrom", "ang"), ("nm", "nanometer", "nanometre")
#: White space at the ends, beside what regular expressions call so.
_SPACE = "[\\s\\x1c-\\x1f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


@lru_cache(1)
def compatibility_forms() -> dict[str, str]:
    """Every character whose compatibility form (NFKC) is made of the letters of known units, with that form; others can't make a unit known."""
    letters = set("".join((*ANGSTROM, *NM))) | set("".join((*ANGSTROM, *NM)).upper()) | {"\u030a"}
    made = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return {c: form for c, form in made if form != c and letters.issuperset(form)}


def finite(x: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def normalize_unit(unit: Column) -> Column:
    """angstrom, nm, or null for what is neither. White space around it and Unicode compatibility forms do not matter."""
    forms = compatibility_forms()
    single = {k: v for k, v in forms.items() if len(v) == 1}
    plain = F.translate(F.regexp_replace(unit, f"^{_SPACE}|{_SPACE}$", ""), "".join(single), "".join(single.values()))
    for k, v in forms.items():
        if len(v) > 1:
            plain = F.replace(plain, F.lit(k), F.lit(v))
    plain = F.lower(F.regexp_replace(plain, "[aA]\u030a", "\u00c5"))
    return F.when(plain.isin(*ANGSTROM), "angstrom").when(plain.isin(*NM), "nm")


def to_nm(value: Column, unit: Column) -> Column:
    """The value in nm; an unknown unit raises E-ARG-03 when the row is computed."""
    known = normalize_unit(unit)
    wrong = F.raise_error(F.concat(F.lit("E-ARG-03: unknown unit "), F.coalesce(unit, F.lit("null")))).cast("double")
    return F.when(known == "angstrom", value * 0.1).when(known == "nm", value).otherwise(wrong)


def unknown_units(df: DataFrame, unit: str) -> list[str | None]:
    """The distinct units of a column that are not known, sorted; for a check before a long job."""
    rows = df.select(F.col(unit).cast("string").alias("u")).where(normalize_unit(F.col("u")).isNull()).distinct().collect()
    return sorted((r.u for r in rows), key=lambda u: (u is not None, u or ""))


def require_known_units(df: DataFrame, unit: str) -> DataFrame:
    if bad := unknown_units(df, unit):
        raise MetrologyError("E-ARG-03", ", ".join(map(str, bad)))
    return df


def transform_coords(x: Column, y: Column, convention: str = "xy", origin: str = "zero", y_flip: bool = False, scale: float = 1.0, height: Column | float | None = None) -> tuple[Column, Column]:
    """Scale, origin, order of axes, flip, one after the other."""
    if convention not in ("xy", "rowcol") or origin not in ("zero", "one") or (y_flip and height is None):
        raise MetrologyError("E-ARG-06", f"{convention}, {origin}")
    x, y = x * scale, y * scale
    if origin == "one":
        x, y = x - 1, y - 1
    if convention == "rowcol":
        x, y = y, x
    if y_flip:
        y = (height if isinstance(height, Column) else F.lit(float(height))) - 1 - y
    return x, y


def convention_candidates() -> list[dict]:
    """The eight ways in which coordinates are written, in a fixed order."""
    return [{"convention": c, "y_flip": f, "origin": o} for c, f, o in product(("xy", "rowcol"), (False, True), ("zero", "one"))]


def transform_all(df: DataFrame, x: str, y: str, height: Column, scale: float = 1.0) -> DataFrame:
    """df once for each candidate, with tx and ty under it; the eight structs are built in the row, without a join."""
    made = []
    for c in convention_candidates():
        tx, ty = transform_coords(F.col(x), F.col(y), c["convention"], c["origin"], c["y_flip"], scale, height)
        made.append(F.struct(*(F.lit(v).alias(k) for k, v in c.items()), tx.alias("tx"), ty.alias("ty")))
    return df.withColumn("_c", F.explode(F.array(*made))).select("*", "_c.*").drop("_c")


def length_px(sx: str = "sx", sy: str = "sy", ex: str = "ex", ey: str = "ey") -> Column:
    return F.hypot(F.col(ex) - F.col(sx), F.col(ey) - F.col(sy))


def infer_px_nm(df: DataFrame, value_nm: str, *keys: str) -> DataFrame:
    """nm a pixel for each key: the median of value to length, over lengths above 1e-9 and finite values."""
    ratio = F.when(length_px() > 1e-9, finite(F.col(value_nm)) / length_px())
    return df.groupBy(*keys).agg(F.median(finite(ratio)).alias("px_nm"))


def ratio_cv(df: DataFrame, value_nm: str, *keys: str) -> DataFrame:
    """Robust coefficient of variation of value to length for each key; null below three ratios."""
    ratio = finite(F.when(length_px() > 1e-9, finite(F.col(value_nm)) / length_px()))
    each = df.select(*keys, ratio.alias("_r")).where("_r is not null")
    each = each.withColumn("_m", F.percentile("_r", F.lit(0.5)).over(Window.partitionBy(*keys)))
    mad = F.median(F.abs(F.col("_r") - F.col("_m")))
    cv = F.when(F.count("*") >= 3, MAD_SCALE * mad / F.greatest(F.abs(F.first("_m")), F.lit(1e-12)))
    return df.select(*keys).distinct().join(each.groupBy(*keys).agg(cv.alias("ratio_cv")), list(keys), "left")


def to_uint8(df: DataFrame, value: str, *image: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Pixels (one a row) stretched between two quantiles of their image, clipped and truncated; a flat image is zero."""
    w = Window.partitionBy(*image)
    out = df.withColumn("_q", F.percentile(value, F.array(F.lit(low), F.lit(high))).over(w))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    scaled = F.round((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 255.0, 9)
    return out.withColumn("v", F.when(hi <= lo, 0).otherwise(F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)))).cast("int")).drop("_q")


def shift_to_uint8(value: Column) -> Column:
    """A 16-bit value's upper byte."""
    return F.shiftright(value, 8)
