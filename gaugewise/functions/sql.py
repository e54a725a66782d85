"""The library's functions for SQL: scalar ones that Spark inlines, and a table function over partitioned tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gaugewise.operators.convert import _SPACE, ANGSTROM, NM, compatibility_forms, convention_candidates
from gaugewise.operators.image import as_image, candidate_offsets


def _text(s: str) -> str:
    """A string literal of SQL."""
    return "'" + "".join(c if c.isascii() and c.isalnum() else f"\\U{ord(c):08X}" for c in s) + "'"


def _unit_sql(unit: str) -> str:
    forms = compatibility_forms()
    single = {k: v for k, v in forms.items() if len(v) == 1}
    plain = f"translate(regexp_replace({unit}, {_text(f'^{_SPACE}|{_SPACE}$')}, ''), {_text(''.join(single))}, {_text(''.join(single.values()))})"
    for k, v in forms.items():
        if len(v) > 1:
            plain = f"replace({plain}, {_text(k)}, {_text(v)})"
    plain = f"lower(regexp_replace({plain}, {_text('[aA]' + chr(0x30A))}, {_text(chr(0xC5))}))"
    listed = lambda names: ", ".join(map(_text, names))
    return f"CASE WHEN {plain} IN ({listed(ANGSTROM)}) THEN 'angstrom' WHEN {plain} IN ({listed(NM)}) THEN 'nm' END"


#: Name, arguments, kind and body of each scalar function; bodies may use those before them.
SCALARS = (
    ("normalize_unit", "unit STRING", "STRING", lambda: _unit_sql("unit")),
    ("to_nm", "value DOUBLE, unit STRING", "DOUBLE", lambda: "CASE normalize_unit(unit) WHEN 'angstrom' THEN value * 0.1D WHEN 'nm' THEN value ELSE CAST(raise_error('E-ARG-03: unknown unit ' || coalesce(unit, 'null')) AS DOUBLE) END"),
    ("finite", "x DOUBLE", "DOUBLE", lambda: "CASE WHEN isnan(x) OR abs(x) = double('infinity') THEN NULL ELSE x END"),
    ("length_px", "sx DOUBLE, sy DOUBLE, ex DOUBLE, ey DOUBLE", "DOUBLE", lambda: "hypot(ex - sx, ey - sy)"),
    ("segment_angle", "sx DOUBLE, sy DOUBLE, ex DOUBLE, ey DOUBLE", "DOUBLE", lambda: "degrees(atan2(ey - sy, ex - sx))"),
    ("circular_distance", "angle DOUBLE, other DOUBLE", "DOUBLE", lambda: "abs(pmod(angle - other + 90, 180) - 90)"),
)
_POINTS = ("sx", "sy", "ex", "ey")


@udtf
class ConventionOffsets:
    """convention_offsets(TABLE(t) PARTITION BY (image_id) [, scale]): image_id, convention, y_flip, origin, dist.

    t has image_id, sx, sy, ex, ey, h, w, pixels: rows of segments, and a row with the pixels of the image (see
    image_rows()). For each end of each segment and each way of writing coordinates, how far the edge is from it;
    images without pixels give nothing.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, scale: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable or (missing := [c for c in ("image_id", *_POINTS, "h", "w", "pixels") if c not in rows.dataType.names]):
            raise ValueError(f"E-ARG-06: convention_offsets takes a table with image_id, {', '.join(_POINTS)}, h, w, pixels" + (f"; it lacks {missing}" if rows.isTable else ""))
        kinds = [("convention", T.StringType()), ("y_flip", T.BooleanType()), ("origin", T.StringType()), ("dist", T.DoubleType())]
        return AnalyzeResult(T.StructType([T.StructField("image_id", rows.dataType["image_id"].dataType), *(T.StructField(n, k) for n, k in kinds)]))

    def __init__(self):
        self.image_id, self.image, self.points, self.scale = None, None, [], 1.0

    def eval(self, row: Row, scale: float = 1.0) -> None:
        self.image_id, self.scale = row["image_id"], float(scale)
        if row["pixels"] is not None and self.image is None:
            self.image = as_image(row)
        if row["sx"] is not None:
            self.points.append([row[c] if row[c] is not None else np.nan for c in _POINTS])

    def terminate(self) -> Iterator[tuple]:
        if self.image is not None and self.points:
            p = np.array(self.points, float)
            for c, d in zip(convention_candidates(), candidate_offsets(self.image, p[:, :2], p[:, 2:], self.scale)):
                for x in d.tolist():
                    yield self.image_id, c["convention"], c["y_flip"], c["origin"], x


def image_rows(segments: DataFrame, images: DataFrame) -> DataFrame:
    """Segments and their images as one table for convention_offsets(): pixels are in rows of their own."""
    none = lambda kind: F.lit(None).cast(kind)
    s = segments.select("image_id", *[F.col(c).cast("double").alias(c) for c in _POINTS], none("int").alias("h"), none("int").alias("w"), none("binary").alias("pixels"))
    i = images.select("image_id", *[none("double").alias(c) for c in _POINTS], F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), "pixels")
    return s.unionByName(i)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, arguments, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body()}")
    spark.udtf.register("convention_offsets", ConventionOffsets)
