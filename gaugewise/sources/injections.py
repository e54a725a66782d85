"""Known failures put into measurement tables, to see which scores answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each failure changes in a row that it hits, by its strength.
INJECTIONS: dict[str, Callable[[Column], dict[str, Column]]] = {
    "jump": lambda s: {"sx": F.col("sx") + s},
    "tilt": lambda s: {"ey": F.col("ey") + s},
    "slip": lambda s: {"value_nm": F.col("value_nm") * (1 + s / 100)},
}


def inject(df: DataFrame, hit: Column, strengths: tuple[float, ...], failures: tuple[str, ...] = tuple(INJECTIONS)) -> DataFrame:
    """df once for each failure and strength, with failure, strength and hit; rows that are hit are changed. A projection: no row meets another."""
    cases = F.array(*[F.struct(F.lit(f).alias("failure"), F.lit(float(s)).alias("strength")) for f in failures for s in strengths])
    out = df.withColumn("hit", hit).withColumn("_case", F.explode(cases)).select("*", "_case.*").drop("_case")
    changed: dict[str, Column] = {}
    for f in failures:
        for name, value in INJECTIONS[f](F.col("strength")).items():
            changed[name] = F.when(F.col("hit") & (F.col("failure") == f), value).otherwise(changed.get(name, F.col(name)))
    return out.withColumns(changed)
