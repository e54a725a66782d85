"""Statistics that change over time, joined as they were when a measurement was made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(measurements: DataFrame, versions: DataFrame, time: str, valid_from: str, *keys: str, slices: str = "day") -> DataFrame:
    """measurements with the columns of the version of their keys that held at their time; null before the first.

    versions: keys, valid_from, and values; a version holds from its time on, that time included, until the next one.
    Of versions of one time the greatest by its values holds. A row of measurements is a row of the result; a null
    time has no version. Columns of versions that measurements have too get the suffix "_version".

    Both are one table in order of time, and a window carries the last version forward: no range join. So that a key
    with very many rows is not one task, time is cut into slices, and each slice starts with the version that held
    before it; those are found among versions and the slices that occur, not among measurements.
    """
    values = [c for c in versions.columns if c not in keys]
    name = {c: f"{c}_version" if c in measurements.columns else c for c in values}
    key = [f"_k{i}" for i in range(len(keys))]
    at, cut = F.col("_time"), F.date_trunc(slices, F.col("_time")).alias("_slice")
    one = measurements.select(*[F.col(k).alias(a) for k, a in zip(keys, key)], F.col(time).alias("_time"), F.struct(*measurements.columns).alias("_row"))
    two = versions.where(F.col(valid_from).isNotNull()).select(*[F.col(k).alias(a) for k, a in zip(keys, key)], F.col(valid_from).alias("_time"), F.struct(*values).alias("_version"))
    two = two.groupBy(*key, "_time").agg(F.max("_version").alias("_version"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    starts = one.where("_time is not null").select(*key, cut).distinct().select(*key, F.col("_slice").cast(one.schema["_time"].dataType).alias("_time"), none(two, "_version"), F.lit(0).alias("_kind"))
    w = Window.partitionBy(*key).orderBy("_time", "_kind")  # a version of the very start is found in its slice
    held = starts.unionByName(two.withColumn("_kind", F.lit(1)))
    held = held.withColumn("_version", F.last("_version", ignorenulls=True).over(w)).where("_version is not null")
    seeds = held.select(*key, "_time", cut, "_version", none(one, "_row"), "_kind")
    rows = one.select(*key, "_time", cut, none(two, "_version"), "_row", F.lit(2).alias("_kind"))
    w = Window.partitionBy(*key, "_slice").orderBy("_time", "_kind")
    both = seeds.unionByName(rows).withColumn("_version", F.last("_version", ignorenulls=True).over(w))
    out = both.where("_kind = 2").withColumn("_version", F.when(at.isNotNull(), F.col("_version")))
    return out.select("_row.*", *[F.col(f"_version.{c}").alias(name[c]) for c in values])
