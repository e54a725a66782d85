"""Cohort statistics that are kept as a table of sketches, so that a new batch is added without reading the old rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewise.operators.convert import finite
from gaugewise.operators.stats import by_brackets, transformed
from gaugewise.registry import BY_NAME, MetrologyError, Params

#: Size of a sketch, and how far its ranks are from the true ones, as a share of all, in 99 of 100 cases (single-sided, from the sketch's published bound 2.296 / k ** 0.9021).
SIZE = 400


def rank_error(size: int = SIZE) -> float:
    return 2.296 / size**0.9021


def sketched(df: DataFrame, *keys: str, features: list[str], size: int = SIZE, params: Params = Params()) -> DataFrame:
    """keys, feature, n, sketch: a KLL sketch of each feature's finite values, as they are scored (log features in logarithms).

    Sketches are made where the rows are and merged, so no cohort is held. Keys without a finite value have no row.
    """
    value = lambda f: transformed(f, params) if f in BY_NAME else finite(F.col(f).cast("double"))
    wide = df.select(*keys, *[value(f).alias(f) for f in features])
    long = wide.unpivot(list(keys), features, "feature", "value").where("value is not null")
    return long.groupBy(*keys, "feature").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def merged(*parts: DataFrame) -> DataFrame:
    """Tables of sketched() as one: a row for each key and feature. Any order of merging keeps the error bound."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    keys = [c for c in out.columns if c not in ("n", "sketch")]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def add_batch(path: str, batch: DataFrame, *keys: str, features: list[str], size: int = SIZE, params: Params = Params()) -> None:
    """Adds a batch's sketches to the stored table at path; what is there is not read."""
    sketched(batch, *keys, features=features, size=size, params=params).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, merged."""
    return merged(spark.read.parquet(path))


def _at(q: float | Column) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.least(F.greatest(F.lit(q) if isinstance(q, float) else q, F.lit(0.0)), F.lit(1.0)))


def quantiles(sketches: DataFrame, wanted: dict[str, float], size: int = SIZE) -> DataFrame:
    """keys, feature, n and, for each name, <name>, <name>_low and <name>_high: a value near the quantile, and values between which it lies.

    The bracket is the sketch's own answer for ranks two error bounds below and above.
    """
    if wrong := [q for q in wanted.values() if not 0 <= q <= 1]:
        raise MetrologyError("E-ARG-06", str(wrong))
    keys = [c for c in sketches.columns if c not in ("n", "sketch")]
    e = 2 * rank_error(size)
    return sketches.select(*keys, "n", *[c for name, q in wanted.items() for c in (_at(float(q)).alias(name), _at(q - e).alias(f"{name}_low"), _at(q + e).alias(f"{name}_high"))])


def refined(df: DataFrame, wanted: dict[str, float], *keys: str, feature: str, params: Params = Params()) -> DataFrame:
    """The exact quantiles of a feature, where an estimate will not do: this reads the rows."""
    value = transformed(feature, params) if feature in BY_NAME else finite(F.col(feature).cast("double"))
    return by_brackets(df.select(*keys, value.alias("_value")), "_value", wanted, *keys)
