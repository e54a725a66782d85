"""Evaluation against labels: recall at a false-positive rate, localisation, ablation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.operators.convert import finite
from gaugewise.operators.score import top_score
from gaugewise.operators.stats import exact_quantiles
from gaugewise.registry import MetrologyError
from gaugewise.sources.tables import settled


def recall_at_fpr(df: DataFrame, score: str, bad: str, *keys: str, fpr: float = 0.05) -> DataFrame:
    """threshold (the 1 - fpr quantile of good scores), recall, fpr_actual, n_bad, n_good, n_nan for each key.

    Scores at the threshold are not over it. Missing scores are counted and left out. Keys without a bad or a good
    score have nulls. Scores are written once; the thresholds, of keys of any size, are exact_quantiles().
    """
    df = settled(df.select(*keys, finite(F.col(score)).alias("_s"), F.col(bad).cast("boolean").alias("_bad")))
    missing = df.groupBy(*keys).agg(F.count_if(F.col("_s").isNull()).alias("n_nan"))
    cut = exact_quantiles(df.where(~F.col("_bad")), "_s", {"threshold": 1 - fpr}, *keys)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] or F.lit(True)
    cut = settled(missing.alias("a").join(cut.alias("b"), on, "left").select(*[F.col(f"a.{k}") for k in keys], "b.threshold", "a.n_nan"))
    if keys:
        cut = cut.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "threshold", "n_nan")
        joined = df.join(cut, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    else:
        joined = df.crossJoin(F.broadcast(cut))  # one row
    over = (F.col("_s") > F.col("threshold")).cast("double")
    return joined.groupBy(*keys).agg(
        F.first("threshold").alias("threshold"), F.avg(F.when(F.col("_bad"), over)).alias("recall"), F.avg(F.when(~F.col("_bad"), over)).alias("fpr_actual"),
        F.count_if(F.col("_bad") & F.col("_s").isNotNull()).alias("n_bad"), F.count_if(~F.col("_bad") & F.col("_s").isNotNull()).alias("n_good"), F.first("n_nan").alias("n_nan"),
    )


def localization_hit(predicted: Column, true: Column, k: int = 1) -> Column:
    """Whether one of the first k predictions is among the true ones; false where there are none."""
    return F.coalesce(F.arrays_overlap(F.slice(predicted, 1, k), true), F.lit(False))


def localization(df: DataFrame, score: str, true: str, order: str, *keys: str, k: int = 1) -> DataFrame:
    """For each key with a true row, whether one of the k highest scores is true: keys, hit."""
    if k < 1:
        raise MetrologyError("E-ARG-06", str(k))
    w = Window.partitionBy(*keys).orderBy(finite(F.col(score)).desc_nulls_last(), F.col(order))
    ranked = df.withColumn("_rank", F.row_number().over(w))
    hit = F.max(((F.col("_rank") <= k) & F.col(true) & finite(F.col(score)).isNotNull()).cast("int")) == 1
    return ranked.groupBy(*keys).agg(hit.alias("hit"), F.count_if(true).alias("_true")).where("_true > 0").drop("_true")


def localization_rate(hits: DataFrame, *keys: str) -> DataFrame:
    return hits.groupBy(*keys).agg(F.avg(F.col("hit").cast("double")).alias("rate"), F.count("*").alias("n"))


def ablation_table(z: DataFrame, sets: dict[str, list[str]], bad: str, fpr: float = 0.05) -> DataFrame:
    """recall_at_fpr of the largest score within each named set of features: feature_set, n_features and the columns of it.

    All sets are computed in one pass: a row becomes one for each set.
    """
    each = F.array(*[F.struct(F.lit(name).alias("feature_set"), F.lit(len(f)).cast("long").alias("n_features"), top_score(z, f).alias("top_z")) for name, f in sets.items()])
    long = z.select(F.col(bad).alias("_label"), F.explode(each).alias("e")).select("_label", "e.*")
    return recall_at_fpr(long, "top_z", "_label", "feature_set", "n_features", fpr=fpr)
