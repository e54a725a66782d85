"""Directed scores, and the strongest one of a row with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.operators.convert import finite
from gaugewise.operators.stats import transformed
from gaugewise.registry import BY_NAME, FEATURES, MAD_SCALE, Z_ON_BAD, MetrologyError, Params


def directed(z: Column, worse_when: str) -> Column:
    """Larger is worse."""
    return F.abs(z) if worse_when == "both" else -z if worse_when == "low" else z


def apply_z(df: DataFrame, stats: DataFrame, *keys: str, features: list[str] | None = None, params: Params = Params()) -> DataFrame:
    """Adds z_<feature> (and zs_<feature>, signed, where both directions are bad) to df.

    stats: the rows of cohort_stats(). They are gathered to one row a cohort and joined on the cohort's keys; a cohort
    has a row for each of at most 60 features, so Spark broadcasts them when they are as few as it allows. A feature
    without statistics, or a missing value, has a null score; a yes-or-no feature scores 4.0 when it is false, a match
    feature when its sign is known and not the cohort's.
    """
    have = [f for f in FEATURES if f.name in df.columns and (features is None or f.name in features)]
    z = [f.name for f in have if f.kind == "z"]
    match = [f.name for f in have if f.kind == "match"]
    pick = lambda c, f: F.max(F.when(F.col("feature") == f, F.col(c)))
    aggs = [x for f in z for x in (pick("median", f).alias(f"_med_{f}"), pick("mad", f).alias(f"_mad_{f}"))] + [pick("mode", f).alias(f"_mode_{f}") for f in match]
    wide = stats.groupBy(*keys).agg(*(aggs or [F.count("*").alias("_none")]))
    if keys:
        wide = wide.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in wide.columns if c not in keys])
        out = df.join(wide, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], "left").drop(*[f"_key_{k}" for k in keys])
    else:
        out = df.crossJoin(F.broadcast(wide))  # one row
    made: dict[str, Column] = {}
    for f in z:
        scale = F.when(F.col(f"_mad_{f}").isNotNull(), F.greatest(MAD_SCALE * F.col(f"_mad_{f}"), F.lit(params.floor(f))))
        score = (transformed(f, params) - F.col(f"_med_{f}")) / scale
        worse = params.worse_when(f)
        made[f"z_{f}"] = directed(score, worse)
        if worse == "both":
            made[f"zs_{f}"] = score
    for f in have:
        if f.kind == "bool":
            made[f"z_{f.name}"] = F.when(~F.col(f.name).cast("boolean"), Z_ON_BAD).otherwise(0.0)
        elif f.kind == "match":
            v, mode = finite(F.col(f.name).cast("double")), F.col(f"_mode_{f.name}")
            made[f"z_{f.name}"] = F.when((mode != 0) & v.isNotNull() & (v != 0) & (v != mode), Z_ON_BAD).otherwise(0.0)
    return out.withColumns(made).drop(*[c for c in out.columns if c.startswith(("_med_", "_mad_", "_mode_")) or c == "_none"])


def _chosen(df: DataFrame, features: list[str] | None) -> list[str]:
    if features is not None and (wrong := sorted(set(features) - BY_NAME.keys())):
        raise MetrologyError("E-ARG-05", ", ".join(wrong))
    names = [f.name for f in FEATURES if f.enabled] if features is None else features
    names = [n for n in names if f"z_{n}" in df.columns]
    if not names:
        raise MetrologyError("E-ARG-04", "no scores")
    return names


def top_score(df: DataFrame, features: list[str] | None = None) -> Column:
    """The largest finite score of a row."""
    scores = [finite(F.col(f"z_{n}")) for n in _chosen(df, features)]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def top_feature(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Adds top_z, top_feature and reason_code; the first of equal scores wins. A row without scores has null and empty strings."""
    names = _chosen(df, features)
    df = df.withColumn("top_z", top_score(df, features))
    first = F.coalesce(*[F.when(finite(F.col(f"z_{n}")) == F.col("top_z"), F.lit(n)) for n in names], F.lit(""))
    df = df.withColumn("top_feature", first)
    reasons = F.create_map(*[F.lit(x) for n in names for x in (n, BY_NAME[n].reason)])
    return df.withColumn("reason_code", F.coalesce(F.try_element_at(reasons, F.col("top_feature")), F.lit("")))
