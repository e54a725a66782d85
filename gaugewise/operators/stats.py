"""Robust statistics of cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.operators.convert import finite
from gaugewise.sources.tables import settled
from gaugewise.registry import BY_NAME, FEATURES, LOG_EPS, MAD_SCALE, MetrologyError, Params


def transformed(name: str, params: Params = Params()) -> Column:
    """A feature as it is scored: finite, and in logarithms if it is a log feature."""
    x = finite(F.col(name).cast("double"))
    return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(0.0)) + LOG_EPS)) if name in params.log_features else x


#: Accuracy of the sketches that bracket a quantile, and how far a bracket reaches on either side of it.
ACCURACY, REACH = 10_000, 3e-4


#: Rows of the largest cohort up to which a cohort is put in order by one task.
TOGETHER = 1_000_000


def _largest(sizes: DataFrame) -> int:
    return sizes.agg(F.max("n")).first()[0] or 0


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], *keys: str) -> DataFrame:
    """For each key n and exact, linearly interpolated quantiles, named by the dict, of a cohort of any size.

    Up to TOGETHER rows a cohort, counts of equal values are summed and put in order; beyond, see by_brackets(). Keys
    without a value have no row. The size of the largest cohort is a job of its own.
    """
    x = df.select(*keys, F.col(value).cast("double").alias("_x")).where("_x is not null")
    if _largest(x.groupBy(*keys).agg(F.count("*").alias("n"))) > TOGETHER:
        return by_brackets(x, "_x", quantiles, *keys)
    each = x.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_x", F.array(*map(F.lit, quantiles.values()))).alias("_q"))
    return each.where("n > 0").select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(quantiles)])


def by_brackets(df: DataFrame, value: str, quantiles: dict[str, float], *keys: str, reach: float = REACH) -> DataFrame:
    """exact_quantiles() for cohorts that no task can hold.

    A mergeable sketch brackets each quantile. What lies below a bracket is counted, and only the distinct values
    within it, with their counts, are put in order; so every step is pre-aggregated where the rows are, df is read
    twice and never shuffled, and no task holds a cohort. The brackets, a row a key, are written by a job of their own,
    so that Spark knows their size when it joins them. Keys without a value have no row. Whether each rank lay in its
    bracket is checked; where it did not, the key is done again with a bracket of all its values (reach 1).
    """
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] or F.lit(True)
    x = df.select(*keys, F.col(value).cast("double").alias("_x")).where("_x is not null")
    named = [(name, q, F.percentile_approx("_x", F.array(F.lit(max(q - reach, 0.0)), F.lit(min(q + reach, 1.0))), F.lit(ACCURACY)).alias(f"_at_{name}")) for name, q in quantiles.items()]
    brackets = x.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), *[b for _, _, b in named])
    out = brackets = settled(brackets)
    few = F.col("_n") < int(2 / reach) if reach < 1 else F.lit(True)  # with more, a bracket holds the sketch's error and the next rank too
    spans = F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(q).alias("_q"), F.when(few, F.col("_min")).otherwise(F.col(f"_at_{name}")[0]).alias("_lo"), F.when(few, F.col("_max")).otherwise(F.col(f"_at_{name}")[1]).alias("_hi")) for name, q, _ in named])
    spans = brackets.select(*keys, "_n", F.explode(spans).alias("_span")).select(*keys, "_n", "_span.*")
    both = x.alias("x").join(spans.alias("s"), on("x", "s")).select(*[F.col(f"x.{k}") for k in keys], "x._x", "s._n", "s._name", "s._q", "s._lo", "s._hi").where("_x <= _hi")
    # all that is below a bracket becomes one value
    steps = both.groupBy(*keys, "_name", "_q", "_n", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys, "_name").orderBy(F.col("_v").asc_nulls_first())
    steps = steps.withColumn("_upto", F.sum("_c").over(w)).withColumn("_rank", F.col("_q") * (F.col("_n") - 1))
    at = lambda r: F.max(F.when((F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r), F.col("_v")))
    low, high = at(F.floor("_rank")), at(F.ceil("_rank"))
    got = steps.groupBy(*keys, "_name").agg((low + (high - low) * (F.first("_rank") - F.floor(F.first("_rank")))).alias("_value"))
    wide = got.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in quantiles])
    found = settled(out.alias("a").join(wide.alias("b"), on("a", "b")).select(*[F.col(f"a.{k}") for k in keys], F.col("a._n").alias("n"), *[F.col(f"b.{name}") for name in quantiles]))
    lost = " or ".join(f"`{name}` is null" for name in quantiles)
    if reach >= 1 or not found.where(lost).take(1):
        return found
    again = found.where(lost).select(*keys)
    rest = x.alias("a").join(again.alias("b"), on("a", "b"), "left_semi") if keys else x
    return found.where(f"not ({lost})").unionByName(by_brackets(rest, "_x", quantiles, *keys, reach=1.0))


def robust_stats(df: DataFrame, value: str, *keys: str, trim: float = 0.05) -> DataFrame:
    """For each key n (rows with a finite value), median and raw median absolute deviation, after one trim.

    With ten values or more, those whose distance from the median is beyond the (1 - trim) quantile are left out and
    both are computed again. Keys without a value have no row. Values are written once. If no cohort has more than
    TOGETHER of them, one exchange brings each to a task and all levels are windows over it. Cohorts of any other size
    take four levels (median; deviation and cut; both again), each a small table that by_brackets() finds and the
    next level joins; deviations are written once. This runs jobs while it is called.
    """

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
        return a.join(b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] or F.lit(True)).drop(*[f"_k_{k}" for k in keys])

    off = F.abs(F.col("x") - F.col("med"))
    x = settled(df.select(*keys, finite(F.col(value).cast("double")).alias("x")).where("x is not null"))
    sizes = x.groupBy(*keys).agg(F.count("*").alias("n"))
    if _largest(sizes) <= TOGETHER:
        return _robust_windows(x, keys, trim)
    level = by_brackets(x, "x", {"med": 0.5}, *keys)
    sizes = level.select(*keys, "n")
    x = settled(joined(x, level).withColumn("dev", off))
    if trim > 0:
        spread = by_brackets(x, "dev", {"mad": 0.5, "cut": 1 - trim}, *keys).drop("n")
        x = joined(x, spread)
        x = settled(x.where(~_beyond(F.col("n"), F.col("dev"), F.col("mad"), F.col("cut"))).select(*keys, "x"))
        level = by_brackets(x, "x", {"med": 0.5}, *keys)
        x = joined(x, level.drop("n")).withColumn("dev", off)
    mad = by_brackets(x, "dev", {"mad": 0.5}, *keys).drop("n")
    return joined(joined(sizes, level.drop("n")), mad).select(*keys, "n", F.col("med").alias("median"), "mad")


def _beyond(n: Column, dev: Column, mad: Column, cut: Column) -> Column:
    """Whether a value is trimmed: of ten values or more, three never are."""
    return (n >= 10) & (dev > cut + 1e-9 * F.greatest(MAD_SCALE * mad, F.lit(1e-12)))


def _robust_windows(x: DataFrame, keys: tuple[str, ...], trim: float) -> DataFrame:
    """robust_stats() of keys and x for cohorts that a task can hold."""
    w = Window.partitionBy(*keys)
    at = lambda c, q: F.percentile(c, F.lit(q)).over(w)
    x = x.withColumns({"n": F.count("*").over(w), "med": at("x", 0.5)})
    if trim > 0:
        x = x.withColumn("dev", F.abs(F.col("x") - F.col("med")))
        x = x.withColumns({"mad": at("dev", 0.5), "cut": at("dev", 1 - trim)})
        x = x.withColumn("x", F.when(~_beyond(F.col("n"), F.col("dev"), F.col("mad"), F.col("cut")), F.col("x")))
        x = x.withColumn("med", at("x", 0.5))
    return x.groupBy(*keys).agg(F.max("n").alias("n"), F.max("med").alias("median"), F.percentile(F.abs(F.col("x") - F.col("med")), F.lit(0.5)).alias("mad"))


def circular_stats(df: DataFrame, angle: str, *keys: str) -> DataFrame:
    """Median direction (angles half a turn on are the same) and median distance from it, in degrees, for each key of any size: keys, angle_median, angle_spread."""
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] or F.lit(True)
    own = df.select(*keys, finite(F.col(angle)).alias("a")).where("a is not null")
    own = settled(own.withColumns({"s": F.sin(2 * F.radians("a")), "c": F.cos(2 * F.radians("a"))}))
    s, c = (exact_quantiles(own, x, {x: 0.5}, *keys) for x in "sc")
    med = settled(s.alias("a").join(c.alias("b"), on("a", "b")).select(*[F.col(f"a.{k}") for k in keys], (F.degrees(F.atan2(F.col("a.s"), F.col("b.c"))) / 2).alias("angle_median")))
    away = F.abs(F.pmod(F.col("a") - F.col("angle_median") + 90.0, F.lit(180.0)) - 90.0)
    dist = own.alias("a").join(med.alias("b"), on("a", "b")).select(*[F.col(f"a.{k}") for k in keys], away.alias("d"))
    spread = exact_quantiles(dist, "d", {"angle_spread": 0.5}, *keys)
    return med.alias("a").join(spread.alias("b"), on("a", "b")).select("a.*", "b.angle_spread")


def mode_sign(x: Column) -> Column:
    """The commoner sign, as 1.0 or -1.0: 1.0 for a tie, 0.0 if all are zero or missing; an aggregate."""
    x = finite(x)
    return F.when(F.count_if(x != 0) == 0, 0.0).when(F.count_if(x > 0) >= F.count_if(x < 0), 1.0).otherwise(-1.0)


def _scored(df: DataFrame, names: list[str] | None) -> tuple[list[str], list[str]]:
    if names is not None and (wrong := sorted(set(names) - BY_NAME.keys())):
        raise MetrologyError("E-ARG-05", ", ".join(wrong))
    have = [f for f in FEATURES if f.name in df.columns and (names is None or f.name in names)]
    return [f.name for f in have if f.kind == "z"], [f.name for f in have if f.kind == "match"]


def cohort_stats(df: DataFrame, *keys: str, features: list[str] | None = None, params: Params = Params()) -> DataFrame:
    """A row for each key and feature: n (all rows of the cohort), median, mad, mode (of match features).

    All features are computed in one pass over an unpivoted frame. A feature without a finite value has null statistics.
    """
    z, match = _scored(df, features)
    keys_ = list(keys)
    size = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    wide = df.select(*keys, *[transformed(c, params).alias(c) for c in z])
    names = size.withColumn("feature", F.explode(F.array(*map(F.lit, z)) if z else F.array().cast("array<string>")))
    out = names.withColumnRenamed("rows", "n")
    if z:
        stats = robust_stats(wide.unpivot(keys_, z, "feature", "value"), "value", *keys, "feature", trim=params.trim_frac).drop("n")
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "feature"]]
        out = out.alias("a").join(stats.alias("b"), on, "left").select("a.*", "b.median", "b.mad")
    else:
        out = out.withColumns({"median": F.lit(None).cast("double"), "mad": F.lit(None).cast("double")})
    out = out.withColumn("mode", F.lit(None).cast("double"))
    for c in match:
        modes = df.groupBy(*keys).agg(F.count("*").alias("n"), mode_sign(F.col(c).cast("double")).alias("mode"))
        out = out.unionByName(modes.select(*keys, F.lit(c).alias("feature"), "n", F.lit(None).cast("double").alias("median"), F.lit(None).cast("double").alias("mad"), "mode"))
    return out


def stats_to_json(stats: DataFrame) -> dict:
    """The statistics of one cohort as a plain dict; a feature is a few numbers, so this is small."""
    rows = stats.collect()
    return {
        "n": rows[0].n if rows else 0,
        "features": {r.feature: {"median": r.median, "mad": r.mad} for r in rows if r.mode is None},
        "modes": {r.feature: r.mode for r in rows if r.mode is not None},
    }


_JSON = "n long, features map<string, struct<median: double, mad: double>>, modes map<string, double>"


def stats_as_json(stats: DataFrame, *keys: str) -> DataFrame:
    """keys, json: the rows of cohort_stats() as one text a cohort (n, features with median and mad, modes), to be kept or sent. A cohort has at most 60 features."""
    entry = lambda value, when: F.map_from_entries(F.sort_array(F.collect_list(F.when(when, F.struct("feature", value.alias("v"))))))
    z = F.col("mode").isNull()
    rows = stats.groupBy(*keys).agg(F.max("n").alias("n"), entry(F.struct("median", "mad"), z).alias("features"), entry(F.col("mode"), ~z).alias("modes"))
    return rows.select(*keys, F.to_json(F.struct("n", "features", "modes"), {"ignoreNullFields": "false"}).alias("json"))


def stats_from_json(texts: DataFrame, *keys: str, column: str = "json") -> DataFrame:
    """The rows of cohort_stats() again: keys, feature, n, median, mad, mode. A text that can't be read raises an error when it is."""
    read = F.from_json(F.col(column), _JSON, {"mode": "FAILFAST"})
    none = F.lit(None).cast("double")
    both = F.concat(
        F.transform(F.map_entries(F.col("_j.features")), lambda e: F.struct(e["key"].alias("feature"), e["value"]["median"].alias("median"), e["value"]["mad"].alias("mad"), none.alias("mode"))),
        F.transform(F.map_entries(F.col("_j.modes")), lambda e: F.struct(e["key"].alias("feature"), none.alias("median"), none.alias("mad"), e["value"].alias("mode"))),
    )
    return texts.select(*keys, read.alias("_j")).select(*keys, F.col("_j.n").alias("n"), F.explode(both).alias("_e")).select(*keys, "_e.feature", "n", "_e.median", "_e.mad", "_e.mode")


def threshold_from_quantile(df: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """The q quantile of the finite values of each key, by exact_quantiles(); keys without one have no row."""
    if not 0 <= q <= 1:
        raise MetrologyError("E-ARG-06", str(q))
    return exact_quantiles(df.withColumn(value, finite(F.col(value))), value, {"threshold": q}, *keys).drop("n")
