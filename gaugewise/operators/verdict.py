"""Verdicts on sequences and images: impact of flagged rows, runs of flags, histogram distance, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.operators.convert import finite
from gaugewise.operators.sequence import Sequence
from gaugewise.registry import MetrologyError


def impact_nm(df: DataFrame, cd: str, flag: str, *keys: str, stat: str = "median", trimmed: float = 0.1) -> DataFrame:
    """How far the statistic of each key's lengths moves when flagged rows are left out: 0 without flags, infinite if nothing is left.

    stat: median, mean, or trimmed_mean (the mean within the quantiles at trimmed and 1 - trimmed, of either set by itself).
    """
    if stat not in ("median", "mean", "trimmed_mean"):
        raise MetrologyError("E-ARG-06", stat)
    flagged = F.coalesce(F.col(flag), F.lit(False))
    df = df.select(*keys, finite(F.col(cd)).alias("_x"), flagged.alias("_f"))
    df = df.withColumn("_clean", F.when(~F.col("_f"), F.col("_x")))
    if stat == "trimmed_mean":
        w = Window.partitionBy(*keys)
        for c in ("_x", "_clean"):
            df = df.withColumn("_q", F.percentile(c, F.array(F.lit(trimmed), F.lit(1 - trimmed))).over(w))
            inside = F.col(c).between(F.col("_q")[0] - 1e-9, F.col("_q")[1] + 1e-9)
            df = df.withColumn(f"{c}_in", F.when(inside, F.col(c))).drop("_q")
        both = [F.coalesce(F.avg(f"{c}_in"), F.avg(c)) for c in ("_x", "_clean")]
    else:
        f = F.median if stat == "median" else F.avg
        both = [f("_x"), f("_clean")]
    value = F.when(F.count_if("_f") == 0, 0.0).when(F.count("_clean") == 0, float("inf")).otherwise(F.abs(both[0] - both[1]))
    return df.groupBy(*keys).agg(value.alias("impact_nm"))


def max_run(df: DataFrame, flag: str, seq: Sequence = Sequence()) -> DataFrame:
    """The longest run of flagged rows of each sequence."""
    w = seq.window
    flagged = F.coalesce(F.col(flag), F.lit(False))
    df = df.select(*seq.keys, seq.order, flagged.alias("_f"))
    df = df.withColumn("_island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy(*seq.keys, "_island").agg(F.count_if("_f").alias("_n"))
    return runs.groupBy(*seq.keys).agg(F.max("_n").alias("max_run"))


def histogram(df: DataFrame, value: str, *image: str) -> DataFrame:
    """Share of each value among an image's pixels: image keys, bin, share; values that do not occur have no row."""
    counts = df.groupBy(*image, F.col(value).alias("bin")).agg(F.count("*").alias("n"))
    return counts.select(*image, "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(*image))).alias("share"))


def template(hist: DataFrame, *image: str) -> DataFrame:
    """The median share of each bin over all images, made to sum to one; bins that an image lacks count as 0.

    Equal shares of a bin are counted first, so what is put in order is the distinct shares: no more than an image has
    pixels, however many images there are.
    """
    images = hist.select(*image).distinct().agg(F.count("*").alias("_images"))
    each = hist.groupBy("bin", "share").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("bin")
    each = each.withColumns({"_all": F.sum("_c").over(w), "_upto": F.sum("_c").over(w.orderBy("share"))}).crossJoin(F.broadcast(images))  # one row
    upto = F.col("_images") - F.col("_all") + F.col("_upto")
    at = lambda r: F.coalesce(F.max(F.when((upto > r) & (upto - F.col("_c") <= r), F.col("share"))), F.lit(0.0))
    out = each.groupBy("bin").agg(((at(F.floor((F.col("_images") - 1) / 2)) + at(F.floor(F.col("_images") / 2))) / 2).alias("share")).where("share > 0")
    return out.select("bin", (F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(0)))).alias("share"))  # a row a bin


def hist_emd(hist: DataFrame, target: DataFrame, *image: str, bins: int = 256) -> DataFrame:
    """Sum of absolute cumulative differences between each image's histogram and a template, in bins."""
    both = hist.select(*image, "bin", "share").unionByName(hist.select(*image).distinct().crossJoin(F.broadcast(target.select("bin", (-F.col("share")).alias("share")))))
    both = both.groupBy(*image, "bin").agg(F.sum("share").alias("d"))
    w = Window.partitionBy(*image).orderBy("bin")
    both = both.withColumns({"c": F.sum("d").over(w), "next": F.coalesce(F.lead("bin").over(w), F.lit(bins))})
    return both.groupBy(*image).agg(F.sum(F.abs("c") * (F.col("next") - F.col("bin"))).alias("hist_emd"))


def hist_distance(h: Column, t: Column) -> Column:
    """The same distance between two arrays of shares in a row."""
    step = lambda acc, d: F.struct((acc["c"] + d).alias("c"), (acc["s"] + F.abs(acc["c"] + d)).alias("s"))
    return F.aggregate(F.zip_with(h, t, lambda a, b: a - b), F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), step, lambda acc: acc["s"])


def gates(sequences: DataFrame, images: DataFrame, image: str, image_z: list[str], sequence_z: list[str], z_limit: float, tolerance_nm: float) -> DataFrame:
    """Adds g0 (a score of the image is over its limit), g1 (impact over the tolerance), g2 (a score of the sequence is over), verdict."""
    over = lambda cols: F.coalesce(F.greatest(*[F.col(c) for c in cols], F.lit(float("-inf"))) > z_limit, F.lit(False))
    named = images.select(F.col(image).alias("_image"), over(image_z).alias("g0"))
    out = sequences.join(named, F.col(image) == F.col("_image"), "left").drop("_image")
    out = out.withColumns({"g0": F.coalesce("g0", F.lit(False)), "g1": F.coalesce(F.col("impact_nm") > tolerance_nm, F.lit(False)), "g2": over(sequence_z)})
    return out.withColumn("verdict", F.when(F.col("g0"), "image").when(F.col("g1"), "impact").when(F.col("g2"), "sequence").otherwise("pass"))
