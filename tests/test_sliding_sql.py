"""Sliding medians against windows; the library's functions in SQL against those of DataFrames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.functions import sql
from gaugewise.operators import convert, image, sequence, sliding
from gaugewise.operators.sequence import Sequence
from gaugewise.registry import Params


def table(spark, n=400):
    r = random.Random(5)
    value = lambda: r.choice([r.gauss(0, 1), float(r.randint(0, 3)), float("nan"), float("inf"), None])
    sizes = {("a", 1): n, ("a", 2): 3, ("b", None): 60, (None, 1): 1, ("c", 1): 25}
    rows = [(i, c, k, value(), r.random() * 9, r.random() * 9, "x") for (i, c), size in sizes.items() for k in range(size)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "image_id string, category_id int, cd_index long, v double, sx double, sy double, _v1 string").repartition(3)


def same(a, b):
    return (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-12))


@pytest.mark.parametrize("half,batch", [(0, 100), (4, 7), (30, 1), (250, 64)])
def test_sliding_medians(spark, half, batch):
    df = table(spark)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = sliding.sliding_medians(df, {"m": "v", "n": "sx"}, half).collect()
        short = sliding.sliding_medians(df, {"m": "v"}, half, least=26).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    groups = {}
    for r in df.collect():
        groups.setdefault((r.image_id, r.category_id), {})[r.cd_index] = r
    want = {}
    for key, of in groups.items():
        for k in of:
            around = [of[j] for j in range(max(k - half, 0), min(k + half + 1, len(of)))]
            v = [x.v for x in around if x.v is not None and np.isfinite(x.v)]
            want[(*key, k)] = (float(np.median(v)) if v else None, float(np.median([x.sx for x in around])))
    assert len(got) == len(want) and all(same(r.m, want[r.image_id, r.category_id, r.cd_index][0]) and same(r.n, want[r.image_id, r.category_id, r.cd_index][1]) for r in got)
    assert all(same(r.m, want[r.image_id, r.category_id, r.cd_index][0] if len(groups[r.image_id, r.category_id]) >= 26 else None) for r in short)
    assert got[0].asDict().keys() == {*df.columns, "m", "n"}


def test_sliding_features(spark):
    """Residuals and robust tangents by sliding frames are those by windows, also for frames of 501 rows."""
    df = table(spark).where("category_id is not null and image_id is not null")
    for window in (9, 501):
        p = Params(method="hampel", local_window=window)
        a = {(r.image_id, r.category_id, r.cd_index): r.x for r in sequence.local_residual(df, "v", "x", p).collect()}
        b = {(r.image_id, r.category_id, r.cd_index): r.x for r in sliding.local_residual(df, "v", "x", p).collect()}
        assert a.keys() == b.keys() and all(same(b[k], v) for k, v in a.items())
    w = Sequence().rows(3)
    t = sequence.unit_tangents(df, "sx", "sy", "tx", "ty").withColumns({c: F.percentile(t, F.lit(0.5)).over(w) for c, t in (("mx", "tx"), ("my", "ty"))}).withColumn("n", F.count("*").over(Sequence().whole))
    want = {(r.image_id, r.category_id, r.cd_index): (r.tx, r.ty) if r.n < 3 else (r.mx / (np.hypot(r.mx, r.my) or 1), r.my / (np.hypot(r.mx, r.my) or 1)) for r in t.collect()}
    got = {(r.image_id, r.category_id, r.cd_index): (r.tx, r.ty) for r in sliding.robust_tangents(df, "sx", "sy", "tx", "ty").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert sliding.sliding_medians(df.where("false"), {"m": "v"}, 3).collect() == []


def test_scalar_functions_in_sql(spark):
    sql.register(spark)
    units = ["Å", "Å", " nm", "㎚", "　ＮＭ", "Å", "𝐧m", "px", "", "a'b", None]
    rows = [(u, float(i), 1.5 * i, 2.0, -3.0, 7.0 * i) for i, u in enumerate(units)]
    df = spark.createDataFrame(rows, "u string, v double, sx double, sy double, ex double, ey double")
    df.createOrReplaceTempView("sql_rows")
    got = spark.sql("SELECT u, normalize_unit(u) AS n, length_px(sx, sy, ex, ey) AS l, segment_angle(sx, sy, ex, ey) AS a, circular_distance(v * 50, 20) AS c, finite(v / 0.5) AS f FROM sql_rows").collect()
    want = df.select("u", convert.normalize_unit(F.col("u")).alias("n"), convert.length_px().alias("l"), sequence.segment_angle().alias("a"), sequence.circular_distance(F.col("v") * 50, F.lit(20.0)).alias("c"), convert.finite(F.col("v") / 0.5).alias("f")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and [r.n for r in got][:7] == ["angstrom", "angstrom", "nm", "nm", "nm", "angstrom", "nm"]
    assert spark.sql("SELECT sum(to_nm(v, u)) AS s FROM sql_rows WHERE normalize_unit(u) IS NOT NULL").first().s == pytest.approx(0.1 * (0 + 1 + 5) + 2 + 3 + 4 + 6)
    assert spark.sql("SELECT finite(double('nan')) IS NULL AND finite(double('-infinity')) IS NULL AS x").first().x
    with pytest.raises(Exception, match="E-ARG-03"):
        spark.sql("SELECT to_nm(v, u) FROM sql_rows").collect()


def test_table_function(spark):
    sql.register(spark)
    r = np.random.default_rng(1)
    images = spark.createDataFrame([(k, 40, 50, r.integers(0, 255, (40, 50)).astype(np.uint8).tobytes()) for k in range(3)], "image_id int, h int, w int, pixels binary")
    segs = spark.createDataFrame([(k, *r.uniform(8, 30, 4).tolist()) for k in range(4) for _ in range(12)] + [(0, None, 1.0, 2.0, 3.0)], "image_id int, sx double, sy double, ex double, ey double")
    sql.image_rows(segs.where("sx is not null"), images).repartition(4).createOrReplaceTempView("sql_images")
    got = spark.sql("SELECT convention, y_flip, origin, median(dist) AS m FROM convention_offsets(TABLE(sql_images) PARTITION BY image_id) GROUP BY 1, 2, 3").collect()
    want = {(x.convention, x.y_flip, x.origin): x.median_dist_px for x in image.convention_scores(segs.where("sx is not null"), images).collect()}
    assert {(x.convention, x.y_flip, x.origin): x.m for x in got} == {k: pytest.approx(v) for k, v in want.items()}
    half = spark.sql("SELECT count(*) AS n, count(DISTINCT image_id) AS k FROM convention_offsets(TABLE(sql_images) PARTITION BY (image_id), 0.5)").first()
    assert (half.n, half.k) == (3 * 12 * 2 * 8, 3)
    with pytest.raises(Exception, match="E-ARG-06"):
        spark.sql("SELECT * FROM convention_offsets(TABLE(SELECT 1 AS image_id) PARTITION BY image_id)").collect()
