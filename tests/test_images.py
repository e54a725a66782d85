"""Kernels on images whose answers are known, and the operators that carry them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.functions import kernels as K
from gaugewise.operators import image, pyramid
from gaugewise.registry import FEATURES, MetrologyError, Params


def band(shift=0.0, rise=1.5, contrast=60.0, noise=3.0):
    x = np.arange(200)
    step = lambda e: np.array([math.erf((v - e) / (rise * math.sqrt(2))) for v in x])
    row = 80 + contrast / 2 * (step(80 + shift) - step(130))
    return np.clip(row[None] + np.random.default_rng(0).normal(0, noise, (200, 200)), 0, 255).astype(np.uint8)


def segments():
    y = np.linspace(30, 170, 10)
    s, e = np.stack((np.full(10, 80.0), y), 1), np.stack((np.full(10, 130.0), y), 1)
    return s, e, np.tile((0.0, 1.0), (10, 1)), np.full(10, 0.5)


def med(found, name):
    return float(np.nanmedian(found[name]))


def test_evidence_of_a_band():
    found = K.evidence(band(), *segments())
    assert abs(med(found, "delta_s")) < 0.15 and abs(med(found, "delta_e")) < 0.15
    assert found["edge_valid_s"].all() and (found["pol_s"] == 1).all() and (found["pol_e"] == -1).all()
    assert K.evidence(band(shift=2), *segments())["delta_s"].mean() == pytest.approx(1.0, abs=0.2)
    assert med(K.evidence(band(rise=4), *segments()), "rise_s") > 1.5 * med(found, "rise_s")
    assert med(K.evidence(band(contrast=20), *segments()), "cnr_s") < 0.6 * med(found, "cnr_s")
    assert med(found, "plateau_cv") < 0.05


def test_short_segments_have_no_evidence():
    s, e, t, px = segments()
    s[0, 0] = np.nan
    found = K.evidence(band(), s, e, t, px)
    assert math.isnan(found["delta_s"][0]) and not found["edge_valid_s"][0]


def rectangle():
    m = np.zeros((100, 100), bool)
    m[10:90, 30:61] = True
    return m


def test_mask_distances():
    s, e = np.array([[30.0, 50.0], [33.0, 50.0], [25.0, 50.0]]), np.array([[60.0, 50.0]] * 3)
    found = K.mask_evidence(rectangle(), np.full((100, 100), 128, np.uint8), s, e, np.full(3, 0.5))
    assert found["mdist_s"].tolist() == [0.0, 1.5, 2.5] and found["mdist_e"].tolist() == [0.0] * 3 and found["minside"].all()
    none = K.mask_evidence(np.zeros((100, 100), bool), np.full((100, 100), 128, np.uint8), s, e, np.full(3, 0.5))
    assert np.isnan(none["mdist_s"]).all() and not none["minside"].any()


def test_mask_shapes():
    flat, m = np.full((100, 100), 128, np.uint8), rectangle()
    whole = K.mask_features(m, flat)
    assert whole["mask_n_components"] == 1 and whole["mask_hole_frac"] == 0 and whole["mask_area_frac"] == pytest.approx(0.248)
    m[40:44, 40:44] = False
    m[2, 2] = m[95, 95] = True
    torn = K.mask_features(m, flat)
    assert torn["mask_n_components"] == 3 and torn["mask_hole_frac"] == pytest.approx(16 / 2482)
    empty = K.mask_features(np.zeros((9, 9), bool), flat[:9, :9])
    assert empty["mask_n_components"] == 0 and math.isnan(empty["mask_hole_frac"])


def test_components_by_flood_fill():
    rng = np.random.default_rng(1)
    for diagonal in (True, False):
        m = rng.random((23, 31)) < 0.45
        got, seen = K.components(m, diagonal), np.zeros(m.shape, int)
        n = 0
        for y, x in np.argwhere(m):
            if seen[y, x]:
                continue
            n += 1
            stack = [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 23 and 0 <= b < 31 and m[a, b] and not seen[a, b]:
                    seen[a, b] = n
                    stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not i or not j]
        assert len(set(zip(got[m], seen[m]))) == n == got.max()


def test_to_uint8():
    ramp = np.arange(256, dtype=np.uint16)[None] * 257
    assert (K.to_uint8(ramp, "shift")[0] == np.arange(256)).all()
    assert K.to_uint8(np.full((4, 4), 3.0)).max() == 0 and K.to_uint8(np.linspace(100, 900, 400).reshape(20, 20)).max() == 255
    same = np.zeros((2, 2), np.uint8)
    assert K.to_uint8(same) is same
    with pytest.raises(ValueError, match="E-ARG-06"):
        K.to_uint8(ramp, "none")


def test_operators_on_known_images(spark):
    s, e, _, _ = segments()
    found = [(k, 200, 200, band(shift=shift).tobytes()) for k, shift in (("a", 0.0), ("b", 2.0))]
    images = spark.createDataFrame(found, "image_id string, h int, w int, pixels binary")
    mask = np.zeros((200, 200), np.uint8)
    mask[:, 80:131] = 1
    masks = spark.createDataFrame([("a", 0, 200, 200, mask.tobytes()), ("b", 0, 200, 200, np.roll(mask, 4, axis=1).tobytes())], "image_id string, category_id int, h int, w int, bits binary")
    rows = [(k, 0, i, *map(float, (*p, *q)), 0.5, 25.0) for k in "abc" for i, (p, q) in enumerate(zip(s, e))]
    segs = spark.createDataFrame(rows, "image_id string, category_id int, cd_index long, sx double, sy double, ex double, ey double, px_nm double, value_nm double")
    l3 = pyramid.extract_l3(segs, images, masks, value_nm="value_nm")
    got = {r.image_id: r for r in l3.groupBy("image_id").agg(*[F.median(c).alias(c) for c in ("delta_s", "mdist_s", "cd_nm", "value_mismatch_nm")], F.count("*").alias("n")).collect()}
    assert {k: r.n for k, r in got.items()} == {"a": 10, "b": 10, "c": 10}
    assert abs(got["a"].delta_s) < 0.15 and got["b"].delta_s == pytest.approx(1.0, abs=0.2) and got["c"].delta_s is None
    assert got["a"].mdist_s == 0 and got["b"].mdist_s == 2.0 and got["a"].cd_nm == 25.0 and got["a"].value_mismatch_nm == 0
    order = [f.name for f in FEATURES if f.name in l3.columns]
    assert l3.columns == [*pyramid.KEYS, *order, "mid_x", "mid_y", "px_nm"] and {"delta_s", "mgrad_e", "minside", "obliquity"} <= set(order)
    alone = pyramid.extract_l3(segs)
    assert alone.where("edge_valid_s or delta_s is not null").count() == 0 and alone.count() == 30
    with pytest.raises(Exception, match="E-ARG-06"):
        pyramid.extract_l3(segs.withColumn("px_nm", F.lit(0.0))).collect()
    assert image.mask_features(masks, images).where("mask_n_components = 1").count() == 2
    best = image.convention_scores(segs, images.where("image_id = 'a'")).first()
    assert (best.convention, best.y_flip, best.origin) == ("xy", False, "zero") and best.median_dist_px < 0.75
    swapped = segs.selectExpr("image_id", "sy + 1 sx", "sx + 1 sy", "ey + 1 ex", "ex + 1 ey")
    assert image.convention_scores(swapped, images.where("image_id = 'a'")).first().convention == "rowcol"


def test_wrong_image(spark):
    with pytest.raises(MetrologyError, match="E-ARG-02"):
        image.as_image({"h": 2, "w": 2, "pixels": b"abc"})
    assert Params().worse_when("cnr_s") == "low" and Params(direction_overrides={"cnr_s": "both"}).worse_when("cnr_s") == "both"


def test_nearest_true_by_brute_force():
    """Distances and places on shapes with many ties, whole columns, single pixels and lines."""
    r = np.random.default_rng(0)
    for k in range(200):
        h, w = r.integers(1, 14, 2)
        m = r.random((h, w)) < r.choice([0.03, 0.2, 0.6])
        m[:, r.integers(0, w)] |= k % 3 == 0
        m[r.integers(h), r.integers(w)] = True
        squared, place = K.nearest_true(m)
        at = np.argwhere(m)
        d = ((at[None, None] - np.stack(np.mgrid[:h, :w], -1)[:, :, None]) ** 2).sum(3)
        first = at[d.argmin(2)]
        assert (squared == d.min(2)).all() and (place == first[..., 0] * w + first[..., 1]).all()


def many(spark, n=5, masks=3):
    r = np.random.default_rng(4)
    pixels = [(k, 40, 50, r.integers(0, 255, (40, 50)).astype(np.uint8).tobytes()) for k in range(n)]
    bits = [(k, c, 40, 50, (r.random((40, 50)) < 0.1 + 0.2 * c).astype(np.uint8).tobytes()) for k in range(n + 1) for c in range(masks)]
    rows = [(k, c, i, *r.uniform(5, 35, 4).tolist(), 0.5, 0.0, 1.0, "note") for k in range(n + 2) for c in range(masks + 1) for i in range(30)]
    make = spark.createDataFrame
    return (
        make(pixels, "image_id int, h int, w int, pixels binary").repartition(3), make(bits, "image_id int, category_id int, h int, w int, bits binary").repartition(3),
        make(rows, "image_id int, category_id int, cd_index long, sx double, sy double, ex double, ey double, px_nm double, ribbon_tx double, ribbon_ty double, h string").repartition(3),
    )


def test_tagged_rows_one_by_one(spark):
    """Every segment against kernels called directly; batches of a few rows; images, masks or both that are not there; clashing columns."""
    images, masks, segs = many(spark)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = image.segment_evidence(segs, images.union(images), masks).collect()
        features = image.mask_features(masks, images).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    pixels = {r.image_id: image.as_image(r.asDict()) for r in images.collect()}
    bits = {(r.image_id, r.category_id): image.as_image(r.asDict(), "bits") != 0 for r in masks.collect()}
    assert len(got) == segs.count() and {r.h for r in got} == {"note"}
    same = lambda a, b: a == b or (a is None and np.isnan(b)) or (a is not None and a == pytest.approx(b))
    for r in got:
        s, e, t, px = np.array([[r.sx, r.sy]]), np.array([[r.ex, r.ey]]), np.array([[0.0, 1.0]]), np.array([0.5])
        if r.image_id in pixels:
            want = K.evidence(pixels[r.image_id], s, e, t, px)
            assert all(same(r[c], want[c][0]) for c in K.EVIDENCE)
        else:
            assert r.delta_s is None and r.edge_valid_s is False
        if r.image_id in pixels and (r.image_id, r.category_id) in bits:
            want = K.mask_evidence(bits[r.image_id, r.category_id], pixels[r.image_id], s, e, px)
            assert all(same(r[c], want[c][0]) for c in K.MASK_L3)
        else:
            assert all(r[c] is None for c in K.MASK_L3)
    assert {(r.image_id, r.category_id) for r in features} == {k for k in bits if k[0] in pixels}
    assert image.segment_evidence(segs.where("false"), images, masks).count() == 0 and image.segment_evidence(segs, images.where("false"), masks.where("false")).where("delta_s is not null").count() == 0


def test_one_exchange_of_pixels(spark):
    images, masks, segs = many(spark, 2)
    for df in (image.segment_evidence(segs, images, masks), image.mask_features(masks, images), pyramid.extract_l3(segs.drop("h"), images, masks)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(_image") == 1 and "Join" not in plan
    with pytest.raises(Exception, match="E-ARG-07"):
        image.mask_features(masks.withColumns({"h": F.lit(50), "w": F.lit(40)}), images).collect()


@pytest.fixture
def small_partitions(spark):
    """Only partitions under 20 kB are joined to others, as on large tables only small ones are."""
    held = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20kb", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_masks_meet_images_grouped_alike(spark, small_partitions):
    """Images and masks that are both grouped by image, one side much smaller than the other, stay together."""
    r = np.random.default_rng(6)
    first = lambda df: df.groupBy("image_id").agg(*[F.first(c).alias(c) for c in df.columns[1:]])
    images = spark.createDataFrame([(k, 40, 50, r.integers(0, 255, 2000).astype(np.uint8).tobytes()) for k in range(200)], "image_id int, h int, w int, pixels binary")
    masks = spark.createDataFrame([(k, 0, 40, 50, b"\1" * 2000) for k in range(200)], "image_id int, category_id int, h int, w int, bits binary")
    assert sorted(x.image_id for x in image.mask_features(first(masks), first(images)).where("mask_area_frac = 1").collect()) == list(range(200))


def test_segments_meet_masks_grouped_alike(spark, small_partitions):
    """Segments made from the images' ids stay with the much larger images and their masks."""
    r = np.random.default_rng(7)
    first = lambda df: df.groupBy("image_id").agg(*[F.first(c).alias(c) for c in df.columns[1:]])
    images = first(spark.createDataFrame([(k, 40, 50, r.integers(0, 255, 2000).astype(np.uint8).tobytes()) for k in range(200)], "image_id int, h int, w int, pixels binary"))
    masks = images.select("image_id", F.lit(0).alias("category_id"), "h", "w", F.col("pixels").alias("bits"))
    at = {"cd_index": 0, "sx": 5.0, "sy": 5.0, "ex": 30.0, "ey": 5.0, "px_nm": 0.5}
    segs = images.select("image_id", F.lit(0).alias("category_id"), *[F.lit(v).alias(k) for k, v in at.items()])
    assert sorted(x.image_id for x in image.mask_evidence(segs, masks, images).collect()) == list(range(200))
