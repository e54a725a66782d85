"""Labels of tiled masks against labels of whole ones: spirals, combs, noise, tiles of one pixel, masks that are not there."""

import numpy as np
import pytest

from gaugewise.functions import kernels as K
from gaugewise.operators import tiles


def spiral(n=41):
    m, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    step = n - 1
    m[0, 0] = True
    for k in range(2 * n):
        for _ in range(step):
            y, x = y + dy, x + dx
            m[y, x] = True
        dy, dx = dx, -dy
        if k % 2 == 0 and k:
            step -= 2
        if step < 2:
            break
    return m


def comb():
    m = np.zeros((30, 50), bool)
    m[:, ::2] = True
    m[-1] = True
    return m


def shapes():
    r = np.random.default_rng(3)
    blank = np.zeros((7, 9), bool)
    ring = np.zeros((20, 20), bool)
    ring[3:17, 3:17] = True
    ring[6:14, 6:14] = False
    ring[9:11, 9:11] = True
    diagonal = np.eye(16, dtype=bool)
    return {"spiral": spiral(), "comb": comb(), "blank": blank, "full": ~blank, "ring": ring, "diagonal": diagonal, "other": diagonal[:, ::-1], **{f"noise{k}": r.random((23, 37)) < d for k, d in enumerate((0.3, 0.45, 0.6))}}


def frame(spark, which):
    rows = [(name, k, *m.shape, m.astype(np.uint8).tobytes()) for k, (name, m) in enumerate(which.items())]
    return spark.createDataFrame(rows, "image_id string, category_id int, h int, w int, bits binary").repartition(3)


@pytest.mark.parametrize("size,diagonal", [(8, True), (5, False)])
def test_components_across_tiles(spark, size, diagonal):
    which = shapes()
    cut = tiles.cut(frame(spark, which), size)
    assert cut.count() == sum(-(-m.shape[0] // size) * -(-m.shape[1] // size) for m in which.values())
    got = tiles.components(cut, diagonal).collect()
    for name, m in which.items():
        label = K.components(m, diagonal)
        assert sorted(r.area for r in got if r.image_id == name) == sorted(np.bincount(label.ravel())[1:].tolist()), name
        border = np.zeros(m.shape, bool)
        border[[0, -1]] = border[:, [0, -1]] = True
        assert sum(r.outside for r in got if r.image_id == name) == len(set(label[border & m].tolist())), name


def test_labels_of_pixels(spark):
    which = {k: v for k, v in shapes().items() if k in ("spiral", "comb", "noise1", "blank")}
    got = tiles.labels(tiles.cut(frame(spark, which), 8)).collect()
    for name, m in which.items():
        whole = np.zeros(m.shape, np.int64)
        for r in got:
            if r.image_id == name:
                whole[8 * r.ty : 8 * r.ty + r.h, 8 * r.tx : 8 * r.tx + r.w] = np.frombuffer(r.labels, np.int64).reshape(r.h, r.w)
        want = K.components(m)
        assert ((whole > 0) == m).all() and len(set(zip(whole[m], want[m]))) == want.max() == len(set(whole[m]))


def test_features_of_tiles(spark):
    which = shapes()
    got = {r.image_id: r for r in tiles.tile_features(tiles.cut(frame(spark, which), 6)).collect()}
    for name, m in which.items():
        want = K.mask_features(m, np.full(m.shape, 9, np.uint8))
        r = got[name]
        assert r.mask_n_components == want["mask_n_components"] and r.mask_area_frac == pytest.approx(want["mask_area_frac"])
        assert r.mask_hole_frac is None if np.isnan(want["mask_hole_frac"]) else r.mask_hole_frac == pytest.approx(want["mask_hole_frac"])
    nothing = tiles.cut(frame(spark, which).where("false"))
    assert tiles.tile_features(nothing).count() == 0 and tiles.labels(nothing).count() == 0
