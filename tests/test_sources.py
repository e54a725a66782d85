"""Images in files: the codec against its own parts, the data source against what was written, broken files, filters."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.functions import png
from gaugewise.registry import MetrologyError
from gaugewise.sources import images


def file_of(rows, w, h, depth, colour, interlaced=0):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + chunk(b"tEXt", b"note") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_codec(kind):
    r = np.random.default_rng(1)
    top = np.iinfo(kind).max
    ramp = (np.arange(40)[:, None] * 37 + np.arange(61)[None] * 29).astype(kind)
    for image in (ramp, r.integers(0, top, (33, 7)).astype(kind), np.zeros((1, 1), kind), np.full((5, 4), top, kind), np.cumsum(r.integers(0, 3, (50, 50)), axis=1).astype(kind)):
        got = png.decode(png.encode(image))
        assert got.dtype == kind and (got == image).all()


def test_every_filter():
    """Rows filtered byte by byte, as the format says."""
    r = np.random.default_rng(2)
    for step in (1, 2, 3):
        x = r.integers(0, 256, (10, 12 * step)).astype(int)
        rows = b""
        for y in range(10):
            kind, line = y % 5, []
            for k in range(x.shape[1]):
                a, b, c = x[y, k - step] if k >= step else 0, x[y - 1, k] if y else 0, x[y - 1, k - step] if y and k >= step else 0
                p = a + b - c
                guess = (0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v)))[kind]
                line.append((x[y, k] - guess) % 256)
            rows += bytes([kind, *line])
        got = png._unfiltered(np.frombuffer(rows, np.uint8).reshape(10, -1), step)
        assert (got == x).all()


def test_other_kinds_of_pixels():
    bits = file_of(b"\0\xa0\0\x40", 3, 2, 1, 0)
    assert png.decode(bits).tolist() == [[255, 0, 255], [0, 255, 0]]
    colours = file_of(bytes([0, 255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9]), 4, 1, 8, 2)
    assert png.decode(colours).tolist() == [[76, 150, 29, 9]]
    alpha = file_of(bytes([0, 7, 255, 8, 0]), 2, 1, 8, 4)
    assert png.decode(alpha).tolist() == [[7, 8]]


BROKEN = {
    "text": b"hello", "empty": b"", "cut": png.encode(np.zeros((9, 9), np.uint8))[:-20], "crc": png.encode(np.zeros((9, 9), np.uint8)).replace(b"IDAT", b"IDAX"),
    "interlaced": file_of(b"\0\0", 1, 1, 8, 0, 1), "palette": file_of(b"\0\0", 1, 1, 8, 3), "short": file_of(b"\0\0", 2, 2, 8, 0), "filter": file_of(b"\x09\0", 1, 1, 8, 0),
}


def test_source(spark, tmp_path):
    r = np.random.default_rng(3)
    kept = {f"im/{k} ü%": r.integers(0, 65536 if k % 2 else 256, (3 + k, 5)).astype(np.uint16 if k % 2 else np.uint8) for k in range(12)}
    rows = [(name, x.shape[0], x.shape[1], 8 * x.itemsize, x.tobytes(), "extra") for name, x in kept.items()]
    df = spark.createDataFrame(rows, "image_id string, h int, w int, depth int, pixels binary, reason string").repartition(3)
    folder = str(tmp_path / "out")
    images.save_images(df, folder)
    images.save_images(df.where("false"), str(tmp_path / "none"))
    for name, data in BROKEN.items():
        (tmp_path / "out" / f"{name}.png").write_bytes(data)
    (tmp_path / "out" / "other.txt").write_bytes(b"no image")
    read = spark.read.format("grey_png").option("partitionBytes", 400).load(folder)
    for got, broken in ((read, {*BROKEN}), (images.load_images(spark, folder), BROKEN.keys() - {"empty"})):
        found = {x.image_id: x for x in got.collect()}
        assert found.keys() == kept.keys() | broken
        for name, x in kept.items():
            g = found[name]
            assert (g.h, g.w, g.depth, bytes(g.pixels), g.reason) == (*x.shape, 8 * x.itemsize, x.tobytes(), None)
        assert all(found[n].pixels is None and found[n].h is None and found[n].reason for n in broken)
    assert 1 < read.rdd.getNumPartitions() <= 20
    assert spark.read.format("grey_png").load(str(tmp_path / "none")).count() == 0 and images.load_images(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(MetrologyError, match="E-ARG-01"):
        images.save_images(df.union(df), str(tmp_path / "twice"))
    with pytest.raises(Exception, match="E-ARG-02"):
        images.save_images(df.withColumn("h", F.lit(99)), str(tmp_path / "odd"))


def test_one_frame_many_queries(spark, tmp_path):
    """Filters are right whatever was asked of the same frame before; files left out by name are not opened."""
    images.register(spark)
    for k in range(6):
        (tmp_path / f"a{k}.png").write_bytes(png.encode(np.full((2, 2), k, np.uint8)))
    read = spark.read.format("grey_png").option("partitionBytes", 1).load(str(tmp_path))
    assert [r.image_id for r in read.where("image_id = 'a3'").collect()] == ["a3"] and read.count() == 6 and read.where("image_id IN ('a1', 'a2', 'b') AND h = 2").count() == 2
    assert read.rdd.getNumPartitions() == 6 and read.where("h = 3").count() == 0
    some = spark.read.format("grey_png").option("partitionBytes", 1).option("pathGlobFilter", "a[34].png").load(str(tmp_path))
    assert some.rdd.getNumPartitions() == 2 and {r.image_id for r in some.collect()} == {"a3", "a4"}


def test_bits(spark):
    deep = (np.arange(256, dtype=np.uint16) * 257).reshape(16, 16)
    rows = [(1, 16, 16, 16, deep.tobytes()), (2, 2, 2, 8, b"\1\2\3\4"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "image_id int, h int, w int, depth int, pixels binary")
    got = {r.image_id: r.pixels for r in images.as_uint8(df, "shift").collect()}
    assert bytes(got[1]) == bytes(range(256)) and bytes(got[2]) == b"\1\2\3\4" and got[3] is None
    assert max({r.image_id: r.pixels for r in images.as_uint8(df).collect()}[1]) == 255
    with pytest.raises(MetrologyError, match="E-ARG-06"):
        images.as_uint8(df, "none")


def test_dataset(spark, tmp_path):
    """Measurements, images and masks written and read again; sound rows give features, the others are told."""
    from gaugewise.operators import pyramid

    r = np.random.default_rng(5)
    make = spark.createDataFrame
    kept = {f"a/{k}_1": r.integers(0, 256, (40, 50)).astype(np.uint8) for k in range(3)}
    bits = {(i, c): (r.random((40, 50)) < 0.4).astype(np.uint8) for i in kept for c in ("A_1", "B")}
    rows = [(i, c, k, *r.uniform(8, 32, 4).tolist(), 5.0, "Å" if k % 2 else "nm", 0.5) for i in kept for c in ("A_1", "B") for k in range(8)]
    rows += [("x", "A_1", 0, None, 1.0, 2.0, 3.0, 5.0, "nm", 0.5), ("x", "A_1", 1, 1.0, 1.0, 2.0, 3.0, 5.0, "px", 0.5), ("x", "A_1", 2, 1.0, 1.0, 2.0, 3.0, 5.0, "nm", -1.0), ("x", "A_1", 3, None, None, None, None, 5.0, "nm", 0.5)]
    schema = "image_id string, category_id string, cd_index long, sx double, sy double, ex double, ey double, value double, unit string, px_nm double"
    images_ = make([(i, *x.shape, x.tobytes()) for i, x in kept.items()], "image_id string, h int, w int, pixels binary")
    masks = make([(i, c, *x.shape, x.tobytes()) for (i, c), x in bits.items()], "image_id string, category_id string, h int, w int, bits binary")
    path = str(tmp_path / "set")
    images.save_dataset(path, make(rows, schema), images_, masks)
    records, back, back_masks = images.load_dataset(spark, path, schema)
    assert {r.image_id: bytes(r.pixels) for r in back.collect()} == {i: x.tobytes() for i, x in kept.items()}
    assert {(r.image_id, r.category_id): bytes(r.bits) for r in back_masks.collect()} == {k: (x * 255).astype(np.uint8).tobytes() for k, x in bits.items()}
    assert sorted(map(str, (tuple(r) for r in records.collect()))) == sorted(map(str, rows))
    l3, found = pyramid.extract_l3_checked(records, back, back_masks, value="value", unit="unit")
    want = pyramid.extract_l3(make(rows[:48], schema).withColumn("v", F.expr("if(unit = 'nm', value, value * 0.1)")), images_, masks, value_nm="v")
    assert found.counts == {"ok": 48, "E-ARG-01": 1, "E-ARG-03": 1, "E-ARG-04": 1, "E-ARG-06": 1} and found.details("E-ARG-03") == ["px"]
    show = lambda df: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())
    assert l3.columns == want.columns and show(l3) == show(want)
    with pytest.raises(MetrologyError, match="E-ARG-06"):
        images.save_dataset(str(tmp_path / "bad"), records, back, back_masks.withColumn("category_id", F.lit("a/b")))
