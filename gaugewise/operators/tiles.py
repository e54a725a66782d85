"""Masks larger than a task, as rows of tiles: components are labelled within tiles and united along the seams between them.

A tile is a row (image_id, category_id, ty, tx, y0, x0, h, w, bits) and, for holes, the size of its mask (mask_h,
mask_w). A task labels one tile at a time. What touches across a seam is a pair of labels, found where the two strips
of a seam meet; the pairs' closure gives each label the least label of its component. Nothing holds a whole mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gaugewise.functions import kernels
from gaugewise.operators.image import as_image
from gaugewise.registry import MetrologyError
from gaugewise.sources.tables import settled

KEYS = ["image_id", "category_id"]
#: A label's name is its tile's row, column and its number within the tile, in so many bits each from the right.
COLUMN_BITS, LABEL_BITS = 20, 24
#: Rows that a strip adds: which seam it is on, and which side of it.
_STRIP = "array<struct<seam:string,sy:int,sx:int,side:int,labels:array<bigint>>>"


def _schema(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in columns), *T.StructType.fromDDL(more).fields])


def cut(masks: DataFrame, size: int = 512) -> DataFrame:
    """Masks (image_id, category_id, h, w, bits) as tiles of at most size x size, a row a tile."""
    own = masks.select(*KEYS, "h", "w", "bits")
    schema = _schema(own, KEYS, "ty int, tx int, y0 int, x0 int, h int, w int, mask_h int, mask_w int, bits binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                mask = as_image(row.to_pylist()[0], "bits")
                for y in range(0, mask.shape[0], size):
                    for x in range(0, mask.shape[1], size):
                        tile = mask[y : y + size, x : x + size]
                        numbers = (y // size, x // size, y, x, *tile.shape, *mask.shape)
                        yield pa.RecordBatch.from_arrays([*(row.column(c) for c in KEYS), *(pa.array([n], pa.int32()) for n in numbers), pa.array([tile.tobytes()], pa.binary())], schema.names)

    return own.mapInArrow(run, schema)


def _labelled(tiles: DataFrame, diagonal: bool, value: bool) -> DataFrame:
    """Each tile with the areas of its own components, which of them are at the mask's border, and its strips."""
    whole = "mask_h" in tiles.columns
    own = tiles.select(*KEYS, "ty", "tx", "y0", "x0", "h", "w", *(["mask_h", "mask_w"] if whole else []), "bits")
    schema = _schema(own, KEYS, f"ty int, tx int, base bigint, areas array<bigint>, outside array<int>, strips {_STRIP}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                ty, tx = row["ty"], row["tx"]
                label = kernels.components((as_image(row, "bits") != 0) == value, diagonal)
                n = int(label.max())
                if n >= 1 << LABEL_BITS or not 0 <= tx < 1 << COLUMN_BITS - 1 or not 0 <= ty < 1 << 62 - COLUMN_BITS - LABEL_BITS:
                    raise MetrologyError("E-ARG-06", f"tile {ty}, {tx} with {n} components")
                base = (ty << COLUMN_BITS | tx) << LABEL_BITS
                name = np.where(label > 0, label + base, 0)
                edges = {"top": name[0], "bottom": name[-1], "left": name[:, 0], "right": name[:, -1]}
                at_border = []
                if whole:
                    there = {"top": row["y0"] == 0, "left": row["x0"] == 0, "bottom": row["y0"] + row["h"] == row["mask_h"], "right": row["x0"] + row["w"] == row["mask_w"]}
                    at_border = sorted({int(v - base) for side, is_there in there.items() if is_there for v in edges[side] if v})
                strips = [("v", ty, tx, 0, edges["right"]), ("v", ty, tx - 1, 1, edges["left"]), ("h", ty, tx, 0, edges["bottom"]), ("h", ty - 1, tx, 1, edges["top"])]
                if diagonal:  # single pixels at corners, by the tile above
                    strips += [("d", ty, tx, 0, name[-1:, -1]), ("d", ty - 1, tx - 1, 1, name[:1, 0]), ("a", ty, tx, 0, name[-1:, 0]), ("a", ty - 1, tx + 1, 1, name[:1, -1])]
                told = [dict(zip(("seam", "sy", "sx", "side", "labels"), (*s[:4], s[4].tolist()))) for s in strips if s[4].any()]
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in KEYS}, "ty": ty, "tx": tx, "base": base, "areas": np.bincount(label.ravel(), minlength=n + 1)[1:].tolist(), "outside": at_border, "strips": told}], arrow)

    return own.mapInArrow(run, schema)


def _pairs(labelled: DataFrame, diagonal: bool) -> DataFrame:
    """KEYS, u, v (u above v): labels that touch across a seam, each pair of a seam once."""
    strips = labelled.select(*KEYS, F.explode("strips").alias("s")).select(*KEYS, "s.*")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("labels"))).alias(f"l{k}")
    met = strips.groupBy(*KEYS, "seam", "sy", "sx").agg(side(0), side(1)).where("l0 is not null and l1 is not null")
    near = [-1, 0, 1] if diagonal else [0]
    pair = lambda x, i, d: F.struct(F.greatest(x, F.get("l1", i + d)).alias("u"), F.when(x > 0, F.least(x, F.get("l1", i + d))).alias("v"))
    touching = F.filter(F.flatten(F.transform("l0", lambda x, i: F.array(*[pair(x, i, d) for d in near]))), lambda p: p["v"] > 0)
    return met.select(*KEYS, F.explode(F.array_distinct(touching)).alias("p")).select(*KEYS, "p.*").where("u <> v").distinct()


def _least(edges: DataFrame) -> DataFrame:
    """edges with m, the least of u and all its v; a small table a step, so that a hub's edges can be split."""
    least = settled(edges.groupBy(*KEYS, "u").agg(F.min("v").alias("_v")).select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("u").alias("_u"), F.least("u", "_v").alias("m")))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    return edges.join(least, [*on, F.col("u") == F.col("_u")]).drop(*[f"_{k}" for k in KEYS], "_u")


def closure(pairs: DataFrame, most: int = 60) -> DataFrame:
    """KEYS, label, root for each label of pairs that is not the least of its component, by large-star and small-star steps.

    Steps are written; their number grows with the logarithm of the longest chain of labels, and RuntimeError is
    raised after `most` rounds.
    """
    edges, before = settled(pairs), None
    for _ in range(most):
        both = edges.unionByName(edges.select(*KEYS, F.col("v").alias("u"), F.col("u").alias("v")))
        large = settled(_least(both).where("v > u").select(*KEYS, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _least(large)
        ends = lambda a: F.struct(F.col(a).alias("u"), F.col("m").alias("v"))
        edges = settled(small.select(*KEYS, F.explode(F.array(ends("u"), ends("v"))).alias("e")).select(*KEYS, "e.*").where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*KEYS, "u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(*KEYS, F.col("u").alias("label"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("the components did not settle")


def _with_roots(df: DataFrame, roots: DataFrame) -> DataFrame:
    roots = roots.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("label").alias("_label"), "root")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    out = df.join(roots, [*on, F.col("label") == F.col("_label")], "left").drop(*[f"_{k}" for k in KEYS], "_label")
    return out.withColumn("root", F.coalesce("root", "label"))


def components(tiles: DataFrame, diagonal: bool = True, value: bool = True) -> DataFrame:
    """KEYS, component (its least label), area, outside: whether it is at the mask's border (false without mask_h and mask_w).

    Components of true pixels over eight neighbours, or of false ones (value) or over four (diagonal). Tiles of one
    mask must not overlap, and neighbours in ty and tx share whole seams. Tiles may lack; nothing touches across them.
    """
    labelled = settled(_labelled(tiles, diagonal, value))
    roots = closure(_pairs(labelled, diagonal))
    each = labelled.select(*KEYS, "base", "outside", F.posexplode("areas").alias("k", "area"))
    each = each.select(*KEYS, (F.col("base") + F.col("k") + 1).alias("label"), "area", F.array_contains("outside", F.col("k") + 1).alias("outside"))
    return _with_roots(each, roots).groupBy(*KEYS, F.col("root").alias("component")).agg(F.sum("area").alias("area"), F.max("outside").alias("outside"))


def labels(tiles: DataFrame, diagonal: bool = True) -> DataFrame:
    """KEYS, ty, tx, h, w, labels: each tile's pixels as labels of whole components (8 bytes each, 0 outside), by the names that components() gives."""
    roots = settled(closure(_pairs(settled(_labelled(tiles, diagonal, True)), diagonal)))
    step = F.lit(1 << LABEL_BITS)
    here = roots.withColumn("ty", F.shiftright("label", COLUMN_BITS + LABEL_BITS).cast("int")).withColumn("tx", (F.shiftright("label", LABEL_BITS) % (1 << COLUMN_BITS)).cast("int"))
    maps = here.groupBy(*KEYS, "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct((F.col("label") % step).cast("int"), "root"))).alias("roots"))
    maps = maps.select(*[F.col(c).alias(f"_{c}") for c in (*KEYS, "ty", "tx")], "roots")
    own = tiles.select(*KEYS, "ty", "tx", "h", "w", "bits")
    met = own.join(maps, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*KEYS, "ty", "tx")], "left").select(*own.columns, "roots")
    schema = _schema(own, [*KEYS, "ty", "tx", "h", "w"], "labels binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                d = row.to_pylist()[0]
                label = kernels.components(as_image(d, "bits") != 0, diagonal)
                names = np.arange(int(label.max()) + 1, dtype=np.int64) + ((d["ty"] << COLUMN_BITS | d["tx"]) << LABEL_BITS)
                names[0] = 0
                for own_label, root in d["roots"] or []:
                    names[own_label] = root
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in (*KEYS, "ty", "tx", "h", "w")), pa.array([names[label].tobytes()], pa.binary())], schema.names)

    return met.mapInArrow(run, schema)


def tile_features(tiles: DataFrame) -> DataFrame:
    """KEYS, mask_n_components, mask_hole_frac, mask_area_frac of tiled masks; the features of a mask that need no image.

    Holes are false pixels that do not reach the mask's border over four neighbours. A mask without true pixels has
    no share of holes (null).
    """
    wholes = tiles.groupBy(*KEYS).agg(F.max(F.col("mask_h").cast("double") * F.col("mask_w")).alias("_all"))
    true = components(tiles).groupBy(*KEYS).agg(F.count("*").alias("_n"), F.sum("area").alias("_area"))
    holes = components(tiles, diagonal=False, value=False).where("not outside").groupBy(*KEYS).agg(F.sum("area").alias("_holes"))
    out = wholes
    for part in (true, holes):
        part = part.select(*[F.col(k).alias(f"_{k}") for k in KEYS], *[c for c in part.columns if c not in KEYS])
        out = out.join(part, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS], "left").drop(*[f"_{k}" for k in KEYS])
    n: Column = F.coalesce("_n", F.lit(0)).cast("double")
    area, holes_ = F.coalesce("_area", F.lit(0)), F.coalesce("_holes", F.lit(0))
    return out.select(*KEYS, n.alias("mask_n_components"), F.when(area > 0, holes_ / (area + holes_)).alias("mask_hole_frac"), (area / F.col("_all")).alias("mask_area_frac"))
