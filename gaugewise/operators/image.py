"""Image evidence as DataFrame operators: Spark brings an image and its segments or masks to one task, numpy does the rest.

Images are rows (image_id, h, w, pixels), masks rows (image_id, category_id, h, w, bits); pixels and bits are bytes in
rows. Images, masks and segments are one table of tagged rows, dealt by image and sorted so that an image comes before
its masks and a mask before its segments. So pixels are sent once whatever the number of masks, and a task holds an
image, a mask and the segments of one category at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gaugewise.functions import kernels
from gaugewise.operators.convert import convention_candidates
from gaugewise.operators.stats import exact_quantiles
from gaugewise.registry import MetrologyError, Params
from gaugewise.sources.tables import settled


def as_image(row, column: str = "pixels") -> np.ndarray:
    """The bytes of a row as h x w; E-ARG-02 (image) or E-ARG-07 (mask) if they do not fit."""
    data = np.frombuffer(row[column], np.uint8)
    if data.size != row["h"] * row["w"] or not data.size:
        raise MetrologyError("E-ARG-02" if column == "pixels" else "E-ARG-07", f"{row['h']} x {row['w']}, {data.size} bytes")
    return data.reshape(int(row["h"]), int(row["w"]))


def _doubles(names) -> str:
    return ", ".join(f"{n} {'boolean' if n.startswith('edge_valid') or n == 'minside' else 'double'}" for n in names)


def _schema(df: DataFrame, columns: list[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [more])


def _renamed(images: DataFrame) -> DataFrame:
    """Images with a key of their own name, as segments may be derived from them."""
    return images.select(F.col("image_id").alias("_image"), "h", "w", "pixels")


def _nulls(df: DataFrame) -> DataFrame:
    """NaN of kernels as null."""
    return df.select([F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


IMAGE, MASK, SEGMENT = range(3)


def _dealt(images: DataFrame, masks: DataFrame | None = None, segments: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """Images, masks and segments as tagged rows: _image, _category, _tag, h, w, _data and, if there are segments, all their columns in _row.

    They are dealt by the image and its hash. By the image alone Spark leaves the exchange out where all parts are grouped
    by it already, and then joins small partitions of each part on its own, so that an image and its masks part.
    """
    kind = segments.schema[category].dataType if segments is not None and category else masks.schema["category_id"].dataType if masks is not None else T.IntegerType()
    none = lambda t: F.lit(None).cast(t)
    size = [F.col(c).cast("int").alias(c) for c in ("h", "w")]
    row = [] if segments is None else [none(segments.select(F.struct(*segments.columns).alias("r")).schema["r"].dataType).alias("_row")]
    parts = [images.where("image_id is not null").select(F.col("image_id").alias("_image"), none(kind).alias("_category"), F.lit(IMAGE).alias("_tag"), *size, F.col("pixels").alias("_data"), *row)]
    if masks is not None:
        parts.append(masks.where("image_id is not null").select(F.col("image_id").alias("_image"), F.col("category_id").cast(kind).alias("_category"), F.lit(MASK).alias("_tag"), *size, F.col("bits").alias("_data"), *row))
    if segments is not None:
        own = F.col(category) if category else none(kind)
        parts.append(segments.select(F.col("image_id").alias("_image"), own.alias("_category"), F.lit(SEGMENT).alias("_tag"), *[none("int").alias(c) for c in ("h", "w")], none("binary").alias("_data"), F.struct(*segments.columns).alias("_row")))
    return reduce(DataFrame.unionByName, parts).repartition("_image", F.xxhash64("_image")).sortWithinPartitions("_image", "_category", "_tag")


class Group(NamedTuple):
    """What belongs to one image and category: segments is None if only the mask came by."""

    image_id: object
    category_id: object
    image: np.ndarray | None
    mask: np.ndarray | None
    segments: pa.Table | None


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    """Groups in the order of _dealt(). Of images or masks with one name the first counts; E-ARG-07 if a mask is not of its image's size."""
    image_of, image, mask_of, mask, group, held = None, None, None, None, None, []

    def over() -> Group:
        own = image if image_of == group[0] else None
        return Group(*group, own, mask if own is not None and mask_of == group else None, pa.Table.from_batches(held) if held else None)

    for batch in batches:
        ids, categories, tags = (batch.column(c).to_pylist() for c in ("_image", "_category", "_tag"))
        at = 0
        while at < len(ids):
            key, tag, end = (ids[at], categories[at]), tags[at], at + 1
            while tag == SEGMENT and end < len(ids) and ids[end] == key[0] and categories[end] == key[1] and tags[end] == SEGMENT:
                end += 1
            if group is not None and (key != group or tag == IMAGE):
                yield over()
                group, held = None, []
            if tag == IMAGE:
                if image_of != key[0] or image is None:
                    image_of, image = key[0], as_image({"h": batch["h"][at].as_py(), "w": batch["w"][at].as_py(), "pixels": batch["_data"][at].as_py()})
            elif tag == MASK:
                if image_of == key[0] and (group is None or mask_of != key):
                    mask_of, mask = key, as_image({"h": batch["h"][at].as_py(), "w": batch["w"][at].as_py(), "bits": batch["_data"][at].as_py()}, "bits") != 0
                    if mask.shape != image.shape:
                        raise MetrologyError("E-ARG-07", f"{mask.shape}, {image.shape}")
                group = key
            else:
                group = key
                held.append(pa.RecordBatch.from_struct_array(batch.slice(at, end - at).column("_row")))
            at = end
    if group is not None:
        yield over()


def _found(found: dict[str, np.ndarray], names: tuple[str, ...]) -> list[pa.Array]:
    """Kernel results as columns; NaN as null."""
    return [pa.array(x) if x.dtype == bool else pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (found[n] for n in names)]


def _kind(name: str) -> T.DataType:
    return T.BooleanType() if name.startswith("edge_valid") or name == "minside" else T.DoubleType()


def segment_evidence(segments: DataFrame, images: DataFrame, masks: DataFrame | None = None, edges: bool = True, params: Params = Params(), beyond: bool = False) -> DataFrame:
    """segments with the columns of kernels.EVIDENCE (edges) and, if there are masks, of kernels.MASK_L3: a row a segment, in one exchange.

    segments: image_id, sx, sy, ex, ey, px_nm, with edges ribbon_tx and ribbon_ty, with masks category_id, and any
    others. Segments without an image have nulls and edge_valid false; without a mask all columns of the mask are null.
    beyond: see kernels.mask_evidence().
    """
    masked = masks is not None
    names = kernels.EVIDENCE * edges + kernels.MASK_L3 * masked
    schema = T.StructType([*segments.schema.fields, *(T.StructField(n, _kind(n)) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            if g.segments is None:
                continue
            own, n = g.segments.combine_chunks(), len(g.segments)
            numbers = lambda *c: np.stack([own[x].to_numpy(zero_copy_only=False).astype(float) for x in c], 1)
            s, e, px = numbers("sx", "sy"), numbers("ex", "ey"), numbers("px_nm")[:, 0]
            more = []
            if edges:
                nothing = {c: np.zeros(n, bool) if c.startswith("edge_valid") else np.full(n, np.nan) for c in kernels.EVIDENCE}
                more += _found(nothing if g.image is None else kernels.evidence(g.image, s, e, numbers("ribbon_tx", "ribbon_ty"), px, params), kernels.EVIDENCE)
            if masked:
                more += [pa.nulls(n, pa.bool_() if c == "minside" else pa.float64()) for c in kernels.MASK_L3] if g.mask is None else _found(kernels.mask_evidence(g.mask, g.image, s, e, px, params, beyond), kernels.MASK_L3)
            yield from pa.Table.from_arrays([*own.columns, *more], schema.names).to_batches()

    return _dealt(images, masks, segments, "category_id" if "category_id" in segments.columns else None).mapInArrow(run, schema)


def image_evidence(segments: DataFrame, images: DataFrame, keys: tuple[str, ...] = ("category_id", "cd_index"), params: Params = Params()) -> DataFrame:
    """image_id, keys and the columns of kernels.EVIDENCE for every segment (sx, sy, ex, ey, px_nm, ribbon_tx, ribbon_ty).

    Segments without an image have nulls and edge_valid false.
    """
    own = segments.select("image_id", *keys, "sx", "sy", "ex", "ey", "px_nm", "ribbon_tx", "ribbon_ty")
    return segment_evidence(own, images, params=params).select("image_id", *keys, *kernels.EVIDENCE)


def mask_evidence(segments: DataFrame, masks: DataFrame, images: DataFrame, keys: tuple[str, ...] = ("cd_index",), params: Params = Params()) -> DataFrame:
    """image_id, category_id, keys and the columns of kernels.MASK_L3 for every segment that has a mask and an image."""
    own = segments.select("image_id", "category_id", *keys, "sx", "sy", "ex", "ey", "px_nm")
    return segment_evidence(own, images, masks, edges=False, params=params).where("minside is not null").select("image_id", "category_id", *keys, *kernels.MASK_L3)


def image_features(images: DataFrame) -> DataFrame:
    """image_id, the columns of kernels.L1 and hist (256 shares), an image a row."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, row in batch.iterrows():
                found, hist = kernels.image_features(as_image(row))
                rows.append({"image_id": row["image_id"], **found, "hist": hist})
            yield pd.DataFrame(rows, columns=["image_id", *kernels.L1, "hist"])

    own = images.select("image_id", "h", "w", "pixels")
    return _nulls(own.mapInPandas(run, _schema(own, ["image_id"], _doubles(kernels.L1) + ", hist array<double>")))


def mask_features(masks: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, category_id and the columns of kernels.LM, a row for every mask that has an image."""
    dealt = _dealt(images, masks)
    schema = T.StructType([T.StructField("image_id", dealt.schema["_image"].dataType), T.StructField("category_id", dealt.schema["_category"].dataType), *(T.StructField(n, T.DoubleType()) for n in kernels.LM)])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[:2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            if g.mask is not None:
                found = {k: np.array([v], float) for k, v in kernels.mask_features(g.mask, g.image).items()}
                yield pa.RecordBatch.from_arrays([pa.array([g.image_id], kinds[0]), pa.array([g.category_id], kinds[1]), *_found(found, kernels.LM)], schema.names)

    return dealt.mapInArrow(run, schema)


def candidate_offsets(image: np.ndarray, s: np.ndarray, e: np.ndarray, scale: float = 1.0) -> Iterator[np.ndarray]:
    """For each of convention_candidates() how far edges are from both ends of segments, all starts first."""
    for c in convention_candidates():
        ends = []
        for xy in (s, e):
            x, y = (xy[:, k] * scale - (c["origin"] == "one") for k in range(2))
            x, y = (y, x) if c["convention"] == "rowcol" else (x, y)
            ends.append(np.stack((x, image.shape[0] - 1 - y if c["y_flip"] else y), axis=1))
        yield kernels.edge_offsets(image, *ends)


def convention_scores(segments: DataFrame, images: DataFrame, scale: float = 1.0) -> DataFrame:
    """convention, y_flip, origin, scale, median_dist_px: how far edges are from segment ends under each way of writing coordinates.

    Adopt the first row only if it is at 0.75 px or less and the second at twice that or more. Ties are in order of names.
    """
    own = segments.select("image_id", "sx", "sy", "ex", "ey")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["number", "dist"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        s, e = (left[list(c)].to_numpy(float) for c in (("sx", "sy"), ("ex", "ey")))
        return pd.concat([pd.DataFrame({"number": k, "dist": d}) for k, d in enumerate(candidate_offsets(as_image(right.iloc[0]), s, e, scale))])

    dist = own.groupBy("image_id").cogroup(_renamed(images).groupBy("_image")).applyInPandas(run, "number int, dist double")
    found = exact_quantiles(settled(dist), "dist", {"median_dist_px": 0.5}, "number").select("number", "median_dist_px")
    table = F.array(*[F.struct(F.lit(k).alias("number"), *(F.lit(v).alias(n) for n, v in c.items())) for k, c in enumerate(convention_candidates())])
    all_ = own.sparkSession.range(1).select(F.explode(table).alias("c")).select("c.*")
    out = all_.join(F.broadcast(found), "number", "left")  # eight rows
    return out.select("convention", "y_flip", "origin", F.lit(float(scale)).alias("scale"), F.coalesce("median_dist_px", F.lit(3.0)).alias("median_dist_px")).orderBy("median_dist_px", "convention", "origin", "y_flip")


def images_of(pixels: DataFrame, value: str = "v", column: str = "pixels") -> DataFrame:
    """Rows (image_id, y, x, value) as one row an image; every pixel of the rectangle must be there."""
    rows = pixels.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", F.col(value).cast("long").alias("v")))).alias("_all"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return rows.select("image_id", "h", "w", F.unhex(F.array_join(F.transform("_all", lambda p: F.lpad(F.hex(p["v"]), 2, "0")), "")).alias(column))
