"""Measurement tables derived from the star-schema tables: sequences of segments, thumbnails, slabs, events, labelled texts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set and Spark runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        own = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
    return jsc.getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it is computed once, its size is known to the joins after it, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measurement a line item: image_id, category_id, cd_index, sx, sy, ex, ey, value, unit, flag, is_bad."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_tax", "l_quantity", "l_discount", "l_linestatus", "l_returnflag")
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    li = li.withColumn("cd_index", F.row_number().over(w).cast("long") - 1)
    c = li.select(
        F.floor(F.col("l_partkey") / 5).cast("long").alias("image_id"), (F.col("l_partkey") % 5).cast("int").alias("category_id"), "cd_index",
        (100.0 + 40.0 * F.col("l_tax") + 0.05 * F.col("cd_index")).alias("sx"), (10.0 * F.col("cd_index")).alias("sy"),
        (150.0 + 0.1 * F.col("l_quantity")).alias("ex"), (10.0 * F.col("cd_index") + 20.0 * F.col("l_discount")).alias("ey"),
        "l_discount", "l_returnflag", "l_linestatus",
    )
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    true = 0.5 * F.sqrt(dx * dx + dy * dy) + 0.5 * F.col("l_discount")
    old = F.col("l_linestatus") == "F"
    return c.select(
        "image_id", "category_id", "cd_index", "sx", "sy", "ex", "ey", F.when(old, true * 10.0).otherwise(true).alias("value"), F.when(old, "Å").otherwise("nm").alias("unit"),
        (F.col("l_discount") >= 0.09).alias("flag"), (F.col("l_returnflag") == "R").alias("is_bad"),
    )


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel a row of an 8 x 8 image for each vector: image_id, label, y, x, f."""
    e = read(spark, sf_dir, "embeddings")
    p = e.select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("i", "f"))
    return p.select("image_id", "label", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("f").cast("double").alias("f"))


def slabs(spark: SparkSession, sf_dir: str, height: int = 64, depth: int = 8) -> DataFrame:
    """One image a row: image_id, h, w, pixels (BINARY; 16 bits: low byte first): the vectors of a label, `height` at a time, as rows of pixels.

    A slab has a bounded height, so more vectors are more images and not larger ones. The upper byte of 16 bits is what 8 bits hold.
    """
    e = read(spark, sf_dir, "embeddings")
    e = e.withColumn("_part", F.floor(F.col("vec_id") / (10 * height)))
    octet = lambda n: F.lpad(F.hex(n), 2, "0")

    def pixel(v: Column) -> Column:
        scale = 1 << depth - 8
        level = F.least(F.greatest(F.floor(128.0 * scale + 40.0 * scale * v), F.lit(0)), F.lit(256 * scale - 1)).cast("long")
        return octet(level) if depth == 8 else F.concat(octet(level % 256), octet(F.shiftright(level, 8)))

    rows = e.select("label", "_part", "vec_id", F.array_join(F.transform(F.col("embedding").cast("array<double>"), pixel), "").alias("_row"), F.size("embedding").alias("w"))
    out = rows.groupBy("label", "_part").agg(F.sort_array(F.collect_list(F.struct("vec_id", "_row"))).alias("_rows"), F.max("w").alias("w"))
    return out.select(
        F.concat_ws("_", "label", "_part").alias("image_id"), F.size("_rows").alias("h"), "w", F.unhex(F.array_join(F.transform("_rows", lambda r: r["_row"]), "")).alias("pixels")
    )


def slab_segments(images: DataFrame) -> DataFrame:
    """Segments from x = 16 to x = 48 on every fourth row of slabs, from the sixth on."""
    rows = images.select("image_id", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("h") - 13) / 4), F.lit(0)).cast("int"))).alias("cd_index"))
    y = (6 + 4 * F.col("cd_index")).cast("double")
    return rows.select("image_id", F.lit(0).alias("category_id"), F.col("cd_index").cast("long"), F.lit(16.0).alias("sx"), y.alias("sy"), F.lit(48.0).alias("ex"), y.alias("ey"), F.lit(0.5).alias("px_nm"))


def slab_masks(images: DataFrame, ranges: dict[int, tuple[int, int]]) -> DataFrame:
    """Masks of 8-bit images: image_id, category_id, h, w, bits; for each category the pixels within its range of values, a row an image and category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = [np.frombuffer(x or b"", np.uint8) for x in batch.column("pixels").to_pylist()]
            for category, (low, high) in ranges.items():
                bits = [((x >= low) & (x <= high)).astype(np.uint8).tobytes() for x in pixels]
                yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array([category] * len(bits), pa.int32()), batch.column("h"), batch.column("w"), pa.array(bits, pa.binary())], ["image_id", "category_id", "h", "w", "bits"])

    kinds = dict(images.dtypes)
    return images.select("image_id", "h", "w", "pixels").mapInArrow(run, f"image_id {kinds['image_id']}, category_id int, h {kinds['h']}, w {kinds['w']}, bits binary")


def mosaic_tiles(spark: SparkSession, sf_dir: str, above: float = 0.1, side: int = 32) -> DataFrame:
    """One mask of all vectors, a row of pixels each at y = vec_id, as tiles of side x side: pixels above a value are true, missing rows false."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.when(v.cast("double") > above, "01").otherwise("00")).alias("_bits"))
    cut = e.select("vec_id", F.size("_bits").alias("mask_w"), "_bits", F.explode(F.sequence(F.lit(0), F.floor((F.size("_bits") - 1) / side).cast("int"))).alias("tx"))
    cut = cut.select(F.floor(F.col("vec_id") / side).cast("int").alias("ty"), "tx", (F.col("vec_id") % side).cast("int").alias("_y"), "mask_w", F.slice("_bits", F.col("tx") * side + 1, side).alias("_row"))
    rows = cut.groupBy("ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("_y", "_row"))).alias("_rows"), F.max(F.size("_row")).alias("w"), F.max("mask_w").alias("mask_w"))
    row = lambda y: F.array_join(F.coalesce(F.try_element_at("_rows", y), F.array_repeat(F.lit("00"), F.col("w"))), "")
    bits = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), row), ""))
    return rows.select(F.lit("mosaic").alias("image_id"), F.lit(0).alias("category_id"), "ty", "tx", (F.col("ty") * side).alias("y0"), (F.col("tx") * side).alias("x0"), F.lit(side).alias("h"), "w", bits.alias("bits"))


def user_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in order: user_id, ord, value, flag."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("ord"), "value", (F.col("value") > 60).alias("flag"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, score (the text's length), bad (low quality)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return d.join(read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")


def save(df: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes any result as parquet, csv, json or orc; nested and binary columns need parquet, orc or json."""
    w = df.write.format(format).mode(mode)
    if format == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def load(spark: SparkSession, path: str, format: str = "parquet", schema=None) -> DataFrame:
    """Reads what save() wrote, or any table of measurements."""
    r = spark.read.format(format)
    if schema is not None:
        r = r.schema(schema)
    if format == "csv":
        r = r.option("header", True)
    return r.load(path)
