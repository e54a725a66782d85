"""Folders of PNG images as tables: spark.read.format("grey_png") and df.write.format("grey_png"), or Spark's own file reader."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gaugewise.functions import kernels, png
from gaugewise.registry import MetrologyError
from gaugewise.sources import tables

#: path of the file, its name without folder and suffix, size, bits a pixel, rows of pixels (16 bits: low byte first), why a file could not be read.
SCHEMA = "path string, image_id string, h int, w int, depth int, pixels binary, reason string"
_ARROW = pa.schema([("path", pa.string()), ("image_id", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("depth", pa.int32()), ("pixels", pa.binary()), ("reason", pa.string())])
SUFFIX = ".png"
#: Bytes of files that a task gets (option partitionBytes), and bytes of pixels in a batch.
PARTITION, BATCH = 64 << 20, 8 << 20


def _row(path: str, image_id: str, data: bytes) -> dict:
    try:
        found = png.decode(data)
    except png.PngError as e:
        return {"path": path, "image_id": image_id, "reason": str(e)}
    depth = 8 * found.dtype.itemsize
    return {"path": path, "image_id": image_id, "h": found.shape[0], "w": found.shape[1], "depth": depth, "pixels": found.astype(found.dtype.newbyteorder("<")).tobytes()}


def _batches(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("pixels") or b"")
        if size > BATCH:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


def id_of(path: str, suffix: str = SUFFIX) -> str:
    return unquote(posixpath.basename(path).removesuffix(suffix))


def _filesystem(path: str):
    """The store behind a path or address (local, s3, gs, hdfs) and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), posixpath.abspath(path)


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class PngReader(DataSourceReader):
    """Lists the folder once; a partition is a group of neighbouring files by size.

    Files are picked by the option pathGlobFilter and not by pushFilters(): Spark 4.1 keeps the partitions that one
    query's filters have left for the next query over the same frame, which would lose its rows.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix = options["path"], options.get("suffix", SUFFIX)
        self.partition_bytes = int(options.get("partitionbytes", PARTITION))
        self.names = options.get("pathglobfilter", "*")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, folder = _filesystem(self.folder)
        found = [i for i in store.get_file_info(fs.FileSelector(folder, recursive=True)) if i.is_file and i.path.endswith(self.suffix) and not posixpath.basename(i.path).startswith((".", "_"))]
        groups, size = [[]], 0
        for info in sorted(found, key=lambda i: i.path):
            if fnmatchcase(posixpath.basename(info.path), self.names):
                if groups[-1] and size + info.size > self.partition_bytes:
                    groups.append([])
                    size = 0
                groups[-1].append(info.path)
                size += info.size
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(self.folder)

        def rows() -> Iterator[dict]:
            for path in partition.names:
                with store.open_input_stream(path) as f:
                    yield _row(path, id_of(path, self.suffix), f.read())

        yield from _batches(rows())


@dataclass
class Written(WriterCommitMessage):
    names: int


class PngWriter(DataSourceArrowWriter):
    """A file an image. A file gets its name when it is whole, and what it holds follows from its row, so a task that runs twice does no harm."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder = options["path"]
        if overwrite:
            raise MetrologyError("E-ARG-06", "grey_png does not overwrite; write to a new folder in mode append")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _filesystem(self.folder)
        store.create_dir(folder, recursive=True)
        n = 0
        for batch in batches:
            for row in (r for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
                image, name = pixels_of(row), quote(str(row["image_id"]), safe="")
                own = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as f:
                    f.write(png.encode(image))
                store.move(own, f"{folder}/{name}{SUFFIX}")
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _filesystem(self.folder)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_SUCCESS") as f:
            f.write(str(sum(m.names for m in messages if m)).encode())


class GreyPng(DataSource):
    """Options: path, partitionBytes, suffix, pathGlobFilter (of file names). Rows to write: image_id, h, w, pixels and, for 16 bits, depth; image_id names the file and must be unique."""

    @classmethod
    def name(cls) -> str:
        return "grey_png"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PngReader:
        return PngReader(self.options)

    def writer(self, schema, overwrite: bool) -> PngWriter:
        return PngWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(GreyPng)


def load_images(spark: SparkSession, path: str, suffix: str = SUFFIX) -> DataFrame:
    """The same rows through Spark's binaryFile, for stores that only Spark reaches; files are dealt by spark.sql.files.maxPartitionBytes.

    An empty folder gives an empty table; a broken file gives a row with nulls and a reason,
    a file without a byte no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_row(b["path"][k].as_py(), id_of(b["path"][k].as_py(), suffix), b["content"][k].as_py()) for b in batches for k in range(len(b)))

    return files.mapInArrow(run, SCHEMA)


def save_images(images: DataFrame, path: str) -> None:
    """Images as PNG files in a new folder; repeated names are an error (E-ARG-01), found before anything is written."""
    register(images.sparkSession)
    again = images.groupBy("image_id").count().where("count > 1").first()
    if again:
        raise MetrologyError("E-ARG-01", f"image_id {again[0]} is there {again[1]} times")
    own = images.select(F.col("image_id").cast("string"), F.col("h").cast("int"), F.col("w").cast("int"), F.col("depth").cast("int") if "depth" in images.columns else F.lit(8).alias("depth"), "pixels")
    own.write.format("grey_png").mode("append").save(path)


def pixels_of(row: dict) -> np.ndarray:
    """The pixels of a row as h x w, in 8 or 16 bits; E-ARG-02 if they do not fit."""
    kind = np.dtype("<u2" if row.get("depth") == 16 else "u1")
    data, size = row["pixels"] or b"", (row["h"] or 0) * (row["w"] or 0)
    if len(data) != size * kind.itemsize or not size:
        raise MetrologyError("E-ARG-02", f"{row['image_id']}: {row['h']} x {row['w']}, {len(data)} bytes")
    return np.frombuffer(data, kind).reshape(row["h"], row["w"]).astype(kind.newbyteorder("="))


def as_uint8(images: DataFrame, method: str = "percentile") -> DataFrame:
    """image_id, h, w, pixels in 8 bits: 16 bits are stretched between percentiles, or lose their lower byte ("shift"). 8-bit images stay, unread ones have null pixels."""
    if method not in ("percentile", "shift"):
        raise MetrologyError("E-ARG-06", method)
    own = images.select("image_id", "h", "w", "depth", "pixels")
    kind = own.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                made.append(None if row["pixels"] is None else kernels.to_uint8(pixels_of(row), method).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "h", "w")), pa.array(made, pa.binary())], ["image_id", "h", "w", "pixels"])

    return own.mapInArrow(run, f"image_id {kind}, h int, w int, pixels binary")


def save_dataset(path: str, measurements: DataFrame, images: DataFrame, masks: DataFrame | None = None) -> None:
    """A data set in a new folder: images/ and masks/ as PNG files (masks in black and white, named by image and category), records/ as CSV.

    Category names must not hold a "/" (E-ARG-06), image names may.
    """
    save_images(images, f"{path}/images")
    if masks is not None:
        if masks.where(F.col("category_id").cast("string").contains("/")).take(1):
            raise MetrologyError("E-ARG-06", "a category with / in its name")
        name = F.concat(F.col("image_id").cast("string"), F.lit("/"), F.col("category_id").cast("string")).alias("image_id")
        save_images(_white(masks.select(name, "h", "w", F.col("bits").alias("pixels"))), f"{path}/masks")
    tables.save(measurements, f"{path}/records", "csv")


def _white(masks: DataFrame) -> DataFrame:
    """Pixels that are not 0 as 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if x is None else ((np.frombuffer(x, np.uint8) != 0) * np.uint8(255)).tobytes() for x in b.column("pixels").to_pylist()]
            yield b.set_column(b.schema.get_field_index("pixels"), "pixels", pa.array(made, pa.binary()))

    return masks.mapInArrow(run, masks.schema)


def load_dataset(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Measurements (by the schema given, image_id and category_id among its columns), images and masks of save_dataset(), ids in the measurements' types."""
    register(spark)
    records = tables.load(spark, f"{path}/records", "csv", schema)
    kind = {k: records.schema[k].dataType for k in ("image_id", "category_id")}
    read = lambda sub: spark.read.format("grey_png").load(f"{path}/{sub}").where("reason is null")
    images = read("images").select(F.col("image_id").cast(kind["image_id"]).alias("image_id"), "h", "w", "depth", "pixels")
    name = F.expr("substring(image_id, 1, length(image_id) - locate('/', reverse(image_id)))"), F.substring_index("image_id", "/", -1)
    masks = read("masks").select(name[0].cast(kind["image_id"]).alias("image_id"), name[1].cast(kind["category_id"]).alias("category_id"), "h", "w", F.col("pixels").alias("bits"))
    return records, images, masks
