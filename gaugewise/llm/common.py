"""What the corpus operators share: reading, writing between steps, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A piece of text handed to one numpy pass holds about so many bytes, so that a worker's memory does not follow the batch size.
PASS_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one of our own only where none is set and Spark runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return jsc.getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that a lost executor costs a reread and not a recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, under fixed names, null text as the empty text."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def schema_of(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of doc_id as df has it, and then the named fields."""
    out = T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType)])
    for name, kind in fields:
        out = out.add(name, T._parse_datatype_string(kind))
    return out


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, mod a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def passes(batch: pa.RecordBatch, column: str = "text", most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes together; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def released(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """run over Arrow batches; then the worker, which Spark keeps for other tasks, gives back the memory that it took."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if forget:
            forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return of


def in_blocks(base: DataFrame, most: int) -> DataFrame:
    """base (doc_id, text) with a block number: neighbouring rows of about `most` bytes of text. Numbers hold only once the result is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in passes(batch):
                held += part.column("text").nbytes
                if held > most:
                    block, held = block + 1, part.column("text").nbytes
                yield part.append_column("block", pa.array([block] * len(part), pa.int64()))

    return base.mapInArrow(run, schema_of(base, ("text", "string"), ("block", "long")))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_of(spark_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark_type)
