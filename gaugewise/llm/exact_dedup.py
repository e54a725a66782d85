"""Exact duplicates: frequent digests found by Misra-Gries are settled on the map side, the rest by a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import fresh, id_and_text, written

#: Counters of the Misra-Gries summary: it holds every digest of more than 1/(CAPACITY + 1) of the rows, and its size bounds what is broadcast.
CAPACITY = 255


def misra_gries(counts: dict[bytes, int], more: dict[bytes, int], capacity: int = CAPACITY) -> dict[bytes, int]:
    """Adds counts to a summary of at most `capacity` counters; what it undercounts is at most 1/(capacity + 1) of all."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > capacity:
        floor = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -capacity - 1)[-capacity - 1])
        counts = {key: n - floor for key, n in counts.items() if n > floor}
    return counts


def frequent(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """At most `capacity` values of the one binary column of keys; those of more than 1/(capacity + 1) of the rows are among them.

    One summary a partition; the summaries are summed, and the largest `capacity` sums stay, which is how such
    summaries merge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            counts = misra_gries(counts, dict(zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist())), capacity)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())], ["key", "n"])

    summed = keys.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return summed.orderBy(F.desc("n"), "key").limit(capacity).select("key")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of df: doc_id, digest (SHA-256, binary), keep_id, group_size, kept, row (its place in df).

    Rows are equal when their texts are identical; null counts as the empty text. The row with the largest doc_id
    stays (null is the smallest); of repeated rows with that doc_id and text exactly one is kept. An empty table
    gives an empty one. Other columns of df are not looked at.
    """
    base = id_and_text(df, id_col, text_col)
    rows = base.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "exact-digests")  # 32 bytes a text: no later step reads texts, and row ids hold
    best = F.max(F.struct("doc_id", "row")).alias("best")
    hot = F.broadcast(frequent(rows.select("digest"), capacity).withColumnRenamed("key", "digest"))
    winners = written(rows.join(hot, "digest").groupBy("digest").agg(best, F.count("*").alias("group_size")), "exact-winners")
    hot_rows = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(best, F.count("*").alias("group_size"))
    rest_rows = rest.join(groups, "digest")
    return hot_rows.unionByName(rest_rows).select(
        "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "row"
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of df that exact_duplicates() keeps, with df's columns. df must read alike twice, as files do."""
    row = fresh(df, "row")
    dropped = exact_duplicates(df, id_col, text_col, capacity).where("not kept").select(F.col("row").alias(row))
    return df.withColumn(row, F.monotonically_increasing_id()).join(written(dropped, "exact-dropped"), row, "left_anti").select(*df.columns)
