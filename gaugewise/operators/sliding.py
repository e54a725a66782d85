"""Medians of frames that slide along sequences, at the cost of a search in a sorted frame and not of a frame a row."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewise.operators.convert import finite
from gaugewise.operators.sequence import Sequence, _unit, unit_tangents
from gaugewise.registry import Params


class Frame:
    """The sorted finite values around a row of one sequence. Medians come `half` rows late, and once the sequence is known to be long enough."""

    def __init__(self, half: int, least: int):
        self.half, self.least = half, least
        self._start()

    def _start(self) -> None:
        self.coming: deque[float] = deque()  # not yet in a frame
        self.inside: deque[float] = deque()
        self.sorted: list[float] = []
        self.n = self.next = self.first = 0

    def _median(self) -> float | None:
        while self.coming and self.first + len(self.inside) <= self.next + self.half:
            v = self.coming.popleft()
            self.inside.append(v)
            if math.isfinite(v):
                insort(self.sorted, v)
        while self.first < self.next - self.half:
            v = self.inside.popleft()
            self.first += 1
            if math.isfinite(v):
                del self.sorted[bisect_left(self.sorted, v)]
        self.next += 1
        n = len(self.sorted)
        return 0.5 * self.sorted[(n - 1) // 2] + 0.5 * self.sorted[n // 2] if n else None

    def feed(self, values: list[float], out: list[float | None]) -> None:
        self.coming.extend(values)
        self.n += len(values)
        if self.n >= self.least:
            while self.n > self.next + self.half:
                out.append(self._median())

    def end(self, out: list[float | None]) -> None:
        """The sequence is over: the rest, or nulls if it is too short."""
        if self.n < self.least:
            out.extend([None] * (self.n - self.next))
        else:
            while self.next < self.n:
                out.append(self._median())
        self._start()


def sliding_medians(df: DataFrame, columns: dict[str, str], half: int, seq: Sequence = Sequence(), least: int = 0) -> DataFrame:
    """df with, for each name, the median of a column over the rows from `half` before to `half` after in the sequence.

    Missing values (null, NaN, infinities) are left out; a frame without any is null, and so are sequences of fewer
    than `least` rows. Null keys make sequences of their own. Sequences come sorted to a task, which reads them batch
    by batch and keeps one frame a column and the rows that wait for it: memory is frames and a batch whatever the
    length of a sequence, and time grows with the logarithm of the frame.
    """
    key_cols = list(seq.keys)
    mark = "_" * (1 + max(len(c) for c in df.columns))  # longer than any name, so there is no clash
    own = df.select("*", *[F.coalesce(finite(F.col(c).cast("double")), F.lit(math.nan)).alias(f"{mark}{i}") for i, c in enumerate(columns.values())])
    kept = len(df.columns)
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in columns)])
    names, n_columns = schema.names, len(columns)
    places = [df.columns.index(k) for k in key_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames, out = [Frame(half, least) for _ in range(n_columns)], [[] for _ in range(n_columns)]
        waiting: deque[pa.RecordBatch] = deque()
        last = None

        def ready() -> Iterator[pa.RecordBatch]:
            while waiting and len(out[0]) >= len(waiting[0]):
                batch = waiting.popleft()
                made = []
                for o in out:
                    made.append(pa.array(o[: len(batch)], pa.float64()))
                    del o[: len(batch)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *made], names)

        for batch in batches:
            if not len(batch):
                continue
            waiting.append(batch)
            values = [batch.column(kept + i).to_pylist() for i in range(n_columns)]
            keys = list(zip(*(batch.column(p).to_pylist() for p in places))) if places else [()] * len(batch)
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(starts, starts[1:]):
                for frame, v, o in zip(frames, values, out):
                    if last is not None and keys[lo] != last:
                        frame.end(o)
                    frame.feed(v[lo:hi], o)
                last = keys[lo]
            yield from ready()
        for frame, o in zip(frames, out):
            frame.end(o)
        yield from ready()

    sorted_ = own.repartition(*key_cols) if key_cols else own.coalesce(1)
    return sorted_.sortWithinPartitions(*key_cols, seq.order).mapInArrow(run, schema)


def local_residual(df: DataFrame, column: str, out: str, params: Params = Params(), seq: Sequence = Sequence()) -> DataFrame:
    """sequence.local_residual() of method "hampel" by sliding medians: for frames of hundreds of rows."""
    df = sliding_medians(df, {"_fit": column}, params.local_window // 2, seq, params.min_seq_len)
    return df.withColumn(out, finite(F.col(column).cast("double")) - F.col("_fit")).drop("_fit")


def robust_tangents(df: DataFrame, x: str, y: str, tx: str, ty: str, half: int = 3, seq: Sequence = Sequence()) -> DataFrame:
    """Adds the directions that sequence.step_normal() measures on: medians of tangents by component; the plain tangent in sequences below three rows."""
    df = unit_tangents(df, x, y, "_tx", "_ty", seq)
    df = sliding_medians(df, {"_mx": "_tx", "_my": "_ty"}, half, seq, 3)
    ux, uy = _unit(F.col("_mx"), F.col("_my"))
    return df.withColumns({tx: F.coalesce(ux, F.col("_tx")), ty: F.coalesce(uy, F.col("_ty"))}).drop("_tx", "_ty", "_mx", "_my")
