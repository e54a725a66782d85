"""Vector codes: each part of a vector as the number of its nearest codebook entry, by integers alone.

Distances are taken between Walsh-Hadamard transforms. With W values a part (a power of two, zeros behind), the
transform only adds and subtracts, and squared differences of transforms sum to W times the squared distance. They
are summed in order of sequency, slow patterns first; an entry leaves as soon as its sum exceeds the whole sum of
some other entry, so what stays is exact, ties included.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewise.llm.common import arrow_of, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that meet all entries at a time, coefficients between two eliminations, and the share of pairs left at which pairs are listed one by one.
TOGETHER, STEP, LISTED = 512, 4, 0.25
#: Sums beyond a long travel as so many longs of so many bits.
LIMBS, LIMB_BITS = 5, 40
LONGEST = 2**63 - 1


def sequency(width: int) -> np.ndarray:
    """Rows of the Hadamard matrix in natural order, sorted by their changes of sign: the reversed bits of Gray codes."""
    bits = width.bit_length() - 1
    return np.array([int(f"{i ^ i >> 1:0{bits}b}"[::-1], 2) if bits else 0 for i in range(width)])


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows, in order of sequency; rows get zeros up to a power of two."""
    n, w = x.shape
    width = 1 << max(w - 1, 0).bit_length()
    out = np.zeros((n, width), x.dtype)
    out[:, :w] = x
    half = 1
    while half < width:
        pairs = out.reshape(n, width // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        half *= 2
    return out[:, sequency(width)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the entries for each row (the first of equals), and W times its squared distance; both sides are transforms."""
    codes, sums = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    columns, width = np.ascontiguousarray(entries.T), x.shape[1]
    for lo in range(0, len(x), TOGETHER):
        rows = x[lo : lo + TOGETHER]
        so_far, apart, bound = np.zeros((len(rows), len(entries)), x.dtype), None, None
        for j in range(width):
            apart = np.subtract(rows[:, j, None], columns[j], out=apart)
            np.multiply(apart, apart, out=apart)
            so_far += apart
            if (j + 1) % STEP == 0 and j + 1 < width:
                some = rows - entries[so_far.argmin(1)]
                whole = (some * some).sum(1)
                bound = whole if bound is None else np.minimum(bound, whole)
                left = so_far <= bound[:, None]
                if np.count_nonzero(left) <= LISTED * left.size:
                    codes[lo : lo + len(rows)], sums[lo : lo + len(rows)] = _listed(rows, entries, so_far, left, bound, j + 1)
                    break
        else:
            codes[lo : lo + len(rows)] = so_far.argmin(1)
            sums[lo : lo + len(rows)] = so_far.min(1)
    return codes, sums


def _listed(rows: np.ndarray, entries: np.ndarray, so_far: np.ndarray, left: np.ndarray, bound: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """nearest() for one block from coefficient `start` on, over the pairs that are left."""
    row, entry = np.nonzero(left)
    sums = so_far[row, entry]
    for j in range(start, rows.shape[1], STEP):
        apart = rows[row, j : j + STEP] - entries[entry, j : j + STEP]
        sums = sums + (apart * apart).sum(1)
        stays = sums <= bound[row]
        row, entry, sums = row[stays], entry[stays], sums[stays]
    least = np.minimum.reduceat(sums, np.flatnonzero(np.diff(row, prepend=-1)))  # some entry of every row stays: the bound is the sum of one
    first = np.flatnonzero(sums == least[row])
    _, at = np.unique(row[first], return_index=True)  # entries ascend within a row
    return entry[first[at]], least


def _integers(values: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x). Doubles of 2**53 and more are whole, and scaling by a power of two loses nothing below."""
    if not wide:
        return np.floor(values * float(SCALE)).astype(np.int64)
    return np.array([int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in values.tolist()], object)


@dataclass(frozen=True)
class Shape:
    """Values of a part, and whether longs could overflow (then Python's integers are used)."""

    parts: int
    width: int
    wide: bool

    def split(self, lists: pa.Array) -> np.ndarray:
        """A column of vectors as integers: rows, parts, values; short vectors get zeros behind."""
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        values = _integers(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), self.wide)
        out = np.zeros((len(lists), self.parts * self.width), values.dtype)
        out[np.arange(out.shape[1]) < lengths[:, None]] = values
        return out.reshape(len(lists), self.parts, self.width)


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, vector of the rows whose vector is there and all finite."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(math.inf)))
    return df.where(F.col(vector_col).isNotNull()).where(finite).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))


def shape_of(kept: DataFrame, parts: int) -> Shape:
    """One pass: the longest vector, the largest component and the number of rows."""
    size, most, n = kept.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))), F.count("*")).first()
    width = -(-(size or 0) // parts)
    padded, largest = 1 << max(width - 1, 0).bit_length(), int(most or 0) * SCALE + SCALE
    return Shape(parts, width, max((2 * largest * padded) ** 2, n * largest) >= 2**62)


def first_entries(kept: DataFrame, shape: Shape, entries: int) -> np.ndarray:
    """parts, entries, values: the parts of the rows with the smallest vec_id (null last, then by vector). At most `entries` rows reach the driver."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    kind = arrow_of(kept.schema["vector"].dataType)
    return shape.split(pa.array([r.vector for r in rows], kind)).transpose(1, 0, 2)


def _coded(vectors: pa.Array, shape: Shape, codebooks: np.ndarray, spectra: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer parts, codes (rows, parts) and squared distances (rows, parts)."""
    x = shape.split(vectors)
    found = [nearest(transformed(x[:, p]), spectra[p]) for p in range(shape.parts)]
    padded = spectra[0].shape[1]
    return x, np.stack([c for c, _ in found], 1), np.stack([s // padded for _, s in found], 1)


def refined(kept: DataFrame, shape: Shape, codebooks: np.ndarray) -> np.ndarray:
    """One round: parts go to their nearest entries, and each entry becomes the floor of its parts' mean; unused ones stay.

    A task sends one row of sums for an entry and part at most, and the driver gets as many in all.
    """
    limbs = LIMBS if shape.wide else 1
    entries = codebooks.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectra = [transformed(c) for c in codebooks]
        sums, counts = np.zeros_like(codebooks), np.zeros((shape.parts, entries), np.int64)
        for batch in batches:
            x, codes, _ = _coded(batch.column(0), shape, codebooks, spectra)
            for p in range(shape.parts):
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        rest, lists = sums[part, entry], []
        for k in range(limbs):
            lists.append(rest if k == limbs - 1 else rest & ((1 << LIMB_BITS) - 1))
            rest = rest >> LIMB_BITS
        flat = np.concatenate(lists, 1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(flat), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    told = kept.select("vector").mapInArrow(run, "part int, entry int, n long, s array<long>")
    summed = told.groupBy("part", "entry").agg(F.sum("n"), *(F.sum(F.col("s")[k]) for k in range(limbs * shape.width)))
    out = codebooks.copy()
    for part, entry, n, *s in summed.collect():
        for k in range(shape.width):
            out[part, entry, k] = sum(s[i * shape.width + k] << LIMB_BITS * i for i in range(limbs)) // n
    return out


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Shape, np.ndarray]:
    """Codebooks (parts, entries, values) of the rows of kept_vectors(); they and what the driver gets have a size fixed by the arguments and the vectors' length."""
    shape = shape_of(kept, parts)
    codebooks = first_entries(kept, shape, entries)
    for _ in range(rounds if codebooks.size else 0):
        codebooks = refined(kept, shape, codebooks)
    return shape, codebooks


def encode(kept: DataFrame, shape: Shape, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code, error for the rows of kept_vectors()."""
    schema = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectra = [transformed(c) for c in codebooks]
        digits = [f"{i:02x}" for i in range(codebooks.shape[1])]
        for batch in batches:
            _, codes, errors = _coded(batch.column("vector"), shape, codebooks, spectra)
            told = ["".join(map(digits.__getitem__, c)) for c in codes.tolist()]
            error = [min(int(e), LONGEST) for e in errors.sum(1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(told, pa.string()), pa.array(error, pa.int64())], schema.names)

    return kept.mapInArrow(run, schema)


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def decode(codes: DataFrame, codebooks: np.ndarray, code_col: str = "code") -> DataFrame:
    """codes with a column `approximation`: the vector that the code stands for, unscaled. Null codes give null."""
    books = F.lit([[[float(v) / SCALE for v in entry] for entry in part] for part in codebooks.tolist()])
    number = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximation", F.flatten(F.array(*(books[p][number(p)] for p in range(len(codebooks))))))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept row of df: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components go. Vectors are cut into `parts` equal parts;
    shorter ones, and the empty one, count as having zeros behind, up to the longest vector's length and a multiple
    of `parts`. Very long vectors only make codebooks longer. A null vec_id counts as the largest; rows of one vec_id
    are ordered by their vectors, repeated ones make repeated entries, and every row has its row in the result. Of
    entries equally near the first is taken. With fewer rows than entries each row makes one; an empty table gives an
    empty one. Rows of equal label share label_error, null labels too. An error above the largest long is the largest
    long. Other columns of df are not looked at.
    """
    kept = written(kept_vectors(df, id_col, vector_col, label_col), "vector-kept")
    shape, codebooks = fit(kept, parts, entries, rounds)
    coded = written(encode(kept, shape, codebooks), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    totals = written(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"), "vector-labels")  # Spark broadcasts it where it is small
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
