"""Checks in the same job as the work: good rows and rejected ones in one written table, counts by code on the way."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gaugewise.operators.convert import finite, normalize_unit
from gaugewise.registry import ERROR_CODES, MetrologyError
from gaugewise.sources.tables import shared_dir


@dataclass(frozen=True)
class Rule:
    """Rows that break it are rejected under its code; detail is what is told about a row."""

    code: str
    broken: Column
    detail: Column


def whole_ends(*pairs: tuple[str, str]) -> Rule:
    """E-ARG-01: some of the coordinates are there and others are not (null), by default those of both ends."""
    columns = [F.col(c) for pair in pairs or (("sx", "sy"), ("ex", "ey")) for c in pair]
    there = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    return Rule("E-ARG-01", (there > 0) & (there < len(columns)), F.concat(there.cast("string"), F.lit(f" of {len(columns)} coordinates")))


def some_ends(*columns: str) -> Rule:
    """E-ARG-04: no coordinate is there at all."""
    names = columns or ("sx", "sy", "ex", "ey")
    return Rule("E-ARG-04", F.coalesce(*[F.col(c).cast("double") for c in names]).isNull(), F.lit("no coordinates"))


def known_unit(unit: str) -> Rule:
    """E-ARG-03: the unit is neither of the known ones; told is the unit."""
    return Rule("E-ARG-03", normalize_unit(F.col(unit).cast("string")).isNull(), F.coalesce(F.col(unit).cast("string"), F.lit("None")))


def positive(column: str) -> Rule:
    """E-ARG-06: not a finite number above 0."""
    return Rule("E-ARG-06", ~F.coalesce(finite(F.col(column).cast("double")) > 0, F.lit(False)), F.concat(F.lit(f"{column} "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))


@dataclass(frozen=True)
class Validated:
    """good: rows without fault, with the columns they came with. rejected: the others, with `code` and `detail` first. counts: rows by code, "ok" for good ones."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int] = field(default_factory=dict)

    def details(self, code: str) -> list[str]:
        """What was told under a code, sorted and each once: for E-ARG-03 all unknown units. Reads rejected rows alone."""
        return sorted(r[0] for r in self.rejected.where(F.col("code") == code).select("detail").distinct().collect())

    def require(self) -> DataFrame:
        """The good rows if all are; else an error with the first code, its details and how many rows there are."""
        bad = sorted(c for c, n in self.counts.items() if c != "ok" and n)
        if bad:
            raise MetrologyError(bad[0], f"{self.counts[bad[0]]} rows: {', '.join(map(repr, self.details(bad[0])))}")
        return self.good


def validated(df: DataFrame, *rules: Rule, path: str | None = None) -> Validated:
    """df by rules in one job: a row is rejected under the first rule it breaks.

    df is computed once and written to a new folder (path, or one in the shared folder), parted into good and rejected
    rows; a metric that Spark gathers along the way counts rows by code. Reading either part touches its files alone.
    An empty table has no good and no rejected rows.
    """
    if wrong := sorted({r.code for r in rules} - ERROR_CODES.keys()):
        raise MetrologyError("E-ARG-06", ", ".join(wrong))
    clash = [c for c in df.columns if c.lower() in ("code", "detail", "_row", "_rejected")]
    path = path or f"{shared_dir(df.sparkSession)}/validated-{uuid.uuid4().hex}"
    broken = [F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.code).alias("code"), r.detail.alias("detail"))) for r in rules]
    fault = F.coalesce(*broken) if broken else F.lit(None).cast("struct<code:string,detail:string>")
    rows = df.select(fault.alias("_fault"), F.struct(*df.columns).alias("_row"))
    seen = Observation()
    codes = sorted({r.code for r in rules})
    observed = rows.observe(seen, F.count("*").alias("rows"), *[F.count_if(F.col("_fault.code") == c).alias(c) for c in codes])
    out = observed.select("_fault.code", "_fault.detail", "_row", F.col("_fault").isNotNull().alias("_rejected"))
    out.write.partitionBy("_rejected").parquet(path)
    counts = dict(seen.get)
    total = counts.pop("rows")
    back = df.sparkSession.read.schema(out.schema).parquet(path)
    good = back.where("not _rejected").select("_row.*")
    rejected = back.where("_rejected")
    rejected = rejected.select("code", "detail", "_row") if clash else rejected.select("code", "detail", "_row.*")
    return Validated(good, rejected, {"ok": total - sum(counts.values())} | counts)


def without_values(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, rows, code (E-ARG-04): the keys of which no row has a finite value, which statistics leave out."""
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(finite(F.col(value).cast("double"))).alias("_there"))
    return out.where("_there = 0").select(*keys, "rows", F.lit("E-ARG-04").alias("code"))
