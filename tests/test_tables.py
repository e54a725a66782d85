"""Validation in one job, statistics as they were at a time, kept sketches, spellings of units."""

import datetime
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewise.operators import asof, convert, sketches, validate
from gaugewise.registry import MetrologyError

MEASURED = "id int, sx double, sy double, ex double, ey double, unit string, px_nm double, detail string"


def measured(spark):
    ok = (1.0, 2.0, 3.0, 4.0)
    rows = [
        (1, *ok, "nm", 0.5, "x"), (2, *ok, "inch", 0.5, "x"), (3, *ok, None, 0.5, "x"), (4, *ok, "Å", 0.0, "x"), (5, *ok, "nm", math.nan, "x"), (6, 1.0, None, 3.0, 4.0, "px", 0.5, "x"),
        (7, None, None, None, None, "nm", 0.5, "x"), (8, *ok, "inch", None, "x"), (9, *ok, "ångström", 0.5, "x"), (10, *ok, "Nanometre ", 1e300, "x"), (11, *ok, "nm", None, "x"), (12, *ok, "nm", math.inf, "x"),
    ]
    return spark.createDataFrame(rows, MEASURED).repartition(3)


def rules():
    return validate.some_ends(), validate.whole_ends(), validate.known_unit("unit"), validate.positive("px_nm")


def test_validation(spark):
    df = measured(spark)
    got = validate.validated(df, *rules())
    assert got.counts == {"ok": 2, "E-ARG-01": 1, "E-ARG-03": 4, "E-ARG-04": 1, "E-ARG-06": 4}
    assert {r.id for r in got.good.collect()} == {1, 10} and got.good.columns == df.columns
    assert {r["_row"].id: r.code for r in got.rejected.collect()} == {2: "E-ARG-03", 3: "E-ARG-03", 4: "E-ARG-06", 5: "E-ARG-06", 6: "E-ARG-01", 7: "E-ARG-04", 8: "E-ARG-03", 9: "E-ARG-03", 11: "E-ARG-06", 12: "E-ARG-06"}
    assert got.details("E-ARG-03") == ["None", "inch", "ångström"]
    with pytest.raises(MetrologyError, match="E-ARG-01"):
        got.require()
    plain = validate.validated(df.drop("detail"), *rules())
    assert plain.rejected.columns == ["code", "detail", *df.drop("detail").columns]
    clean = validate.validated(got.good, *rules())
    assert clean.require().count() == 2 and clean.rejected.count() == 0
    nothing = validate.validated(df.where("false"), *rules())
    assert nothing.counts["ok"] == 0 and nothing.good.count() == 0 and nothing.require().columns == df.columns
    assert validate.validated(df).counts == {"ok": 12}
    with pytest.raises(MetrologyError, match="E-ARG-06"):
        validate.validated(df, validate.Rule("E-ARG-99", F.lit(True), F.lit("")))


def test_validation_is_one_job(spark):
    """The table is computed once: a count of rows that were made says so."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    df = measured(spark).mapInArrow(count, MEASURED)
    got = validate.validated(df, *rules())
    got.good.count(), got.rejected.count(), got.details("E-ARG-03")
    assert made.value == 12
    assert "PartitionFilters: [isnotnull(_rejected" in got.good._jdf.queryExecution().executedPlan().toString()


def test_keys_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", math.nan), ("b", math.inf), (None, None)], "k string, v double")
    assert {(r.k, r.rows, r.code) for r in validate.without_values(df, "v", "k").collect()} == {("b", 2, "E-ARG-04"), (None, 1, "E-ARG-04")}


def test_as_of(spark):
    """Against a loop: ties, times between days, a key with most rows, nulls, columns of one name, nothing."""
    r = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    when = lambda: start + datetime.timedelta(hours=r.randrange(0, 24 * 9, 3))
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), when() if r.random() < 0.95 else None, r.random()) for i in range(400)]
    held = [(r.choice(["a", "b", None, "z"]), when(), r.random(), k) for k in range(40)] + [("a", start, 0.5, None), ("a", start, 0.7, 3), ("b", None, 9.0, 9)]
    m = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, v double").repartition(4)
    s = spark.createDataFrame(held, "k string, since timestamp_ntz, v double, n int")
    for slices in ("day", "year", "hour"):
        got = {x.id: (x.since, x.v_version, x.n) for x in asof.as_of(m, s, "ts", "since", "k", slices=slices).collect()}
        assert len(got) == len(rows)
        for i, k, t, _ in rows:
            known = [(since, (v, n)) for key, since, v, n in held if key == k and since is not None and t is not None and since <= t]
            best = max(known, key=lambda x: (x[0], x[1][0], -1 if x[1][1] is None else x[1][1]), default=None)
            assert got[i] == ((best[0], *best[1]) if best else (None, None, None))
    assert asof.as_of(m, s.where("false"), "ts", "since", "k").where("n is not null").count() == 0 and asof.as_of(m.where("false"), s, "ts", "since", "k").count() == 0


def test_sketches(spark, tmp_path):
    """Batches added one by one, merged in any order: counts are exact, quantiles are within the stated rank error."""
    r = np.random.default_rng(7)
    values = {(k, f): (r.lognormal(0, 2, 6000) if k else r.integers(0, 5, 6000).astype(float)) for k in (0, 1) for f in "xy"}
    rows = [(k, float(values[k, "x"][i]), float(values[k, "y"][i]) if i % 100 else math.nan) for k in (0, 1) for i in range(6000)] + [(2, None, 1.0), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(5)
    path = str(tmp_path / "kept")
    for part in df.randomSplit([0.2, 0.5, 0.3], seed=1):
        sketches.add_batch(path, part, "k", features=["x", "y"])
    wanted = {"low": 0.0, "q": 0.25, "m": 0.5, "high": 0.99}
    parts = [sketches.sketched(p, "k", features=["x", "y"]) for p in df.randomSplit([0.5, 0.5], seed=2)]
    for found in (sketches.stored(spark, path), sketches.merged(*parts), sketches.merged(*parts[::-1])):
        got = {(x.k, x.feature): x for x in sketches.quantiles(found, wanted).collect()}
        assert got.keys() == {*values, (2, "y"), (None, "x")}
        assert got[2, "y"].m == 1.0 and got[0, "x"].n == 6000 and got[0, "y"].n == 5940
        for key, v in values.items():
            v = np.sort(v if key[1] == "x" else np.delete(v, np.arange(0, 6000, 100)))
            for name, q in wanted.items():
                x = got[key][name]
                below, upto = np.searchsorted(v, x, "left") / len(v), np.searchsorted(v, x, "right") / len(v)
                assert below - 2 * sketches.rank_error() <= q <= upto + 2 * sketches.rank_error()
                exact = np.quantile(v, q)
                assert got[key][f"{name}_low"] <= exact <= got[key][f"{name}_high"]
    exact = {x.k: x.m for x in sketches.refined(df, {"m": 0.5}, "k", feature="x").collect()}
    assert exact[1] == pytest.approx(np.median(values[1, "x"]))
    with pytest.raises(MetrologyError, match="E-ARG-06"):
        sketches.quantiles(parts[0], {"m": 1.5})


def test_every_spelling_of_units(spark):
    """All characters of Unicode that can stand for one of the accepted spellings, in place of it and around it."""
    tokens = (*convert.ANGSTROM, *convert.NM)
    plain = lambda s: unicodedata.normalize("NFKC", s.strip()).lower()
    want = lambda s: "angstrom" if plain(s) in convert.ANGSTROM else "nm" if plain(s) in convert.NM else None
    tried = set()
    for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]):
        form = unicodedata.normalize("NFKC", c)
        if form.lower() in ("n", "m", "a", "å", "nm") or c.isspace():
            tried |= {f"{c}m", f"n{c}", f"{c}ng", c, f"{c}nm{c}", f" {c}"}
        elif form != c and any(form.lower() in t for t in tokens):
            tried |= {t.replace(form.lower(), c) for t in tokens} | {c}
    tried |= {"Å", "å", "Ａ̊", "Å̊", "n m", "nm.", "", "Å", "ǺA", "ANGSTROM"}
    assert len(tried) > 1500
    got = spark.createDataFrame([(t,) for t in sorted(tried)], "u string").withColumn("n", convert.normalize_unit(F.col("u"))).collect()
    assert {r.u: r.n for r in got} == {t: want(t) for t in tried}
