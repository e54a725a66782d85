"""Hand-checked values, missing values and argument errors."""

import json
import math

import pytest
from pyspark.sql import functions as F

from gaugewise.operators import convert, evaluate, score, sequence, stats, verdict
from gaugewise.operators.sequence import Sequence
from gaugewise.registry import BY_NAME, FEATURES, MetrologyError, Params, features_of

ONE = Sequence(("k",), "i")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def track(spark, points):
    return frame(spark, [(0, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "k int, i long, x double, y double")


def test_registry():
    assert len(FEATURES) == 60 and len(BY_NAME) == 60
    assert {f.name for f in features_of("l3", "bool")} == {"edge_valid_s", "edge_valid_e", "minside"}
    assert [f.name for f in FEATURES if not f.enabled] == ["curv_s", "curv_e"]


def test_units(spark):
    names = ["Å", "Å", "Å", "A", " angstrom ", "ANG", "nm", "Nanometre", "㎚", "ｎｍ", "px", None, ""]
    got = [r.u for r in frame(spark, [(n,) for n in names], "n string").select(convert.normalize_unit(F.col("n")).alias("u")).collect()]
    assert got == ["angstrom"] * 6 + ["nm"] * 4 + [None] * 3
    df = frame(spark, [(12.0, "Å"), (3.0, "nm")], "v double, u string")
    assert [round(r[0], 9) for r in df.select(convert.to_nm(F.col("v"), F.col("u"))).collect()] == [1.2, 3.0]
    with pytest.raises(MetrologyError, match="E-ARG-03.*None, px"):
        convert.require_known_units(frame(spark, [("px",), (None,), ("nm",)], "u string"), "u")


def test_coordinates(spark):
    df = frame(spark, [(10.0, 20.0)], "x double, y double")
    assert tuple(df.select(*convert.transform_coords(F.col("x"), F.col("y"), y_flip=True, height=100)).first()) == (10.0, 79.0)
    assert tuple(df.select(*convert.transform_coords(F.col("x"), F.col("y"), "rowcol", "one")).first()) == (19.0, 9.0)
    assert convert.transform_all(df, "x", "y", F.lit(100.0)).count() == 8
    with pytest.raises(MetrologyError, match="E-ARG-06"):
        convert.transform_coords(F.col("x"), F.col("y"), "polar")


def test_scale(spark):
    rows = [(0, 0.0, 0.0, 10.0, 0.0, 5.0), (0, 0.0, 0.0, 20.0, 0.0, 10.0), (0, 0.0, 0.0, 10.0, 0.0, float("nan")), (0, 0.0, 0.0, 0.0, 0.0, 3.0)]
    df = frame(spark, rows, "k int, sx double, sy double, ex double, ey double, v double")
    assert convert.infer_px_nm(df, "v", "k").first().px_nm == 0.5
    assert convert.ratio_cv(df, "v", "k").first().ratio_cv is None


def test_tangents_and_steps(spark):
    line = [(100 + 0.1 * t, 10 * t) for t in range(20)]
    bent = [(x + (4 if i == 9 else 0), y) for i, (x, y) in enumerate(line)]
    steps = [r.d for r in sequence.step_normal(track(spark, bent), "x", "y", "d", ONE).orderBy("i").collect()]
    assert steps[9] == pytest.approx(4, abs=0.01) and max(s for i, s in enumerate(steps) if i != 9) < 0.01
    for method in ("hampel", "robust_linear"):
        resid = [r.d for r in sequence.normal_residual(track(spark, bent), "x", "y", "d", Params(method=method), ONE).orderBy("i").collect()]
        assert abs(abs(resid[9]) - 4) < 0.6 and abs(resid[3]) < 0.1
    assert sequence.unit_tangents(track(spark, [(1, 1)]), "x", "y", "tx", "ty", ONE).select("tx", "ty").first() == (1.0, 0.0)
    assert sequence.step_normal(track(spark, [(1, 1)]), "x", "y", "d", ONE).first().d is None
    curv = [r.c for r in track(spark, [(0, 0), (1, 0), (2, 1)]).select("i", sequence.curvature("x", "y", ONE).alias("c")).orderBy("i").collect()]
    assert curv == [None, 1.0, None]


def test_residual_of_a_line_is_zero_and_short_sequences_have_none(spark):
    df = frame(spark, [(0, i, 3.0 * i + 1) for i in range(12)] + [(1, i, 1.0) for i in range(4)] + [(2, i, None if i == 3 else 2.0 * i) for i in range(8)], "k int, i long, v double")
    got = sequence.local_residual(df, "v", "r", Params(), ONE).collect()
    assert all(abs(r.r) < 1e-9 for r in got if r.k == 0 or (r.k == 2 and r.i != 3))
    assert all(r.r is None for r in got if r.k == 1 or (r.k == 2 and r.i == 3))


def test_circular(spark):
    df = frame(spark, [(a,) for a in (10.0, 12.0, 14.0)], "a double")
    assert df.agg(sequence.circular_median(F.col("a"))).first()[0] == pytest.approx(12)
    wrapped = frame(spark, [(a,) for a in (179.0, -179.0, 1.0)], "a double").agg(sequence.circular_median(F.col("a"))).first()[0]
    assert min(abs(wrapped), 180 - abs(wrapped)) < 1.5


def test_summary(spark):
    rows = [("a", "A", i, 30.0 + i, float(i), 0.0, 10.0 * i, 0.5) for i in range(5)] + [("b", "A", 0, 7.0, 1.0, 0.0, 0.0, 0.5), (None, "A", 0, 7.0, 1.0, 0.0, 0.0, 0.5)]
    df = frame(spark, rows, "image_id string, category_id string, cd_index long, cd_nm double, angle double, mid_x double, mid_y double, px_nm double")
    a, b = sequence.summarize(df).orderBy("image_id").collect()
    assert (a.n_cd, a.cd_median, a.cd_mad, a.pitch_median, a.span_nm) == (5, 32.0, 1.0, 5.0, 20.0)
    assert a.angle_median == pytest.approx(2) and a.angle_spread == pytest.approx(1)
    assert (b.n_cd, b.pitch_median, b.span_nm, b.delta_median_s) == (1, None, None, None)


def test_robust_stats(spark):
    values = [float(v) for v in range(20)] + [1000.0, float("nan"), float("inf"), None]
    df = frame(spark, [(0, v) for v in values] + [(1, 1.0), (1, 3.0)], "k int, v double")
    got = {r.k: r for r in stats.robust_stats(df, "v", "k").collect()}
    assert (got[0].n, got[0].median) == (21, 9.5) and got[0].mad == 5.0
    assert (got[1].n, got[1].median, got[1].mad) == (2, 2.0, 1.0)
    assert stats.robust_stats(df.limit(0), "v", "k").count() == 0


@pytest.mark.parametrize("together", [0, 1_000_000])
def test_robust_stats_against_numpy(spark, monkeypatch, together):
    """Both ways; cohorts that a task can't hold come from small tables alone, others from one exchange."""
    monkeypatch.setattr(stats, "TOGETHER", together)
    import random

    import numpy as np

    r = random.Random(4)
    rows = [(k, r.choice((r.gauss(0, 1), float(r.randint(0, 3)), r.gauss(50, 400)))) for k in (0, 1, None) for _ in range(600)] + [(2, r.gauss(0, 1)) for _ in range(9000)] + [(7, 2.0), (8, 1.0), (8, 5.0)] + [(9, 3.0)] * 40
    df = frame(spark, rows, "k int, v double")
    out = stats.robust_stats(df, "v", "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 if not together else plan.count("hashpartitioning") == 1 and plan.count("FileScan") == 1
    got = {x.k: x for x in out.collect()}
    for k in {k for k, _ in rows}:
        x = np.array([v for i, v in rows if i == k])
        n, med = len(x), np.median(x)
        mad = np.median(np.abs(x - med))
        if n >= 10:
            z = np.abs(x - med) / max(1.4826 * mad, 1e-12)
            x = x[z <= np.quantile(z, 0.95) + 1e-9]
            med = np.median(x)
            mad = np.median(np.abs(x - med))
        assert got[k].n == n and abs(got[k].median - med) < 1e-9 and abs(got[k].mad - mad) < 1e-9
    circle = stats.circular_stats(frame(spark, [(1, a) for a in (179.0, -179.0, 1.0)] + [(2, 10.0), (2, 14.0), (2, 12.0)], "k int, a double"), "a", "k").collect()
    assert {x.k: (round(x.angle_median, 6) % 180, round(x.angle_spread, 6)) for x in circle} == {1: (1.0, 0.0), 2: (12.0, 2.0)} or {x.k: round(x.angle_spread, 3) for x in circle}[2] == 2.0
    q = {"a": 0.0, "b": 0.31, "c": 1.0}
    got = {x.k: tuple(x)[2:] for x in stats.exact_quantiles(df, "v", q, "k").collect()}
    want = {x.k: tuple(x)[1:] for x in df.groupBy("k").agg(*[F.percentile("v", F.lit(p)) for p in q.values()]).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k], want[k]))
    assert stats.threshold_from_quantile(frame(spark, [(float(i),) for i in range(100)], "v double"), "v", 0.9).first().threshold == pytest.approx(89.1)


def test_stats_as_json_and_back(spark):
    rows = [("a", i, float(i), 1.0 if i % 3 else -1.0) for i in range(20)] + [(None, 1, None, 0.0), ("b", 2, 0.1 + 0.2, None)]
    df = frame(spark, rows, "k string, id int, cd_nm double, pol_s double")
    made = stats.cohort_stats(df, "k")
    texts = stats.stats_as_json(made, "k")
    assert texts.columns == ["k", "json"] and texts.count() == 3
    back = stats.stats_from_json(texts, "k")
    show = lambda d: sorted(map(str, d.select("k", "feature", "n", "median", "mad", "mode").collect()))
    assert show(back) == show(made)
    assert stats.stats_from_json(stats.stats_as_json(stats.cohort_stats(df))).count() == 2 and stats.stats_as_json(made.where("false"), "k").count() == 0
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        stats.stats_from_json(texts.withColumn("json", F.lit("{no")), "k").collect()


def test_a_rank_outside_its_bracket(spark, monkeypatch):
    """A sketch too coarse for its bracket: the key is done again, and nothing is lost."""
    monkeypatch.setattr(stats, "ACCURACY", 2)
    df = frame(spark, [(k, float((i * 7919) % 5003) ** 2) for k in (0, None) for i in range(9000)] + [(3, 1.0)], "k int, v double")
    got = {x.k: x.m for x in stats.by_brackets(df, "v", {"m": 0.37}, "k", reach=1e-3).collect()}
    want = {x.k: x.m for x in df.groupBy("k").agg(F.percentile("v", F.lit(0.37)).alias("m")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_mode_and_cohorts(spark):
    df = frame(spark, [(0, 1.0), (0, -1.0), (0, 0.0), (1, 0.0), (2, -1.0)], "k int, p double")
    assert {r.k: r.m for r in df.groupBy("k").agg(stats.mode_sign(F.col("p")).alias("m")).collect()} == {0: 1.0, 1: 0.0, 2: -1.0}
    df = frame(spark, [("A", float(i), 1.0, i != 3) for i in range(12)], "c string, cd_nm double, pol_s double, edge_valid_s boolean")
    table = stats.cohort_stats(df, "c")
    assert {(r.feature, r.n, r.mode) for r in table.collect()} == {("cd_nm", 12, None), ("pol_s", 12, 1.0)}
    plain = stats.stats_to_json(table)
    assert json.loads(json.dumps(plain)) == plain
    with pytest.raises(MetrologyError, match="E-ARG-05"):
        stats.cohort_stats(df, "c", features=["nothing"])


def test_scores(spark):
    base = frame(spark, [(10.0, 1.0)] * 20, "cnr_s double, pol_s double")
    table = stats.cohort_stats(base)
    df = frame(spark, [(10.0 - 4e-6, -1.0, False), (None, 0.0, None)], "cnr_s double, pol_s double, edge_valid_s boolean")
    a, b = score.top_feature(score.apply_z(df, table)).collect()
    assert a.z_cnr_s == pytest.approx(4.0) and a.z_pol_s == 4.0 and a.z_edge_valid_s == 4.0
    assert (b.z_cnr_s, b.z_pol_s, b.z_edge_valid_s) == (None, 0.0, 0.0)
    assert a.reason_code == "EVIDENCE_WEAK" and "zs_cnr_s" not in df.columns


def test_top_feature(spark):
    df = frame(spark, [(1.0, 5.0, 5.0), (None, None, float("inf")), (None, None, None)], "z_cnr_s double, z_cd_nm double, z_s_resid double")
    got = [tuple(r)[3:] for r in score.top_feature(df).collect()]
    assert got == [(5.0, "cd_nm", "GEOMETRY_ODD"), (None, "", ""), (None, "", "")]
    assert score.top_feature(df, ["s_resid", "cd_nm"]).first().top_feature == "s_resid"
    with pytest.raises(MetrologyError, match="E-ARG-04"):
        score.top_feature(df, ["angle"])


def test_impact_and_runs(spark):
    rows = [("a", 0, 10.0, False), ("a", 1, 10.0, False), ("a", 2, 20.0, True), ("a", 3, 20.0, True), ("b", 0, 1.0, False), ("c", 0, 1.0, True)]
    df = frame(spark, rows, "k string, i long, cd double, f boolean")
    assert {r.k: r.impact_nm for r in verdict.impact_nm(df, "cd", "f", "k").collect()} == {"a": 5.0, "b": 0.0, "c": math.inf}
    assert {r.k: r.max_run for r in verdict.max_run(df, "f", ONE).collect()} == {"a": 2, "b": 0, "c": 1}
    with pytest.raises(MetrologyError, match="E-ARG-06"):
        verdict.impact_nm(df, "cd", "f", "k", stat="mode")


def test_histograms(spark):
    df = frame(spark, [("a", 0), ("a", 0), ("b", 0), ("b", 3)], "image_id string, v int")
    h = verdict.histogram(df, "v", "image_id")
    t = spark.createDataFrame([(0, 1.0)], "bin int, share double")
    assert {r.image_id: r.hist_emd for r in verdict.hist_emd(h, t, "image_id", bins=4).collect()} == {"a": 0.0, "b": 1.5}
    row = frame(spark, [([0.5, 0.5, 0.0], [0.0, 0.5, 0.5])], "h array<double>, t array<double>")
    assert row.select(verdict.hist_distance(F.col("h"), F.col("t"))).first()[0] == pytest.approx(1.0)


def test_recall(spark):
    rows = [(float(v), False) for v in range(100)] + [(50.0, True), (96.0, True), (98.0, True), (float("nan"), True)]
    r = evaluate.recall_at_fpr(frame(spark, rows, "s double, bad boolean"), "s", "bad").first()
    assert r.threshold == pytest.approx(94.05) and r.recall == pytest.approx(2 / 3) and r.fpr_actual == pytest.approx(0.05)
    assert (r.n_bad, r.n_good, r.n_nan) == (3, 100, 1)


def test_localization(spark):
    rows = [("a", 0, 9.0, True), ("a", 1, 1.0, False), ("b", 0, 1.0, True), ("b", 1, 5.0, False), ("c", 0, 1.0, False)]
    hits = evaluate.localization(frame(spark, rows, "k string, i long, s double, t boolean"), "s", "t", "i", "k")
    assert evaluate.localization_rate(hits).first()[:2] == (0.5, 2)
    df = frame(spark, [([1, 2, 3], [3]), ([1], None)], "p array<int>, t array<int>")
    assert [r[0] for r in df.select(evaluate.localization_hit(F.col("p"), F.col("t"), 3)).collect()] == [True, False]


def test_streaming(spark, tmp_path):
    from gaugewise.streaming import scoring

    base = frame(spark, [("A", float(i)) for i in range(20)], "c string, cd_nm double")
    table = stats.cohort_stats(base, "c").cache()
    rows = frame(spark, [("A", 9.5, "2024-01-01 00:00:00"), ("A", 500.0, "2024-01-01 00:01:00"), ("A", 600.0, "2024-01-01 00:02:00")], "c string, cd_nm double, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    runs = scoring.flagged_runs(scoring.score_stream(stream, table, "c", features=["cd_nm"]), 3.0, "t", "c")
    q = runs.writeStream.format("memory").queryName("runs").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [r.n_flagged for r in spark.table("runs").collect()] == [2]
