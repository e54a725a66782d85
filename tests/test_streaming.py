"""Streams against the batch's rows: out of order, twice, late, restarted."""

import random

import pytest
from pyspark.sql import functions as F

from gaugewise.operators import sequence, verdict
from gaugewise.operators.sequence import Sequence
from gaugewise.streaming import sequences

COLUMNS = "image_id int, category_id int, cd_index long, ts timestamp, n int, cd_nm double, angle double, mid_x double, mid_y double, px_nm double, s_resid double, flag boolean"


def rows_of(n_images=4):
    import datetime

    r = random.Random(2)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    out = []
    for i in range(n_images):
        for c in range(2):
            n = r.randrange(1, 9)
            for k in range(n):
                cd = float("nan") if r.random() < 0.1 else r.gauss(20, 1)
                out.append((i, c, k, start + datetime.timedelta(seconds=600 * i + 20 * k), n, cd, r.uniform(-90, 90), 10.0 * k, r.random(), 0.5, None if r.random() < 0.2 else r.gauss(0, 1), r.random() < 0.5))
    return out, start


def stream(spark, folder):
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, tmp_path):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def compare(spark, got, rows):
    batch = spark.createDataFrame(rows, COLUMNS)
    want = sequence.summarize(batch).join(verdict.max_run(batch, "flag", Sequence()), ["image_id", "category_id"])
    names = [c for c in ("n_cd", *sequences.SUMMARY, "max_run")]
    got = {(r.image_id, r.category_id): r for r in got}
    want = {(r.image_id, r.category_id): r for r in want.collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        for c in names:
            g = got[key][c]
            assert (g is None or g != g) if w[c] is None else g == pytest.approx(w[c], abs=1e-9), (key, c)


def test_sequences_end_by_count(spark, tmp_path):
    """Rows out of order and twice, the stream stopped and started again between files."""
    rows, _ = rows_of()
    mixed = rows + rows[::3]
    random.Random(3).shuffle(mixed)
    folder = str(tmp_path / "in")
    for part in (mixed[: len(mixed) // 2], mixed[len(mixed) // 2 :]):
        spark.createDataFrame(part, COLUMNS).repartition(2).write.mode("append").parquet(folder)
        run(sequences.completed_sequences(stream(spark, folder), "ts", expected="n", gap=3600, late="2 hours"), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert all(r.complete for r in got)
    compare(spark, got, rows)


def test_sequences_time_out(spark, tmp_path):
    """No count: a sequence ends when the watermark is past its gap; a row that is late is left out."""
    import datetime

    rows, start = rows_of()
    folder = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame([r for r in rows if r[0] == i][::-1], COLUMNS).coalesce(1).write.mode("append").parquet(folder)
        run(sequences.completed_sequences(stream(spark, folder), "ts", gap=300, late="1 minutes"), tmp_path)
    end = (9, 9, 0, start + datetime.timedelta(days=1), 1, 1.0, 0.0, 0.0, 0.0, 0.5, 0.0, False)
    late = (0, 0, 99, start, 1, 1.0, 0.0, 0.0, 0.0, 0.5, 0.0, True)
    for row in (end, late, (*end[:3], end[3] + datetime.timedelta(seconds=1), *end[4:])):
        spark.createDataFrame([row], COLUMNS).coalesce(1).write.mode("append").parquet(folder)
        run(sequences.completed_sequences(stream(spark, folder), "ts", gap=300, late="1 minutes"), tmp_path)
    got = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.image_id != 9]
    assert not any(r.complete for r in got)
    compare(spark, got, rows)
