"""Streams give what the batch form gives, and late rows are left out."""

from datetime import datetime, timedelta

from lumenfold.streaming import intake

FILE = "media_id long, device_id int, source_path string, size_bytes long, modified_at timestamp, ingested_at timestamp"
T0 = datetime(2026, 1, 1)


def rows(*items):
    return [(i, 1, f"/a/{i}.JPG" if i % 2 else f"/a/{i}.mov", 10, T0 + timedelta(seconds=s), T0 + timedelta(days=d)) for i, d, s in items]


def write(spark, folder, items):
    spark.createDataFrame(rows(*items), FILE).coalesce(1).write.mode("append").parquet(str(folder))


def test_counts_of_windows_leave_late_rows_out(spark, tmp_path):
    write(spark, tmp_path, [(1, 0, 0), (2, 0, 10), (3, 1, 0), (1, 0, 0)])
    write(spark, tmp_path, [(5, 30, 0)])
    write(spark, tmp_path, [(11, 31, 0)])  # late rows are judged by the watermark of the batch before
    write(spark, tmp_path, [(7, 0, 0), (9, 60, 0)])  # the first is 30 days late
    stream = intake.read_stream(spark, str(tmp_path), FILE)
    once = intake.first_deliveries(intake.classified(stream))
    got = intake.run_once(intake.window_counts(once, late=None), "counted")
    found = {(r["window_start"].day, r["classification"]): r["n"] for r in got.collect() if r["window_start"].month == 1}
    assert found[(1, "photo")] == 1 and found[(1, "non_photo")] == 1 and found[(2, "photo")] == 1
    batch = intake.window_counts(intake.classified(spark.read.schema(FILE).parquet(str(tmp_path)).dropDuplicates(["media_id"])))
    assert batch.agg({"n": "sum"}).first()[0] == 7


def test_sessions(spark):
    df = spark.createDataFrame(rows((1, 0, 0), (2, 0, 100), (3, 0, 500)), FILE)
    assert sorted(r["files"] for r in intake.device_sessions(df).collect()) == [1, 2]
