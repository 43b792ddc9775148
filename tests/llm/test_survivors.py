"""Survivors on literal groups."""

from lumenfold.llm import survivors as S

ROW = "record_id long, asset_key string, relative_path string, captured_at string, timestamp_source string, blur_score double, n long"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW).selectExpr("* except (n)", "timestamp_seconds(n) recorded_at", "1 as rid", "2 as field", "3 as value")


def got(spark, rows, **kw):
    return {r["asset_key"]: r for r in S.surviving_members(frame(spark, rows), **kw).collect()}


def test_each_field_from_its_best_record(spark):
    rows = [
        (1, " a1", "p1", "2024-01-01T10:00:00", "mtime", 5.0, 100), (2, "A1\t", " \t", "2024-01-02T10:00:00", " EXIF ", float("nan"), 1), (3, "a1", "p3", "2024-02-30T10:00:00", "exif", 9.0, 50), (4, "a1", None, None, None, -1.0, 200),
        (5, "single", "p", None, None, 1.0, 1), (5, "SINGLE", "p", None, None, 1.0, 1),
        (6, "b", "", "unknown", "exif", None, 1), (7, "b", None, "", None, float("inf"), 2), (8, None, "p", None, None, 1.0, 1), (9, "  ", "p", None, None, 1.0, 1), (10, " ", "p", None, None, 1.0, 1), (None, "a1", "zz", "2030-01-01T00:00:00", "exif", 99.0, 999),
    ]
    r = got(spark, rows)
    assert set(r) == {"A1", "B"}
    assert (r["A1"]["blur_record_id"], r["A1"]["captured_record_id"], r["A1"]["path_record_id"], r["A1"]["path_value"]) == (3, 2, 1, "p1")
    assert (r["B"]["blur_record_id"], r["B"]["captured_record_id"], r["B"]["path_record_id"], r["B"]["path_value"]) == (-1, -1, -1, None)


def test_ties_and_null_times(spark):
    rows = [(9, "k", "b", "2024-01-01T10:00:00", "exif", 5.0, None), (4, "k", "a", "2024-01-01T10:00:01", "exif", 5.0, None), (7, "k", "c", "2024-01-01T10:00:01", "other", 5.0, 3), (7, "k", "c", "2024-01-01T10:00:01", "other", 5.0, 3)]
    r = got(spark, rows)["K"]
    assert (r["blur_record_id"], r["captured_record_id"], r["path_record_id"]) == (4, 4, 7)


def test_summed_votes_can_outweigh_one_record(spark):
    rows = [(1, "k", "old", None, None, None, 86_400), (2, "k", "old", None, None, None, 86_400), (3, "k", "new", None, None, None, 2 * 86_400)]
    assert got(spark, rows)["K"]["path_record_id"] == 3
    r = got(spark, rows, half_life_days=30.0)["K"]
    assert r["path_value"] == "old" and r["path_record_id"] == 1 and 0.6 < r["path_support"] < 0.7
    assert got(spark, rows, half_life_days=0.2)["K"]["path_value"] == "new"


def test_votes_for_a_blur_score_are_counted(spark):
    rows = [(1, "k", None, None, None, 5.0, 1), (2, "k", None, None, None, 5.0, 2), (3, "k", None, None, None, 90.0, 3)]
    assert got(spark, rows)["K"]["blur_record_id"] == 3
    r = got(spark, rows, half_life_days=30.0)["K"]
    assert (r["blur_record_id"], r["blur_value"]) == (1, "5.0") and abs(r["blur_support"] - 2 / 3) < 1e-9


def test_spellings_of_a_value_share_their_votes(spark):
    day = 86_400
    rows = [
        (1, "k", " p/a ", "2024-01-01T10:00", "exif", None, day), (2, "k", "p/a", "2024-01-01 10:00:00.0 ", "exif", None, day), (3, "k", "p/b", "2024-01-02T10:00:00", "exif", None, 2 * day),
        (4, "z", "p/a\t", "2024-01-01T10:00:00Z", "exif", None, day), (5, "z", "p/b", "2024-01-01T12:00:00+02:00", "exif", None, day), (6, "z", "p/a", "2024-01-01T10:00:00", "exif", None, 2 * day),
    ]
    r = got(spark, rows, half_life_days=30.0)
    assert (r["K"]["captured_record_id"], r["K"]["captured_value"], r["K"]["path_record_id"], r["K"]["path_value"]) == (1, "2024-01-01T10:00", 1, " p/a ")
    assert 0.6 < r["K"]["captured_support"] < 0.7 and 0.6 < r["K"]["path_support"] < 0.7
    assert (r["Z"]["captured_record_id"], r["Z"]["path_record_id"], r["Z"]["path_value"]) == (4, 6, "p/a") and 0.6 < r["Z"]["captured_support"] < 0.7


def test_keys_of_iso_times(spark):
    same = [["2024-01-01T10:00", "2024-01-01 10:00:00", " 2024-01-01T10:00:00,000"], ["2024-01-01T10:00Z", "2024-01-01T10:00:00+00:00", "2024-01-01T08:30-0130", "2024-01-01T12:00:00.0+02"], ["2024-01-01T10:00:00.123456789"], ["2024-01-01T10:00:00.12345678"], ["2023-12-31T23:59:59"]]
    df = spark.createDataFrame([(i, t) for i, ts in enumerate(same) for t in ts], "i int, t string")
    keys = {(r[0], r[1]) for r in df.select("i", S.iso_key(df["t"])).collect()}
    assert len(keys) == len({k for _, k in keys}) == len(same)


def test_iso_times(spark):
    good = ["2024-01-01T10:00:00", "2024-02-29 10:00", "2024-01-01T10:00:00.123456Z", "2024-01-01T10:00:00+01:00"]
    bad = ["2023-02-29T10:00:00", "2024-01-01", "0000-00-00T00:00:00", "2024-01-01T24:00:00", "10:00", "", "x" * 10_000, None]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r[0] for r in df.where(S.valid_iso_time(df["t"])).collect()] == good


def test_empty(spark):
    assert S.surviving_members(frame(spark, [(1, "a", None, None, None, None, 1)]).limit(0)).count() == 0
