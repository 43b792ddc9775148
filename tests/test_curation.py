"""Curation operators on literal scenes and against small brute-force versions."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings as hsettings, strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import expr
from lumenfold.operators import bursts, components, days, duplicates, embedding, labels, linkage, manifests, moves, quality, quota, report
from lumenfold.settings import BurstLimits, QualityLimits

T0 = datetime(2026, 1, 1, 10, 0, 0)
PHOTO = "photo_id long, trip_id string, day_name string, relative_path string, captured_at timestamp_ntz, blur_score double, perceptual_hash long, color_histogram array<double>"


def photo(i, seconds, blur, code, hist=None, day="day01", path=None):
    return (i, "t", day, path or f"{day}/{i:03d}.jpg", None if seconds is None else T0 + timedelta(seconds=seconds), blur, code, hist)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("/r/a.B.JPG", "2026:1:2 9:3:0", 0b1010, -1, [1.0, 0.0], [0.0, 0.0])], "p string, t string, a long, b long, u array<double>, z array<double>")
    row = df.select(
        expr.extension(F.col("p")).alias("ext"), expr.stem(F.col("p")).alias("stem"), expr.suffix(F.col("p")).alias("suffix"), expr.extension(F.lit("x/.hidden")).alias("dot"), expr.extension(F.lit("none")).alias("none"),
        expr.exif_datetime(F.col("t")).alias("at"), expr.exif_datetime(F.lit("2026-01-02")).alias("bad"), expr.hamming(F.col("a"), F.col("b")).alias("ham"), expr.cosine(F.col("u"), F.col("z")).alias("zero"), expr.cosine(F.col("u"), F.lit(None).cast("array<double>")).alias("null"),
        expr.day_name(F.lit(101)).alias("day"), expr.day_index(F.lit("day101")).alias("idx"), expr.numeric_suffix(F.lit("burst012"), "burst").alias("num"), expr.orientation(F.lit(2), F.lit(2)).alias("sq"), expr.survivor_name(F.lit(1), F.lit(2), F.lit(3), F.col("p")).alias("name"),
        expr.in_reserved_folder(F.lit("day01/_rejected/x.png")).alias("r1"), expr.in_reserved_folder(F.lit("day01/people/x.png")).alias("r2"), expr.in_reserved_folder(F.lit("x.png")).alias("r3"),
    ).first()
    assert (row.ext, row.stem, row.suffix, row.dot, row.none) == ("jpg", "a.B", ".JPG", "", "")
    assert row.at == datetime(2026, 1, 2, 9, 3) and row.bad is None and row.ham == 62 and row.zero == 0 and row.null is None
    assert (row.day, row.idx, row.num, row.sq, row.name) == ("day101", 101, 12, "square", "c001_b002_003.JPG")
    assert (row.r1, row.r2, row.r3) == (True, False, False)
    with pytest.raises(Exception, match="not a burst id"):
        spark.range(1).select(expr.numeric_suffix(F.lit("x"), "burst")).collect()


def test_quality_gate_is_strict_and_keeps_the_order(spark):
    rows = [(29.9, 39.9, 0.61), (30.0, 40.0, 0.6), (None, None, None), (50.0, 100.0, 0.7)]
    got = quality.assess(spark.createDataFrame(rows, "blur_score double, brightness_mean double, overexposed_ratio double")).collect()
    assert [r["rejection_reasons"] for r in got] == [["blurry", "too_dark", "too_bright"], [], [], ["too_bright"]] and [r["is_accepted"] for r in got] == [False, True, True, False]


def test_grid_features_agree_with_numpy(spark):
    grid = np.random.default_rng(3).integers(0, 256, (9, 11)).astype(float)
    df = spark.createDataFrame([(grid.ravel().tolist(),)], "p array<double>")
    got = quality.grid_metrics(df, "p", 9, 11).withColumns({"tile": quality.tile_blur(F.col("p"), 9, 11, QualityLimits(tile_rows=2, tile_cols=3)), "hash": expr.difference_hash(F.col("p"), 9, 11)}).first()
    lap = lambda g: (g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var() if min(g.shape) > 2 else 0.0
    tiles = sorted((lap(t) for band in np.array_split(grid, 2, 0) for t in np.array_split(band, 3, 1)), reverse=True)
    assert got["laplacian_variance"] == pytest.approx(lap(grid)) and got["tile"] == pytest.approx(np.mean(tiles[:2]))
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    assert got["hash"] == int(np.array(int("".join(map(str, bits.astype(int))), 2) & (2**64 - 1), dtype=np.uint64).view(np.int64))


def test_bursts_are_transitive_and_need_likeness(spark):
    rows = [
        photo(1, 0, 20.0, 10), photo(2, 120, 50.0, 11), photo(3, 240, None, 10),  # 1 and 3 are too far apart, 2 links them
        photo(4, 241, 35.0, ~0), photo(5, 600, 1.0, None, [1.0, 0.0]), photo(6, 610, 2.0, None, [1.0, 0.1]), photo(7, None, 3.0, 10), photo(8, 0, 3.0, 10, day="day02"),
        photo(9, 721, 1.0, 5, [0.0, 0.0]), photo(10, 842, 1.0, 5, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, PHOTO)
    got = {r["photo_id"]: (r["day_name"], r["burst_id"]) for r in bursts.burst_groups(df).collect()}
    assert got == {1: ("day01", 1), 2: ("day01", 1), 3: ("day01", 1), 4: ("day01", 2), 5: ("day01", 3), 6: ("day01", 3), 9: ("day01", 4), 10: ("day01", 5), 7: ("day01", 6), 8: ("day02", 1)}
    reps = {r["burst_id"]: r["representative_id"] for r in bursts.burst_representatives(bursts.burst_groups(df)).where("day_name = 'day01'").collect()}
    assert reps == {1: 2, 2: 4, 3: 6, 4: 9, 5: 10, 6: 7}
    assert bursts.burst_groups(df.limit(0)).count() == 0


def test_copies_hang_on_one_photo(spark):
    rows = [photo(i, 0, 1.0, 10) for i in range(1, 400)] + [photo(i, 0, 1.0, None, [0.0, 0.0]) for i in range(500, 510)] + [photo(600, 60, 1.0, 11), photo(601, 60, 1.0, None, [1.0]), photo(602, 60, 1.0, None, [1.0])]
    df = spark.createDataFrame(rows, PHOTO)
    assert bursts.linking_edges(df).count() == 398 + 1 + 1
    sizes = sorted(r["count"] for r in bursts.burst_groups(df).groupBy("burst_id").count().collect())
    assert sizes == [1] * 10 + [2, 400]


def test_both_component_paths_agree(spark):
    rng = np.random.default_rng(5)
    edges = [(int(g), int(a) + 1000 * int(g), int(b) + 1000 * int(g)) for g, a, b in zip(rng.integers(0, 4, 300), rng.integers(0, 200, 300), rng.integers(0, 200, 300))]
    df = spark.createDataFrame(edges, "g int, x long, y long").where("x != y")
    few = {tuple(r) for r in components.connected_components(df, ["g"]).select("node", "label").collect()}
    spread = {tuple(r) for r in components.connected_components(df, ["g"], most_edges=10).select("node", "label").collect()}
    assert few == spread and len(few) > 300


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
@hsettings(max_examples=60, deadline=None)
def test_union_find(pairs):
    x, y = (np.array(c) for c in zip(*pairs))
    nodes, label, at = components.union_find(x, y)
    seen = dict(zip(nodes.tolist(), label.tolist()))
    assert all(seen[a] == seen[b] for a, b in pairs)
    groups = {n: {n} for n in seen}
    for a, b in pairs:
        both = groups[a] | groups[b]
        for n in both:
            groups[n] = both
    assert all(seen[n] == min(groups[n]) for n in seen)


def naive_linkage(names, x, most):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    groups = [[i] for i in range(len(names))]
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                mean = np.mean([d[a, b] for a in groups[i] for b in groups[j]])
                if best is None or mean < best[0] - 1e-12:
                    best = (mean, i, j)
        if best[0] > most:
            break
        _, i, j = best
        groups[i] = sorted(groups[i] + groups[j], key=lambda k: names[k])
        del groups[j]
    return groups


@given(st.integers(0, 10_000), st.integers(1, 14), st.floats(0.02, 1.0))
@hsettings(max_examples=80, deadline=None)
def test_linkage_equals_the_naive_form(seed, n, most):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    names = [f"p{i:02d}" for i in range(n)]
    assert linkage.average_linkage(names, x, most) == naive_linkage(names, x, most)


def test_linkage_ties_go_to_the_first_pair():
    x = np.array([[1.0, 0], [1.0, 0], [0, 1.0], [0, 1.0]])
    assert linkage.average_linkage(list("abcd"), x, 0.18) == [[0, 1], [2, 3]]
    with pytest.raises(ValueError):
        linkage.average_linkage(list("abc"), np.ones((3, 2)), 0.1, limit=2)


@given(st.integers(0, 10_000), st.integers(1, 40), st.floats(0.02, 1.0))
@hsettings(max_examples=80, deadline=None)
def test_linkage_by_sums_equals_linkage_by_matrix(seed, n, most):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    names = [f"p{i:02d}" for i in range(n)]
    assert linkage.linkage_by_sums(names, x, most) == linkage.average_linkage(names, x, most)


def test_linkage_by_sums_ties_and_zeros():
    x = np.array([[1.0, 0], [0, 0], [1.0, 0], [0, 1.0], [0, 1.0], [1.0, 0]])
    assert linkage.linkage_by_sums(list("abcdef"), x, 0.18) == linkage.average_linkage(list("abcdef"), x, 0.18) == [[0, 2, 5], [1], [3, 4]]


def clusters_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, "trip_id string, day_name string, burst_id int, representative_path string, vector array<float>")
    return {(r["day_name"], r["burst_id"]): r["cluster_id"] for r in linkage.cluster_representatives(df, 0.18, **kw).collect()}


def test_split_days_have_the_clusters_of_whole_days(spark):
    rng = np.random.default_rng(2)
    rows = [("t", day, i, f"{rng.integers(10**9):09d}.jpg", rng.normal(size=4).tolist()) for day, n in (("day01", 150), ("day02", 90), ("day03", 5)) for i in range(1, n + 1)]
    whole = clusters_of(spark, rows)
    assert len(whole) == 245 and whole == clusters_of(spark, rows, matrix_rows=40, block=32) == clusters_of(spark, rows, matrix_rows=2, block=64)


def test_a_day_larger_than_any_matrix(spark):
    rng = np.random.default_rng(4)
    n = 12_300  # more than the matrix of average_linkage takes
    centre = rng.integers(0, 4_000, n)
    x = (rng.normal(size=(4_000, 48))[centre] + rng.normal(scale=0.05, size=(n, 48))).astype(np.float32)
    got = clusters_of(spark, [("t", "day01", i, f"{i:05d}.jpg", v) for i, v in enumerate(x.tolist())])
    order = {c: k + 1 for k, c in enumerate(dict.fromkeys(centre.tolist()))}
    assert got == {("day01", i): order[c] for i, c in enumerate(centre.tolist())}


def test_medoid_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([(1, "b", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (2, "x", [0.0, 0.0]), (3, "p", [1.0, 0.0]), (3, "q", [0.98, 0.02]), (3, "r", [0.9, 0.1])], "g int, relative_path string, vector array<double>")
    assert {(r["g"], r["medoid"], r["member_count"]) for r in linkage.medoids(df, ["g"]).collect()} == {(1, "a", 2), (2, "x", 1), (3, "q", 3)}


def test_lengths_are_taken_once_and_medoids_add_whole_vectors(spark):
    rng = np.random.default_rng(4)
    long = rng.normal(size=20_000)  # with its length taken anew for each value, 4 * 10^8 steps
    began = time.monotonic()
    got = spark.createDataFrame([(long.tolist(),)], "v array<double>").select(expr.unit(F.col("v")).alias("u")).first()["u"]
    assert time.monotonic() - began < 10 and np.allclose(got, long / np.linalg.norm(long), rtol=1e-12)
    rows = [(g, f"{i:03d}", rng.normal(size=16).tolist()) for g in range(20) for i in range(15)]
    df = spark.createDataFrame(rows, "g int, relative_path string, vector array<double>")
    found = linkage.medoids(df, ["g"])
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each value of a vector
    for r in found.collect():
        x = linkage.unit_rows(np.array([v for g, _, v in rows if g == r["g"]]))
        mean = 1 - (x @ x.T).mean(axis=1)
        assert (r["medoid"], r["member_count"]) == (f"{mean.argmin():03d}", 15) and abs(r["mean_distance"] - mean.min()) < 1e-8


def test_duplicates_within_their_scope_only(spark):
    same = [1.0] * 10
    rows = [(i, "t", "day01", c, b, p, T0, s, f"day01/{i}.JPG") for i, c, b, p, s in [(1, 1, 1, same, 10.0), (2, 1, 1, same, 25.0), (3, 1, 1, same, 15.0), (4, 1, 2, same, 99.0), (5, 2, 3, same, None), (6, 1, 1, [200.0] * 10, 1.0)]]
    members = spark.createDataFrame(rows, "photo_id long, trip_id string, day_name string, cluster_id int, burst_id int, pixels array<double>, captured_at timestamp_ntz, blur_score double, relative_path string")
    sets = duplicates.duplicate_sets(members, duplicates.duplicate_pairs(members), duplicates.SCOPE)
    assert {r["photo_id"] for r in duplicates.winners(sets, duplicates.SCOPE).collect()} == {2}
    lost = duplicates.losers(sets, duplicates.SCOPE)
    alive = duplicates.survivor_names(duplicates.survivors(members, lost))
    assert {r["photo_id"]: r["new_name"] for r in alive.collect()} == {2: "c001_b001_001.JPG", 6: "c001_b001_002.JPG", 4: "c001_b002_001.JPG", 5: "c002_b003_001.JPG"}


def test_numbered_names_of_a_plan_stay_apart(spark):
    plan = spark.createDataFrame([("a/p.jpg", "day01/p.jpg", 1), ("b/p.jpg", "day01/p.jpg", 1), ("c/p__dup01.jpg", "day01/p__dup01.jpg", 1), ("d/p.jpg", "day01/p.jpg", 2)], "source_path string, target string, g int")
    got = {r["source_path"]: r["final_target"] for r in moves.resolve_collisions(plan, by=["g"]).collect()}
    assert got == {"a/p.jpg": "day01/p.jpg", "b/p.jpg": "day01/p__dup02.jpg", "c/p__dup01.jpg": "day01/p__dup01.jpg", "d/p.jpg": "day01/p.jpg"}
    taken = spark.createDataFrame([("day01/p.jpg", 2)], "target string, g int")
    again = {r["source_path"]: r["final_target"] for r in moves.resolve_collisions(plan, taken, by=["g"]).collect()}
    assert again == got | {"d/p.jpg": "day01/p__dup01.jpg"}


def test_collisions_skip_taken_numbers(spark):
    plan = spark.createDataFrame([("z/b.jpg", "day01/x.jpg"), ("a/B.jpg", "day01/x.jpg"), ("q/o.jpg", "day02/x.jpg"), ("c", "day01/plain")], "source_path string, target string")
    taken = spark.createDataFrame([("day01/x.jpg",), ("day01/x__dup02.jpg",)], "target string")
    got = {r["source_path"]: r["final_target"] for r in moves.resolve_collisions(plan, taken).collect()}
    assert got == {"a/B.jpg": "day01/x__dup01.jpg", "z/b.jpg": "day01/x__dup03.jpg", "q/o.jpg": "day02/x.jpg", "c": "day01/plain"}


def test_rename_conflicts(spark):
    renames = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "x"), ("d", "x"), ("e", "kept")], "source_path string, target string")
    existing = spark.createDataFrame([("a",), ("b",), ("kept",)], "target string")
    assert {(r["target"], r["n"], r["taken"]) for r in moves.rename_conflicts(renames, existing).collect()} == {("x", 2, False), ("kept", 1, True)}


def brute_quota(sizes, per_day, total):
    taken, left = [], 0
    for n in sizes:
        left += per_day
        take = min(n, left, total - sum(taken))
        taken.append(take)
        left -= take
    return taken


def test_quota_rolls_over(spark):
    for sizes, per_day, total in [([2, 20, 3, 40], 10, 100), ([20, 1, 20], 5, 8), ([0, 3], 2, 2), ([1, 1, 30, 9], 3, 12)]:
        rows = [(d, i) for d, n in enumerate(sizes) for i in range(n)]
        got = quota.select_album(spark.createDataFrame(rows, "day int, i int"), per_day, total, [], "day", [F.col("i")]).groupBy("day").count()
        want = brute_quota([n for n in sizes if n], per_day, total)  # a day without photos isn't known
        assert [r["count"] for r in got.orderBy("day").collect()] == [w for w in want if w]


def test_days_of_artifacts_take_a_number(spark):
    photos = spark.sql("select date'2026-01-02' captured_on union all select date'2026-01-05' union all select null")
    other = spark.sql("select date'2026-01-03' captured_on")
    assert [r["day_name"] for r in days.assign_days(photos, days.day_map(photos, other)).orderBy("captured_on").collect()] == ["day01", "day03"]
    many = spark.sql("select explode(sequence(date'2026-01-01', date'2026-06-01')) captured_on")
    assert days.day_map(many).agg(F.max("day_index")).first()[0] == 152 and days.day_map(many).where("day_name = 'day152'").count() == 1


def test_manifest_round_trip(spark, tmp_path):
    rows = [(1, "t", "day01", "day01/a.jpg", T0, "landscape", 1.0, 2.0, None, 1, 1), (2, "t", "day01", "day01/b.jpg", T0 + timedelta(seconds=1), "portrait", 3.0, 4.0, 0.1, 1, 1), (3, "t", "day01", "day01/c.jpg", T0, "square", None, 4.0, 0.1, 2, 2)]
    members = spark.createDataFrame(rows, "photo_id long, trip_id string, day_name string, relative_path string, captured_at timestamp_ntz, orientation string, blur_score double, brightness_mean double, overexposed_ratio double, burst_id int, cluster_id int")
    by = ["day_name"]
    reps = bursts.burst_representatives(members, by)
    clusters = spark.createDataFrame([("day01", 1, "day01/b.jpg"), ("day01", 2, "day01/c.jpg")], "day_name string, cluster_id int, representative_path string")
    built = manifests.build(members, clusters, reps, by)
    assert manifests.write(built, tmp_path) == 1
    text = (tmp_path / "day01" / manifests.NAME).read_text()
    assert '"overexposed_ratio": null' in text
    back = manifests.read(spark, tmp_path).first()
    assert back["summary"]["accepted_photo_count"] == 3 and back["summary"]["singleton_cluster_count"] == 1
    assert [m["filename"] for m in back["clusters"][0]["members"]] == ["a.jpg", "b.jpg"] and back["burst_groups"][0]["representative_filename"] == "b.jpg"
    picked = labels.candidates(members, reps, by)
    assert {(r["burst_id"], r["photo_id"]) for r in picked.collect()} == {(1, 2), (2, 3)}
    results = labels.categorize(picked, labels.RuleCategorizer(), by).where("burst_id = 1")
    final = manifests.with_categories(built, results, by).first()
    assert final["manifest_version"] == 3 and final["summary"]["cluster_count"] == 1 and final["summary"]["category_counts"] == {"food": 2} and final["summary"]["burst_group_count"] == 2
    assert final["clusters"][0]["members"][0]["relative_path"] == "day01/food/a.jpg" and final["clusters"][0]["burst_group_categories"][0]["burst_group_id"] == "burst001"


def test_retries_wait_twice_as_long_each_time():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise labels.TransientError
        return "ok"

    assert labels.with_retries(call, 2, 1.0, waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(KeyError):
        labels.with_retries(lambda: {}["x"], 5, 0.0, waits.append)


def test_prompt_and_schema_name_every_category():
    assert all(c.name in labels.prompt() for c in labels.CATEGORIES)
    assert labels.response_schema()["properties"]["category_name"]["enum"] == [c.name for c in labels.CATEGORIES]


def test_embedder_plugin_keeps_order_and_length(spark):
    class Constant:
        def embed(self, paths):
            return np.array([[3.0, 4.0 if p.endswith("a") else 0.0] for p in paths])

    got = {r["photo_id"]: list(r["vector"]) for r in embedding.embed(spark.createDataFrame([(1, "x/a"), (2, "x/b")], "photo_id long, source_path string"), Constant, 1).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [1.0, 0.0]
    assert embedding.pick_device("auto", True) == "cuda" and embedding.pick_device("auto", False) == "cpu" and embedding.pick_device("mps", True) == "mps"


def test_report_has_every_counter(spark):
    row = report.summary([spark.sql("select 3L total_items")])
    assert row.columns == list(report.COUNTERS) and report.as_rows(row).count() == 22 and "total_items: 3" in report.as_text(row)


def test_burst_bound_is_a_parameter(spark):
    rows = [photo(1, 0, 1.0, 0), photo(2, 300, 1.0, 0)]
    assert bursts.burst_edges(spark.createDataFrame(rows, PHOTO), BurstLimits(gap_seconds=300)).count() == 1


def test_remote_categorizer_builds_its_request(tmp_path):
    (tmp_path / "a.png").write_bytes(b"raw")
    seen = []

    def ask(text, schema, image):
        seen.append((text, schema, image))
        return '{"category_name": "food", "rationale": "a plate"}', "r1"

    shrink = lambda data, size, quality: b"%d-%d-" % (size, quality) + data
    made = labels.build_categorizer({"categorizer_key": "k"}, lambda key: ask, shrink, "m")
    got = made.categorize("day01", 1, 1, str(tmp_path / "a.png"))
    assert (got.category_name, got.model_name, got.response_id) == ("food", "m", "r1") and seen[0][2] == "data:image/jpeg;base64,MTAyNC04Mi1yYXc="
    with pytest.raises(RuntimeError):
        labels.build_categorizer({}, lambda key: ask, shrink, "m")


def test_progress_and_observed_counters(spark, caplog):
    import logging

    from lumenfold import logs

    said = [i for i in range(1, 46) if logs.progress(logging.getLogger("t"), "step", i, 45)]
    assert said == [20, 40, 45] and not logs.progress(logging.getLogger("t"), "step", 0, 0)
    df, watch = logs.observed(spark.range(10), {"n": F.count("*"), "even": F.count_if(F.col("id") % 2 == 0)})
    df.collect()
    assert watch.get == {"n": 10, "even": 5}


def test_responses_parse_strictly(spark):
    df = spark.createDataFrame([('{"category_name": "food", "rationale": "r"}',), ("no json",), (None,)], "t string")
    assert [r[0]["category_name"] if r[0] else None for r in df.select(labels.parse_response(F.col("t"))).collect()] == ["food", None, None]
