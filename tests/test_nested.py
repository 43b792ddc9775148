"""Nested manifests: shapes, incomplete documents, keys."""

import json

from lumenfold.operators import nested as N

BOM = chr(0xFEFF)


def frame(spark, payloads):
    rows = [(i, "t", "day01", p, i) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "manifest_id long, trip_id string, day_name string, payload string, n long").selectExpr("manifest_id", "trip_id", "day_name", "payload", "timestamp_micros(n) received_at")


def cases(spark, payloads):
    return {tuple(r) for r in N.manifest_cases(frame(spark, payloads)).collect()}


def test_shapes_of_containers(spark):
    member = lambda f, b=None: {"filename": f, "burst_group_id": b}
    docs = [
        {"clusters": [{"cluster_id": "c1", "members": [member("a", "b1"), member("b")]}], "burst_groups": [{"burst_group_id": "b9", "member_filenames": ["b"]}]},
        {"clusters": {"c2": {"members": member("a", "b1")}}},
        {"clusters": {"cluster_id": "c3", "member_filenames": ["x", "x", "y"]}, "burst_groups": {"b5": {"member_filenames": ["y"]}}},
        {"clusters": [{"clusterId": "c4", "members": None, "memberFilenames": ["z"]}], "burstGroups": {"burstGroupId": "b6", "memberFilenames": ["z"]}},
        {"clusters": [{"cluster_id": "c5", "members": [], "member_filenames": ["no"]}, {"cluster_id": "c6", "members": {"n1": {"blur_score": 1}, "n2": {"filename": "m"}}}]},
        {"clusters": None}, {}, {"clusters": [{"cluster_id": 7, "members": ["plain", None, {"filename": None}]}]},
    ]
    assert cases(spark, [json.dumps(d) for d in docs]) == {(0, "c1", "b1", "a"), (0, "c1", "b9", "b"), (1, "c2", "b1", "a"), (2, "c3", "", "x"), (2, "c3", "b5", "y"), (3, "c4", "b6", "z"), (4, "c6", "", "m"), (4, "c6", "", "n1"), (7, "7", "", "plain")}


def test_only_whole_documents_count(spark):
    good = '{"clusters": [{"cluster_id": "c", "members": [{"filename": "f"}]}]}'
    payloads = [good, BOM + good, json.dumps(good), good[:-1], good + "x", good + good, good + ",", "", None, "[]", "1", "null", json.dumps(BOM + good), "{} ]  , [ {}", '{"clusters": NaN}', " " + good + "\n"]
    assert {r[0] for r in cases(spark, payloads)} == {0, 1, 2, 12, 15}


def test_latest_delivery_counts_even_if_unreadable(spark):
    good = '{"clusters": [{"cluster_id": "c", "members": [{"filename": "%s"}]}]}'
    rows = [(1, good % "old", 1), (1, good % "new", 2), (2, good % "old", 1), (2, "{", 2), (3, good % "x", None), (None, good % "y", 1), (3, good % "x", None)]
    df = spark.createDataFrame(rows, "manifest_id long, payload string, n long").selectExpr("manifest_id", "'t' trip_id", "'d' day_name", "payload", "timestamp_micros(n) received_at", "1 as doc", "2 as cluster_id")
    assert {(r[0], r[3]) for r in N.manifest_cases(df).collect()} == {(1, "new"), (3, "x")}
    assert N.manifest_cases(df.limit(0)).count() == 0


def test_flat_tables_keep_parent_keys_and_variants(spark):
    doc = {"day_name": "day07", "summary": {"cluster_count": 2}, "burst_groups": [{"burst_group_id": "b1", "member_filenames": ["a"], "member_count": 1}], "clusters": [{"cluster_id": "c1", "member_count": 1, "members": [{"filename": "a", "blur_score": "2.5", "orientation": "portrait"}]}, {"cluster_id": "c2", "member_filenames": ["n"]}]}
    flat = N.flatten_manifests(frame(spark, [json.dumps(doc)]))
    m = flat["manifests"].first()
    assert (m["day_name"], m["declared_cluster_count"], m["clusters_state"], m["bursts_state"]) == ("day07", 2, "list", "list")
    assert [(r["cluster_id"], r["variant"]) for r in flat["clusters"].orderBy("cluster_pos").collect()] == [("c1", "own/list"), ("c2", "own/names")]
    rows = {r["filename"]: r for r in flat["members"].collect()}
    assert rows["a"]["blur_score"] == 2.5 and rows["a"]["burst_group_id"] == "b1" and rows["a"]["variant"] == "record" and rows["n"]["variant"] == "text"
    parts = N.subtype_tables(flat["members"], ["record", "text"], ["manifest_id", "cluster_id"])
    assert parts["text"].columns == ["manifest_id", "cluster_id", "filename", "member_pos"] or set(parts["text"].columns) == {"manifest_id", "cluster_id", "filename", "member_pos"}
    assert parts["record"].count() == 1


def test_cases_come_from_the_subtype_tables(spark, monkeypatch):
    doc = {"clusters": [{"cluster_id": "c", "members": [{"filename": "r", "burst_group_id": "b1"}, "t", {"filename": "t2"}]}, {"cluster_id": "d", "member_filenames": ["n"]}], "burst_groups": [{"burst_group_id": "b2", "member_filenames": ["t", "t2"]}]}
    routed, route = [], N.subtype_tables
    monkeypatch.setattr(N, "subtype_tables", lambda *a: routed.append(route(*a)) or routed[-1])
    assert cases(spark, [json.dumps(doc)]) == {(0, "c", "b1", "r"), (0, "c", "b2", "t"), (0, "c", "b2", "t2"), (0, "d", "", "n")}
    (parts,) = routed
    assert {v: sorted(r["filename"] for r in t.where("kind = 'c'").collect()) for v, t in parts.items()} == {"record": ["r", "t2"], "text": ["n", "t"]}
    assert "own" in parts["record"].columns and "own" not in parts["text"].columns
