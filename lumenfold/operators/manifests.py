"""The nested manifest of a day as a view over flat tables: built, rewritten after each stage, written and read."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import expr
from lumenfold.operators.bursts import DAY, best_first

NAME = "cluster_manifest.json"
MEMBER = "filename STRING, relative_path STRING, burst_group_id STRING, captured_at STRING, orientation STRING, blur_score DOUBLE, brightness_mean DOUBLE, overexposed_ratio DOUBLE, cosine_distance_to_representative DOUBLE, histogram_similarity_to_representative DOUBLE, perceptual_hash_distance_to_representative INT, category_name STRING"
SCHEMA = f"""day_name STRING, manifest_version INT, generated_from STRING,
summary STRUCT<accepted_photo_count: BIGINT, burst_group_count: BIGINT, cluster_count: BIGINT, singleton_cluster_count: BIGINT, categorized_cluster_count: BIGINT, categorized_burst_group_count: BIGINT, category_counts: MAP<STRING, BIGINT>>,
burst_groups ARRAY<STRUCT<burst_group_id: STRING, representative_filename: STRING, member_filenames: ARRAY<STRING>, member_count: BIGINT>>,
clusters ARRAY<STRUCT<cluster_id: STRING, representative_filename: STRING, member_filenames: ARRAY<STRING>, burst_group_ids: ARRAY<STRING>, member_count: BIGINT, members: ARRAY<STRUCT<{MEMBER}>>, burst_group_categories: ARRAY<STRUCT<burst_group_id: STRING, category_name: STRING, classification_rationale: STRING, classification_source_filename: STRING, classification_model_name: STRING, classification_response_id: STRING>>>>"""

_METRICS = ["cosine_distance_to_representative", "histogram_similarity_to_representative", "perceptual_hash_distance_to_representative"]


def _member(extra: list[str]) -> list:
    fixed = [
        expr.file_name(F.col("relative_path")).alias("filename"), "relative_path", F.format_string("burst%03d", "burst_id").alias("burst_group_id"), F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss").alias("captured_at"),
        "orientation", "blur_score", "brightness_mean", "overexposed_ratio",
    ]
    return [*fixed, *extra]


def build(members: DataFrame, cluster_reps: DataFrame, burst_reps: DataFrame, by: list[str] = DAY, version: int = 1) -> DataFrame:
    """(by..., manifest_version, summary, burst_groups, clusters): one row for each day.

    ``members`` are photos with burst_id and cluster_id and, if known, their metrics against
    the cluster's representative; ``cluster_reps`` holds (by..., cluster_id,
    representative_path), ``burst_reps`` (by..., burst_id, representative_path). Bursts are
    listed by number, members of a burst by time, members of a cluster by path, the bursts of
    a cluster by the path of their first member. Groups without members don't occur.
    """
    extra = [c for c in (*_METRICS, "category_name") if c in members.columns]
    name = lambda c: expr.file_name(F.col(c))
    per_burst = members.groupBy(*by, "burst_id").agg(F.array_sort(F.collect_list(F.struct(F.col("captured_at").isNull().alias("n"), "captured_at", "relative_path"))).alias("m"))
    bursts = per_burst.join(burst_reps.select(*by, "burst_id", "representative_path"), [*by, "burst_id"]).select(
        *by, "burst_id",
        F.struct(F.format_string("burst%03d", "burst_id").alias("burst_group_id"), name("representative_path").alias("representative_filename"), F.transform("m", lambda x: F.element_at(F.split(x["relative_path"], "/"), -1)).alias("member_filenames"), F.size("m").cast("long").alias("member_count")).alias("b"),
    )
    burst_lists = bursts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("burst_id", "b"))), lambda x: x["b"]).alias("burst_groups"))
    per_cluster = members.groupBy(*by, "cluster_id").agg(F.array_sort(F.collect_list(F.struct(F.col("relative_path").alias("k"), F.struct(*_member(extra)).alias("v")))).alias("m"))
    order = members.groupBy(*by, "cluster_id", "burst_id").agg(F.min("relative_path").alias("p")).groupBy(*by, "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "burst_id"))), lambda x: F.format_string("burst%03d", x["burst_id"])).alias("burst_group_ids"))
    clusters = per_cluster.join(order, [*by, "cluster_id"]).join(cluster_reps.select(*by, "cluster_id", "representative_path"), [*by, "cluster_id"]).select(
        *by, "cluster_id",
        F.struct(
            F.format_string("cluster%03d", "cluster_id").alias("cluster_id"), name("representative_path").alias("representative_filename"), F.transform("m", lambda x: x["v"]["filename"]).alias("member_filenames"),
            "burst_group_ids", F.size("m").cast("long").alias("member_count"), F.transform("m", lambda x: x["v"]).alias("members"),
        ).alias("c"),
    )
    cluster_lists = clusters.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "c"))), lambda x: x["c"]).alias("clusters"))
    total = F.aggregate("clusters", F.lit(0).cast("long"), lambda s, c: s + c["member_count"])
    alone = F.size(F.filter("clusters", lambda c: c["member_count"] == 1)).cast("long")
    summary = F.struct(total.alias("accepted_photo_count"), F.size("burst_groups").cast("long").alias("burst_group_count"), F.size("clusters").cast("long").alias("cluster_count"), alone.alias("singleton_cluster_count"))
    return burst_lists.join(cluster_lists, by).select(*by, F.lit(version).alias("manifest_version"), summary.alias("summary"), "burst_groups", "clusters")


def after_cleanup(members: DataFrame, alive: DataFrame, cluster_reps: DataFrame, by: list[str] = DAY) -> DataFrame:
    """The manifest of the survivors ``alive`` (with new_name): empty groups are gone, counts and representatives are new.

    A cluster keeps its representative if it survives, otherwise the member nearest to it
    stands in; the representative of a burst is chosen anew from its survivors.
    """
    from lumenfold.operators.duplicates import fallback_representatives

    originals = members.join(cluster_reps.select(*by, "cluster_id", F.col("representative_path").alias("relative_path")), [*by, "cluster_id", "relative_path"]).select(*by, "cluster_id", F.col("photo_id").alias("original"))
    renamed = alive.withColumn("new_path", F.concat_ws("/", "day_name", "new_name"))
    chosen = fallback_representatives(alive, originals, [*by, "cluster_id"]).withColumnRenamed("representative", "photo_id")
    clusters = renamed.join(chosen, [*by, "cluster_id", "photo_id"]).select(*by, "cluster_id", F.col("new_path").alias("representative_path"))
    bursts = renamed.groupBy(*by, "burst_id").agg(F.min_by("new_path", best_first()).alias("representative_path"))
    return build(renamed.drop("relative_path").withColumnRenamed("new_path", "relative_path"), clusters, bursts, by)


def with_categories(manifests: DataFrame, results: DataFrame, by: list[str] = DAY) -> DataFrame:
    """Manifests of version 3 or more: members under their category's folder, uncategorized members and empty clusters left out.

    ``results`` holds (by..., cluster_id, burst_id, category_name, rationale, source_filename,
    model_name, response_id). The list of bursts and the representatives stay as they are.
    """
    flat = manifests.select(*by, F.posexplode("clusters").alias("pos", "c"))
    named = results.select(*by, F.format_string("cluster%03d", "cluster_id").alias("cid"), F.format_string("burst%03d", "burst_id").alias("bid"), "category_name", "rationale", "source_filename", "model_name", "response_id")
    record = F.struct(F.col("bid").alias("burst_group_id"), "category_name", F.col("rationale").alias("classification_rationale"), F.col("source_filename").alias("classification_source_filename"), F.col("model_name").alias("classification_model_name"), F.col("response_id").alias("classification_response_id"))
    per = named.groupBy(*by, "cid").agg(F.map_from_entries(F.collect_list(F.struct("bid", record.alias("r")))).alias("by_burst"))
    joined = flat.join(per, [F.col("c.cluster_id") == F.col("cid"), *[flat[b] == per[b] for b in by]]).select(*[flat[b] for b in by], "pos", "c", "by_burst")
    bare = ["category_name", "classification_rationale", "classification_source_filename", "classification_model_name", "classification_response_id", "burst_group_categories"]
    in_category = F.transform(
        F.filter("c.members", lambda m: F.map_contains_key("by_burst", m["burst_group_id"]) & ~expr.in_reserved_folder(m["relative_path"])),
        lambda m: m.withField("category_name", F.col("by_burst")[m["burst_group_id"]]["category_name"]).withField("relative_path", F.concat_ws("/", F.col("day_name"), F.col("by_burst")[m["burst_group_id"]]["category_name"], m["filename"])),
    )
    records = F.transform(F.filter("c.burst_group_ids", lambda b: F.map_contains_key("by_burst", b)), lambda b: F.col("by_burst")[b])
    staged = joined.withColumns({"kept": in_category, "records": records}).where(F.size("kept") > 0)
    rebuilt = F.col("c").dropFields(*bare).withField("member_filenames", F.transform("kept", lambda m: m["filename"])).withField("member_count", F.size("kept").cast("long")).withField("members", F.col("kept")).withField("burst_group_categories", F.col("records"))
    counted = staged.select(*by, "pos", rebuilt.alias("c"), F.transform("kept", lambda m: m["category_name"]).alias("labels"))
    again = counted.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json("c").alias("j")))), lambda x: x["j"]).alias("js"), F.count("*").alias("n"), F.count_if(F.col("c.member_count") == 1).alias("alone"), F.sum(F.size("c.members").cast("long")).alias("photos"), F.sum(F.size("c.burst_group_categories").cast("long")).alias("bursts"))
    tallies = counted.select(*by, F.explode("labels").alias("label")).groupBy(*by, "label").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("category_counts"))
    kind = f"ARRAY<STRUCT<{_cluster_kind()}>>"
    clusters = F.from_json(F.concat(F.lit("["), F.array_join("js", ","), F.lit("]")), kind)
    summary = F.struct(F.coalesce("photos", F.lit(0)).alias("accepted_photo_count"), F.size("burst_groups").cast("long").alias("burst_group_count"), F.coalesce("n", F.lit(0)).alias("cluster_count"), F.coalesce("alone", F.lit(0)).alias("singleton_cluster_count"), F.coalesce("n", F.lit(0)).alias("categorized_cluster_count"), F.coalesce("bursts", F.lit(0)).alias("categorized_burst_group_count"), F.coalesce("category_counts", F.create_map().cast("map<string,bigint>")).alias("category_counts"))
    return manifests.select(*by, "manifest_version", "burst_groups").join(again, by, "left").join(tallies, by, "left").select(*by, F.greatest("manifest_version", F.lit(3)).alias("manifest_version"), summary.alias("summary"), "burst_groups", F.coalesce(clusters, F.array().cast(kind)).alias("clusters"))


def _cluster_kind() -> str:
    return SCHEMA.split("clusters ARRAY<STRUCT<")[1].removesuffix(">>")


def documents(manifests: DataFrame, root: str = "") -> DataFrame:
    """``manifests`` with payload: the JSON document of each day; nulls are kept in it."""
    known = [c for c in ("day_name", "manifest_version", "summary", "burst_groups", "clusters") if c in manifests.columns]
    whole = F.struct(*known, F.concat_ws("/", F.lit(root), "day_name").alias("generated_from"))
    return manifests.withColumn("payload", F.to_json(whole, {"ignoreNullFields": "false"}))


def write(manifests: DataFrame, root: Path) -> int:
    """Writes the document of each day into its folder below ``root``, indented, one day at a time on the driver."""
    n = 0
    for row in documents(manifests, str(root)).select("day_name", "payload").toLocalIterator():
        folder = root / row["day_name"]
        folder.mkdir(parents=True, exist_ok=True)
        part = folder / f".{NAME}.part"
        part.write_text(json.dumps(json.loads(row["payload"]), indent=2, ensure_ascii=False))
        part.replace(folder / NAME)
        n += 1
    return n


def read(spark: SparkSession, root: Path) -> DataFrame:
    """The manifests of all day folders that have one."""
    paths = [str(p) for p in sorted(Path(root).glob(f"day*/{NAME}"))]
    return spark.read.schema(SCHEMA).option("multiLine", True).json(paths) if paths else spark.createDataFrame([], SCHEMA)
