"""The stages as one run over a folder: inventory, days, quality, moves, bursts, clusters, clean-up, labels, report.

Stages are DataFrame functions; the files are only touched by the apply steps between them,
on the driver and in a fixed order.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import bursts, days, duplicates, embedding, labels, linkage, manifests, moves, quality, report
from lumenfold.session import cut
from lumenfold.settings import Settings
from lumenfold.sources import images, listing

BY = ["day_name"]
IN_BURST = ["day_name", "cluster_id", "burst_id"]


def intake(spark: SparkSession, settings: Settings, decode: images.Decoder = images.decode_png) -> dict[str, DataFrame]:
    """files, assessed photos with their day, and the plan of the first stages, computed once."""
    files = cut(listing.scan_root(spark, settings))
    photos = images.with_times(images.extract(files.where("classification = 'photo'"), settings, decode))
    others = files.where("classification <> 'photo'").withColumn("captured_on", F.to_date(F.col("modified_at").cast("timestamp_ntz")))
    named = days.day_map(photos, others, prefix=settings.day_prefix)
    assessed = cut(quality.assess(days.assign_days(photos, named), settings.quality, F.col("details").isNotNull()))
    plan = moves.move_plan(moves.photo_plan(assessed, settings), moves.artifact_plan(days.assign_days(others, named)), settings=settings)
    return {"files": files, "assessed": assessed, "plan": cut(plan)}


def cluster(spark: SparkSession, settings: Settings, build: Callable[[], embedding.Embedder], decode: images.Decoder = images.decode_png) -> tuple[DataFrame, DataFrame] | None:
    """(members, manifests) of the photos below the day folders, or None without any."""
    found = listing.accepted_files(spark, settings)
    if found.isEmpty():
        return None
    photos = cut(images.with_times(images.extract(found, settings, decode)).where("details is null").withColumn("photo_id", F.abs(F.xxhash64("relative_path"))))
    grouped = cut(bursts.burst_groups(photos, settings.bursts, BY))
    vectors = cut(embedding.embed(photos, build, settings.embed_batch))
    reps = bursts.burst_representatives(grouped, BY)
    members = cut(linkage.day_clusters(grouped, reps, vectors, settings.bursts.cluster_distance, BY).join(vectors, "photo_id"))
    return members, described(members)


def described(members: DataFrame) -> DataFrame:
    """The manifests of clustered members."""
    by = [*BY, "cluster_id"]
    chosen = linkage.medoids(members, by).withColumnRenamed("medoid", "representative_path")
    reps = members.join(chosen.select(*by, F.col("representative_path").alias("relative_path")), [*by, "relative_path"]).select(*by, F.col("photo_id").alias("representative_id"))
    return cut(manifests.build(linkage.member_metrics(members, reps, by), chosen, bursts.burst_representatives(members, BY), BY))


def clean_up(members: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """losers, survivors with their new names, and the plan that moves the losers."""
    pairs = duplicates.duplicate_pairs(members, "compare", settings.duplicates.similarity, IN_BURST)
    lost = cut(duplicates.losers(duplicates.duplicate_sets(members, pairs, IN_BURST), IN_BURST))
    alive = cut(duplicates.survivor_names(duplicates.survivors(members, lost), IN_BURST))
    out = lost.select("source_path", "day_name", F.lit("rejected").alias("destination_category"), F.lit(settings.folders.duplicates).alias("destination_subfolder"))
    return {"losers": lost, "survivors": alive, "plan": moves.move_plan(out, settings=settings)}


def run(spark: SparkSession, settings: Settings, build: Callable[[], embedding.Embedder], categorizer: labels.Categorizer | None = None, decode: images.Decoder = images.decode_png, encode_heif: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """Runs all stages on the folder of the settings and gives the counters as one row.

    Without ``encode_heif`` HEIF files stay as they are and count as corrupt where the decoder can't
    read them. Labels are made if a categorizer is given; an error in it leaves every file of
    the stage where it is.
    """
    counts: dict[str, int] = {}
    root = Path(settings.root)
    if encode_heif is not None:
        converted = images.convert_heif(root, encode_heif, settings)
        counts["converted_heif_files"] = len(converted)
        kept = root / settings.folders.rejected / settings.folders.not_photo
        for source in converted:  # an original is put aside, never deleted
            kept.mkdir(parents=True, exist_ok=True)
            source.rename(moves.unused_path(kept / source.name, settings.collision_mark))
    first = intake(spark, settings, decode)
    parts = [report.file_counts(first["files"]), report.quality_counts(first["assessed"])]
    moved = moves.apply_moves(first["plan"], settings)
    counts |= {"moved_files": moved.total, "created_directories": len(moved.folders)}
    found = cluster(spark, settings, build, decode)
    if found is not None:
        members, built = found
        counts |= {"clustered_days": built.count(), "manifests_written": manifests.write(built, root)}
        totals = built.agg(F.sum("summary.burst_group_count").alias("b"), F.sum("summary.cluster_count").alias("c")).first()
        counts |= {"burst_group_count": totals["b"] or 0, "final_cluster_count": totals["c"] or 0}
        cleaned = clean_up(members, settings)
        counts["duplicate_photos_rejected"] = cleaned["losers"].count()
        moves.apply_moves(cleaned["plan"], settings)
        alive = cleaned["survivors"].withColumn("target", F.concat_ws("/", "day_name", "new_name"))
        counts["renamed_photos"] = moves.apply_renames(alive.select(F.col("relative_path").alias("source_path"), "target"), root)
        by = [*BY, "cluster_id"]
        chosen = linkage.medoids(members, by).withColumnRenamed("medoid", "representative_path")
        again = cut(manifests.after_cleanup(members, alive, chosen, BY))
        counts["cleanup_manifests_rewritten"] = manifests.write(again, root)
        if categorizer is not None:
            renamed = cut(alive.drop("relative_path", "source_path").withColumnRenamed("target", "relative_path"))
            picked = labels.candidates(renamed, bursts.burst_representatives(renamed, BY), BY)
            results = cut(labels.categorize(picked, categorizer, BY, settings.labels))
            plan = labels.category_moves(renamed, results, BY)
            counts["categorized_photos_moved"] = moves.apply_renames(plan.select("source_path", "target"), root)
            final = cut(manifests.with_categories(again, results, BY))
            counts |= {"categorization_manifests_rewritten": manifests.write(final, root), "categorized_days": results.select("day_name").distinct().count(), "classified_clusters": labels.classified_clusters(results, BY).first()[0]}
    counts["day_count"] = len(listing.day_folders(settings))
    known = spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))
    return report.summary([*parts, known])
