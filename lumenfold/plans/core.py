"""Queries of the general training-data problems (timestamps, nested records)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import nested, timestamps
from lumenfold.plans import oracles
from lumenfold.session import table


def p2_found(spark, sf_dir):
    """One instant for each photo whose captured_at names a date and a time of day."""
    return timestamps.capture_instants(*(table(spark, sf_dir, t) for t in ("photo", "capture_device", "trip")))


def p3_found(spark, sf_dir):
    """Each distinct filename of each cluster with its burst, from the latest readable delivery."""
    return nested.manifest_cases(table(spark, sf_dir, "cluster_manifest"))


def p3_manifests(spark, sf_dir):
    """The manifests as a flat table."""
    return nested.flatten_manifests(table(spark, sf_dir, "cluster_manifest"))["manifests"]


def p3_bursts(spark, sf_dir):
    """The burst groups as a flat table with the key of their manifest."""
    return nested.flatten_manifests(table(spark, sf_dir, "cluster_manifest"))["bursts"].withColumn("filenames", F.array_join("filenames", "|"))


def p3_clusters(spark, sf_dir):
    """The clusters as a flat table with the key of their manifest and the variant of their shape."""
    return nested.flatten_manifests(table(spark, sf_dir, "cluster_manifest"))["clusters"].withColumn("burst_group_ids", F.array_join("burst_group_ids", "|"))


def p3_members(spark, sf_dir):
    """The members as a flat table with the keys of their manifest and cluster."""
    return nested.flatten_manifests(table(spark, sf_dir, "cluster_manifest"))["members"]


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_manifests, p3_bursts, p3_clusters, p3_members)}
ORACLES = {"p2_found": oracles.P2, "p3_found": oracles.P3}
