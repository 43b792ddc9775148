"""Queries of the training-data problems tagged llm."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.llm import clusters, mixing, near_duplicates, oracles, subjects, survivors, tokens, vectors
from lumenfold.session import table


def p1_found(spark, sf_dir):
    """Pairs of photos of which one is among the five most similar photos of the other."""
    return vectors.similar_pairs(table(spark, sf_dir, "embedding"))


def p1_neighbours(spark, sf_dir):
    """The five most similar photos of each photo with their similarity."""
    return vectors.neighbours(table(spark, sf_dir, "embedding")).withColumn("similarity", F.round("similarity", 4))


def p4_found(spark, sf_dir):
    """Each photo of a cluster with the cluster's name and its most typical member."""
    members, described = clusters.similarity_clusters(table(spark, sf_dir, "embedding"))
    return members.join(described, "cluster").select("photo_id", F.col("cluster").alias("cluster_key"), "typical_id")


def p4_clusters(spark, sf_dir):
    """Each cluster with its size, its most typical member and that member's mean similarity."""
    return clusters.similarity_clusters(table(spark, sf_dir, "embedding"))[1]


def p5_found(spark, sf_dir):
    """Pairs of photos whose perceptual hashes and color histograms are both close."""
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "accepted"))


def p6_found(spark, sf_dir):
    """The record that gives each field of an asset's survivor."""
    return survivors.surviving_members(table(spark, sf_dir, "member_record")).select("asset_key", "blur_record_id", "captured_record_id", "path_record_id")


def p6_votes(spark, sf_dir):
    """Survivors by summed votes: trust times a decay of half in thirty days, with the share of the votes."""
    return survivors.surviving_members(table(spark, sf_dir, "member_record"), half_life_days=30.0)


def p7_ids(spark, sf_dir):
    """The token ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_decoded(spark, sf_dir):
    """Every text encoded and put together again from its ids."""
    return tokens.decode(tokens.encode(table(spark, sf_dir, "documents"))).select("doc_id", "text")


def p8_mixture(spark, sf_dir):
    """The largest mixture that gives each source its share, one row for each copy of a document."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target")).select("doc_id", "source", "copy", "n_tokens")


def p8_shares(spark, sf_dir):
    """The shares that mixture reaches, beside the targets."""
    targets = table(spark, sf_dir, "source_target")
    return mixing.reached_shares(mixing.mixture(table(spark, sf_dir, "documents"), targets), targets)


def p9_found(spark, sf_dir):
    """The subjects each document is about."""
    return subjects.document_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_label", "subject_area")))


def p9_composition(spark, sf_dir):
    """How many documents are about each subject, and their share."""
    total = max(1, table(spark, sf_dir, "documents").count())
    counted = p9_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_docs"))
    return counted.withColumn("share", F.round(F.col("n_docs") / total, 6))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p4_found, p4_clusters, p5_found, p6_found, p6_votes, p7_ids, p7_decoded, p8_mixture, p8_shares, p9_found, p9_composition)}
ORACLES = {"p1_found": oracles.P1, "p4_found": oracles.P4, "p5_found": oracles.P5, "p6_found": oracles.P6, "p7_decoded": oracles.P7_DECODED}
