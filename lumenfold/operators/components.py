"""Connected components, by one interface: within groups of a checked size, and distributed for the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import cut


def spread_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (x, y); the label is the smallest node of the component.

    Smallest labels run over the edges with pointer jumping, a round at a time, each cut
    from its lineage by a reliable checkpoint, until a round changes nothing.
    """
    both = cut(edges.select("x", "y").union(edges.select("y", "x")).toDF("x", "y").where("x != y").distinct())
    label = both.select(F.col("x").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        near = both.join(label.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        lower = label.join(near, label.node == near.x).select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = cut(lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), (F.col("moved") | F.coalesce(F.col("further") < F.col("label"), F.lit(False))).alias("moved")))
        label = step.drop("moved")
        if step.where("moved").isEmpty():
            return label


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 .. n - 1 the smallest node it is connected with by the edges (a, b)."""
    parent = np.arange(n)
    while True:
        before = parent.copy()
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while (parent != (up := parent[parent])).any():
            parent = up
        if (parent == before).all():
            return parent


def union_find(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, labels, edges) of a small edge list: the label is the smallest node, edges the position of one edge of each node."""
    nodes, first, flat = np.unique(np.concatenate([x, y]), return_index=True, return_inverse=True)
    return nodes, nodes[least_labels(len(nodes), flat[: len(x)], flat[len(x) :])], first % max(len(x), 1)


def connected_components(edges: DataFrame, by: list[str], most_edges: int = 500_000) -> DataFrame:
    """(by..., node, label) of the nodes of ``edges`` (by..., x, y), BIGINT nodes that belong to one group each.

    Groups of at most ``most_edges`` edges are solved many in a task, the edges of larger
    ones are spread over all tasks. Both give the smallest node as label.
    """
    edges = cut(edges.select(*by, "x", "y"))
    counted = edges.groupBy(*by).agg(F.count("*").alias("__n"))
    large = cut(counted.where(F.col("__n") > most_edges).drop("__n"))
    some = not large.isEmpty()
    small = edges.join(large, by, "left_anti") if some else edges
    kinds = dict(edges.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", node long, label long"
    buckets = max(1, -(-edges.count() * 8 // most_edges))  # about an eighth of most_edges each, besides the groups that are larger alone

    def run(bucket: pa.Table) -> pa.Table:
        nodes, labels, at = union_find(bucket.column("x").to_numpy(), bucket.column("y").to_numpy())
        own = bucket.select(by).take(pa.array(at))
        return pa.table({c: own.column(c) for c in by} | {"node": nodes, "label": labels})

    solved = small.groupBy(F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("__bucket")).applyInArrow(run, schema)
    if not some:
        return solved
    rest = cut(edges.join(large, by))
    labels = spread_labels(rest)
    owners = rest.select(*by, F.explode(F.array("x", "y")).alias("node")).distinct()
    return solved.unionByName(owners.join(labels, "node").select(*by, "node", "label"))
