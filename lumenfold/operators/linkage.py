"""Average linkage of burst representatives, day clusters and their medoids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions import expr
from lumenfold.operators.bursts import DAY
from lumenfold.operators.components import connected_components, union_find
from lumenfold.session import cut

#: Representatives up to which a day is linked as a whole, and a component with a matrix; rows in a block of a larger day.
MATRIX_ROWS, BLOCK_ROWS = 4_000, 8_192


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column whose values all have the same length, without a Python object for each number."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """The rows with length one; rows of length zero stay."""
    x = np.asarray(vectors, dtype=np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def average_linkage(names: list[str], vectors: np.ndarray, most: float, limit: int = 12_000) -> list[list[int]]:
    """Clusters as lists of positions, in their final order.

    Merges the closest pair of clusters while its mean distance is at most ``most``. Of
    equal pairs the first in row-major order counts, the merged cluster stays at the left
    position with its members sorted by name. The matrix holds sums of pair distances, for
    which a merge adds a row to another; row minima are kept, so a merge costs one row.
    """
    n = len(names)
    if n > limit:
        raise ValueError(f"{n} representatives in one group; the linkage matrix is bounded to {limit}")
    x = unit_rows(vectors)
    sums = 1.0 - x @ x.T
    size = np.ones(n)
    members = [[i] for i in range(n)]
    alive = np.ones(n, dtype=bool)
    upper = np.where(np.triu(np.ones((n, n), dtype=bool), 1), sums, np.inf)  # mean distances of pairs i < j
    best = upper.argmin(axis=1) if n else np.zeros(0, int)
    value = upper[np.arange(n), best] if n else np.zeros(0)
    while n > 1:
        i = int(value.argmin())
        if not value[i] <= most + 1e-12:
            break
        j = int(best[i])
        members[i] = sorted(members[i] + members[j], key=lambda k: names[k])
        sums[i] += sums[j]
        sums[:, i] = sums[i]
        size[i] += size[j]
        alive[j], value[j] = False, np.inf
        upper[j], upper[:, j] = np.inf, np.inf
        mean = np.where(alive, sums[i] / (size[i] * size), np.inf)
        upper[i, i + 1 :] = mean[i + 1 :]
        upper[:i, i] = mean[:i]
        stale = np.flatnonzero(alive & ((best == i) | (best == j)))
        for k in {i, *stale.tolist()}:
            best[k] = upper[k].argmin()
            value[k] = upper[k, best[k]]
        closer = np.flatnonzero(alive[:i] & ((upper[:i, i] < value[:i]) | ((upper[:i, i] == value[:i]) & (i < best[:i]))))
        best[closer], value[closer] = i, upper[closer, i]
    return [members[k] for k in range(n) if alive[k]]


def linkage_by_sums(names: list[str], vectors: np.ndarray, most: float) -> list[list[int]]:
    """What ``average_linkage`` gives, for groups of any size: memory grows with the rows, not with their pairs.

    The mean distance of two clusters is one minus the dot product of the sums of their unit
    vectors over the product of their sizes, so a row of means comes from the sums at once.
    A merge never brings clusters closer to a third, so a row whose nearest was merged keeps
    its value as a lower bound until it is the least. Means are compared to 12 decimals.
    """
    sums = unit_rows(vectors)
    n = len(sums)
    size = np.ones(n)
    at = np.arange(n)  # positions of the clusters left, in order
    members: list[list[int]] = [[i] for i in range(n)]
    best, value, stale = np.full(n, n), np.full(n, np.inf), np.zeros(n, dtype=bool)

    def means(i: int, j: int, of: slice) -> np.ndarray:
        return np.round(1.0 - sums[i:j] @ sums[of].T / (size[i:j, None] * size[of]), 12)

    for i in range(0, n, 256):
        j = min(i + 256, n)
        m = means(i, j, slice(i, None))
        m[np.tril_indices(j - i, 0, n - i)] = np.inf
        best[i:j] = m.argmin(axis=1) + i
        value[i:j] = m[np.arange(j - i), best[i:j] - i]
    gone = np.zeros(n, dtype=bool)

    def renew(i: int) -> None:
        m = np.where(gone[i + 1 :], np.inf, means(i, i + 1, slice(i + 1, None))[0])
        best[i] = m.argmin() + i + 1 if len(m) else len(at)
        value[i] = m[best[i] - i - 1] if len(m) else np.inf
        stale[i] = False

    while len(at) > 1:
        i = int(value.argmin())
        if not value[i] <= most + 1e-12:
            break
        if stale[i]:
            renew(i)
            continue
        j = int(best[i])
        members[i] = sorted(members[i] + members[j], key=lambda k: names[k])
        sums[i] += sums[j]
        size[i] += size[j]
        gone[j], value[j], stale[j] = True, np.inf, False
        stale |= ~gone & ((best == i) | (best == j))
        renew(i)
        if 2 * gone.sum() > len(at):  # the rest moves together, so later rows are shorter
            left = np.flatnonzero(~gone)
            to = np.full(len(at) + 1, len(left))
            to[left] = np.arange(len(left))
            sums, size, at, value, stale, best = sums[left], size[left], at[left], value[left], stale[left], to[best[left]]
            members, gone = [members[k] for k in left], np.zeros(len(left), dtype=bool)
    return [m for m, g in zip(members, gone, strict=True) if not g]


def near_components(reps: DataFrame, sizes: DataFrame, most: float, by: list[str], block: int) -> DataFrame:
    """(by..., node, label) of the rows (by..., node, vector) with another at most ``most`` away, also through others.

    All pairs are compared block by block; a pair of blocks gives a forest of its links, not
    the links themselves.
    """
    blocks = F.ceil(F.col("__m") / block).cast("int")
    rows = reps.join(sizes.withColumn("__blocks", blocks), by).withColumn("__own", F.pmod(F.xxhash64("node"), F.col("__blocks")).cast("int"))
    met = rows.select(*by, "node", "vector", "__own", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other"))
    met = met.withColumns({"__a": F.least("__own", "__other"), "__b": F.greatest("__own", "__other")})
    kinds = dict(reps.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", x long, y long"

    def run(key: tuple, group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        x = unit_rows(_matrix(group.column("vector")))
        label = np.arange(len(x))
        for i in range(0, len(x), 512):
            p, q = np.nonzero(1.0 - x[i : i + 512] @ x[i:].T <= most + 1e-9)
            p, q = label[p + i], label[q + i]
            if (apart := p != q).any():
                old, new, _ = union_find(p[apart], q[apart])
                to = np.arange(len(x))
                to[old] = new
                label = to[label]
        link = np.flatnonzero(label != np.arange(len(x)))
        keys = {c: pa.array([k.as_py()] * len(link), group.schema.field(c).type) for c, k in zip(by, key, strict=False)}
        return pa.table(keys | {"x": pa.array(node[link], pa.int64()), "y": pa.array(node[label[link]], pa.int64())})

    links = met.groupBy(*by, "__a", "__b").applyInArrow(run, schema)
    return connected_components(links, by)


def cluster_representatives(representatives: DataFrame, most: float, by: list[str] = DAY, name: str = "representative_path", matrix_rows: int = MATRIX_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """(by..., burst_id, cluster_id) of rows (by..., burst_id, ``name``, vector); cluster ids run from one in final order.

    Groups of at most ``matrix_rows`` are solved in one task each. Larger ones fall into the
    components of their pairs at most ``most`` apart: a merge needs such a pair, so no
    cluster reaches over two of them. Each component is linked by itself, by its sums where
    it has more than ``matrix_rows``, and clusters are numbered by their first members.
    """
    kinds = dict(representatives.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", burst_id int, cluster_id int"

    def linked(group: pa.Table) -> list[list[int]]:
        vectors = _matrix(group.column("vector"))
        return (average_linkage if len(group) <= matrix_rows else linkage_by_sums)(group.column(name).to_pylist(), vectors, most)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(name, "ascending"), ("burst_id", "ascending")])
        found = linked(group)
        at = [k for c in found for k in c]
        ids = [i + 1 for i, c in enumerate(found) for _ in c]
        keys = {c: pa.array([k.as_py()] * len(at), group.schema.field(c).type) for c, k in zip(by, key, strict=False)}
        return pa.table(keys | {"burst_id": group.column("burst_id").take(pa.array(at, pa.int64())).cast(pa.int32()), "cluster_id": pa.array(ids, pa.int32())})

    reps = representatives.select(*by, "burst_id", name, "vector")
    sizes = cut(reps.groupBy(*by).agg(F.count("*").alias("__m")).where(F.col("__m") > matrix_rows))
    if sizes.isEmpty():
        return reps.groupBy(*by).applyInArrow(run, schema)
    small = reps.join(sizes, by, "left_anti").groupBy(*by).applyInArrow(run, schema)
    large = cut(reps.join(F.broadcast(sizes.drop("__m")), by).withColumn("node", F.monotonically_increasing_id()))
    parts = near_components(large.select(*by, "node", "vector"), F.broadcast(sizes), most, by, block).select("node", "label")
    whole = cut(large.join(parts, "node", "left"))
    alone = whole.where("label is null").select(*by, "burst_id", F.col("node").alias("label"), F.lit(1).alias("cluster_id"))
    in_part = schema.replace(", burst_id int", ", label long, burst_id int")

    def run_part(key: tuple, group: pa.Table) -> pa.Table:
        got = run(key, group)
        return got.add_column(len(by), "label", pa.array([key[-1].as_py()] * len(got), pa.int64()))

    together = whole.where("label is not null").groupBy(*by, "label").applyInArrow(run_part, in_part)
    found = cut(alone.unionByName(together).withColumn("__part", F.struct("label", "cluster_id")).drop("label", "cluster_id"))
    named = found.join(large.select(*by, "burst_id", name), [*by, "burst_id"])
    return small.unionByName(numbered_groups(named, by, "__part", [F.col(name), F.col("burst_id")], "cluster_id").select(*by, "burst_id", "cluster_id"))


def day_clusters(grouped: DataFrame, representatives: DataFrame, vectors: DataFrame, most: float, by: list[str] = DAY) -> DataFrame:
    """``grouped`` (photos with burst_id) with cluster_id: each burst goes where its representative does.

    Bursts whose representative has no vector have no cluster and are left out.
    """
    with_vector = representatives.join(vectors.select(F.col("photo_id").alias("representative_id"), "vector"), "representative_id")
    return grouped.join(cluster_representatives(with_vector, most, by), [*by, "burst_id"])


def medoids(members: DataFrame, by: list[str], name: str = "relative_path", vector: str = "vector") -> DataFrame:
    """(by..., medoid, mean_distance, member_count): the member of least mean cosine distance to all members, itself included.

    The mean distance to a group is one minus the dot product with the mean of the unit
    vectors, so the sums of a group replace its pairs. Means are compared to 9 decimals;
    ties go to the first name. A vector of length zero has distance one to every member.
    """
    unit = members.select(*by, name, vector).withColumn("__u", F.coalesce(expr.unit(F.col(vector)), F.transform(vector, lambda x: F.lit(0.0)))).select(*by, name, "__u", F.col(vector).isNotNull().alias("__v"))
    centre = unit.where("__v").groupBy(*by).agg(Summarizer.sum(array_to_vector("__u")).alias("__s")).withColumn("__s", vector_to_array("__s"))  # whole vectors, not a row for each value
    sizes = members.groupBy(*by).agg(F.count("*").alias("member_count"))
    scored = unit.join(centre, by).join(sizes, by).withColumn("mean", F.round(1.0 - expr.dot(F.col("__u"), F.col("__s")) / F.col("member_count"), 9))
    best = F.min(F.struct("mean", name)).alias("b")
    return scored.groupBy(*by).agg(best, F.first("member_count").alias("member_count")).select(*by, F.col(f"b.{name}").alias("medoid"), F.col("b.mean").alias("mean_distance"), "member_count")


def member_metrics(members: DataFrame, representatives: DataFrame, by: list[str], member: str = "photo_id", chosen: str = "representative_id") -> DataFrame:
    """``members`` with their distances to the representative of their group: vector, histogram and hash."""
    features = ["vector", "color_histogram", "perceptual_hash"]
    other = members.join(representatives.select(*by, F.col(chosen).alias(member)), [*by, member]).select(*by, *[F.col(c).alias(f"__{c}") for c in features])
    joined = members.join(other, by)
    return joined.withColumns(
        {
            "cosine_distance_to_representative": expr.cosine_distance(F.col("vector"), F.col("__vector")),
            "histogram_similarity_to_representative": expr.cosine(F.col("color_histogram"), F.col("__color_histogram")),
            "perceptual_hash_distance_to_representative": expr.hamming(F.col("perceptual_hash"), F.col("__perceptual_hash")),
        }
    ).drop(*[f"__{c}" for c in features])


def numbered_groups(rows: DataFrame, by: list[str], group: str, order: list, out: str) -> DataFrame:
    """``rows`` with ``out``: groups numbered from one within ``by`` by the first of ``order``."""
    heads = rows.groupBy(*by, group).agg(F.min(F.struct(*order)).alias("__o"))
    return rows.join(heads.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy("__o"))).drop("__o"), [*by, group])
