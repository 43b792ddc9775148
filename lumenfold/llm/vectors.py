"""Balanced posting lists over vectors, and the neighbour searches that run on them.

The index: a hierarchical k-means over a bounded sample splits until no leaf holds more than
its share, so lists are balanced where the vectors are dense. The centroids (a bounded
table) travel to the executors, where a beam search over their neighbour graph finds the
nearest lists of each vector. Boundary vectors are members of several lists; the lists a
vector is searched in are chosen by the ratio of their distance to that of the nearest.
Lists longer than a block are cut into blocks of members times blocks of searchers, so no
task holds an unbounded list and no row is dropped.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.session import broadcast_if_small, cut, release, uncut


@dataclass(frozen=True)
class IndexParams:
    """Bounds and widths of the index; all of them are documented limits of the fit, not of the data."""

    dim: int = 128
    list_target: int = 384  # vectors for which one centroid is wanted
    fit_sample: int = 32_768  # vectors the centroids are fitted on, at most
    max_centroids: int = 4_096  # rows of the table that is sent to the executors, at most
    member_lists: int = 6  # lists a boundary vector is stored in, at most
    search_lists: int = 12  # lists a vector is searched in, at most
    member_ratio: float = 1.25  # a list stores a vector if it is at most so much farther than the nearest list
    search_ratio: float = 1.50  # a list is searched if it is at most so much farther than the nearest list
    block_rows: int = 4_096  # members, and searchers, of one block
    deepen_rows: int = 65_536  # members above which a list gets an index of its own
    deep_sample: int = 8_192  # rows such an index is fitted on, at most
    deep_centroids: int = 1_024  # lists it is divided into, at most
    deep_lists: int = 4  # of these, the most a vector is stored or searched in
    broadcast_rows: int = 300_000  # lists up to which their sizes are broadcast
    batch_rows: int = 1_000_000  # rows of lists that are searched at once, or as many as there are vectors


def _bytes_of(column: pa.Array) -> np.ndarray:
    """The bytes of a binary Arrow column whose values all have the same length, a row for each value, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary Arrow column."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The float32 matrix of a binary Arrow column whose values all have ``dim`` floats."""
    return _bytes_of(column).view(np.float32).reshape(-1, dim)


def to_codes(x: np.ndarray) -> pa.Array:
    """Vectors as 16-bit codes with a scale each: half the bytes, and dot products of unit vectors exact to about 10^-5."""
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-30).astype(np.float32) / 32_767
    return _binary(np.hstack([scale.view(np.uint8), np.rint(x / scale).astype(np.int16).view(np.uint8)]))


def from_codes(column: pa.Array, dim: int) -> np.ndarray:
    """The float32 matrix of a column of codes."""
    rows = _bytes_of(column)
    if not len(rows):
        return np.zeros((0, dim), np.float32)
    return np.ascontiguousarray(rows[:, 4:]).view(np.int16).astype(np.float32) * np.ascontiguousarray(rows[:, :4]).view(np.float32)


def latest_vectors(embedding: DataFrame, dim: int = 128) -> DataFrame:
    """(photo_id, vec): the usable vector of each photo, as ``dim`` float32 of length one.

    A photo's vector is that of its row with the latest embedded_at (a null time comes
    first; of equal times the greatest vector counts). It is usable if it has ``dim``
    finite values that are not all zero. Photos without one, and a null photo_id, are left out.
    """
    rows = embedding.where("photo_id is not null").select("photo_id", F.struct("embedded_at", F.col("vector").cast("array<float>").alias("vector")).alias("row"))
    last = rows.groupBy("photo_id").agg(F.max("row").alias("row")).select("photo_id", F.col("row.vector").alias("vector"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            right = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dim
            ids = batch.column("photo_id").filter(pa.array(right))
            flat = vectors.filter(pa.array(right)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # a null becomes NaN
            with np.errstate(all="ignore"):
                peak = np.abs(x).max(axis=1, initial=0)
                good = np.isfinite(x).all(axis=1) & (peak > 0)
                x = x[good] / peak[good][:, None]
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), _binary(x) if len(x) else pa.array([], pa.binary())], names=["photo_id", "vec"])

    return last.mapInArrow(unit, "photo_id long, vec binary")


# --- fitting -------------------------------------------------------------------------


def _split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        label = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return label


def fit_centroids(x: np.ndarray, leaf: int, most: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of a hierarchical k-means that splits until a leaf has at most ``leaf`` rows.

    The largest group is split first, so where ``most`` leaves end it, they are about equal.
    """
    rng = np.random.default_rng(seed)
    todo, done, made = [(-len(x), 0, np.arange(len(x)))], [], 1
    while todo:
        rows = heapq.heappop(todo)[2]
        room = most - len(done) - len(todo)
        k = min(8, math.ceil(len(rows) / max(leaf, 1)), room)
        if k <= 1:
            done.append(rows)
            continue
        label = _split(x[rows], k, rng)
        parts = [rows[label == i] for i in range(k)]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # equal vectors can't be split
            done.append(rows)
            continue
        for p in parts:
            heapq.heappush(todo, (-len(p), made, p))
            made += 1
    centres = np.stack([x[r].mean(axis=0) for r in done])
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    return np.where(norm > 1e-9, centres / np.maximum(norm, 1e-12), x[[r[0] for r in done]]).astype(np.float32)


class CentroidGraph:
    """Beam search over the neighbour graph of the centroids, entered through a layer of hubs.

    Hubs are centroids of the centroids; each knows the ``fan`` centroids nearest to it. A
    search compares with all hubs, starts from what the best of them know, and follows the
    links of the best centroids that aren't opened yet until none of the beam is left.
    """

    def __init__(self, centres: np.ndarray, degree: int = 16, fan: int = 16, built: tuple | None = None) -> None:
        self.centres = centres
        if built is not None:
            self.hubs, self.known, self.near = built
            return
        n = len(centres)
        self.hubs = fit_centroids(centres, 6, n) if n > 64 else centres
        self.known = self._nearest(self.hubs, min(fan, n))
        self.near = self._nearest(centres, min(degree + 1, n))  # itself is one of them

    def parts(self) -> tuple:
        """What a graph is made again from, without building it."""
        return self.centres, (self.hubs, self.known, self.near)

    def _nearest(self, of: np.ndarray, k: int) -> np.ndarray:
        found = np.empty((len(of), k), dtype=np.int32)
        for at in range(0, len(of), 1024):
            s = of[at : at + 1024] @ self.centres.T
            found[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return found

    def _merge(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, opened: np.ndarray, new: np.ndarray, beam: int) -> tuple:
        rows = np.arange(len(q))[:, None]
        got = np.einsum("nd,nkd->nk", q, self.centres[new])
        ids, sims, opened = np.hstack([ids, new]), np.hstack([sims, got]), np.hstack([opened, np.zeros(new.shape, bool)])
        order = np.argsort(ids * 2 - opened, axis=1, kind="stable")  # an opened copy comes before others
        ids, sims, opened = ids[rows, order], sims[rows, order], opened[rows, order]
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -3
        top = np.argsort(-sims, axis=1)[:, :beam]
        sims = sims[rows, top]
        return ids[rows, top], sims, opened[rows, top] | (sims < -2)

    def search(self, q: np.ndarray, k: int, beam: int = 20, rounds: int = 3, starts: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of about the ``k`` nearest centroids of each row, nearest first; id -1 pads."""
        rows = np.arange(len(q))[:, None]
        best = np.argsort(-(q @ self.hubs.T), axis=1)[:, :starts]
        beam = max(beam, k)
        none = np.zeros((len(q), 0))
        ids, sims, opened = self._merge(q, none.astype(np.int32), none.astype(np.float32), none.astype(bool), self.known[best].reshape(len(q), -1), beam)
        for _ in range(rounds):
            width = min(4, ids.shape[1])
            best = np.argsort(np.where(opened, 9.0, -sims), axis=1)[:, :width]
            if opened[rows, best].all():
                break
            opened[rows, best] = True
            ids, sims, opened = self._merge(q, ids, sims, opened, self.near[ids[rows, best]].reshape(len(q), -1), beam)
        order = np.argsort(-sims, axis=1)[:, :k]
        ids, sims = ids[rows, order], sims[rows, order]
        return np.where(sims < -2, -1, ids), sims


# --- posting lists -------------------------------------------------------------------


def choose_lists(graph: CentroidGraph, q: np.ndarray, params: IndexParams, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, row, stored) of the lists each row of ``q`` is searched in, and whether they also store it."""
    ids, sims = graph.search(q, most or params.search_lists)
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    near = np.maximum(far[:, :1], 1e-3)
    search = (ids >= 0) & (far <= near * params.search_ratio)
    store = search & (far <= near * params.member_ratio) & (np.arange(ids.shape[1]) < min(most or params.member_lists, params.member_lists))
    search[:, 0] = store[:, 0] = True
    row, col = np.nonzero(search)
    return ids[row, col], row, store[row, col]


def deepen(lists: DataFrame, large: DataFrame, params: IndexParams) -> DataFrame:
    """``lists`` with each list of ``large`` (list_id, m, s) divided by an index of its own.

    The centroids of a list are fitted in one task on a bounded sample of its rows and meet
    those rows chunk by chunk, so their table may be as long as the collection needs; a row
    stays a member only where it was one.
    """
    wide = lists.join(large, "list_id")
    share = F.least(F.lit(1.0), F.lit(params.deep_sample * 0.9) / F.col("m"))
    sample = wide.where(F.col("member") & (F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1_000_000)) < share * 1_000_000)).select("list_id", "m", "code")

    def fit(group: pa.Table) -> pa.Table:
        x = from_codes(group.column("code"), params.dim)[: params.deep_sample]
        wanted = min(params.deep_centroids, math.ceil(group.column("m")[0].as_py() / params.list_target))
        centres = fit_centroids(x, max(4, math.ceil(len(x) / wanted)), params.deep_centroids)
        return pa.table({"list_id": group.column("list_id").slice(0, 1), "centres": pa.array([centres.tobytes()], pa.binary())})

    fitted = sample.groupBy("list_id").applyInArrow(fit, "list_id long, centres binary")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("s") / params.deepen_rows)).cast("int")
    rows = wide.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), chunks).cast("int")).select("list_id", "chunk", "id", "code", "member")
    centres = fitted.join(large, "list_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select("list_id", "chunk", "centres")

    def assign(group: pa.Table, known: pa.Table) -> pa.Table:
        if not len(group) or not len(known):
            return group.select(["list_id", "id", "code", "member"])
        graph = CentroidGraph(np.frombuffer(known.column("centres")[0].as_py(), np.float32).reshape(-1, params.dim))
        parts = []
        for at in range(0, len(group), 1024):
            piece = group.slice(at, 1024)
            sub, row, store = choose_lists(graph, from_codes(piece.column("code"), params.dim), params, params.deep_lists)
            out = piece.select(["list_id", "id", "code", "member"]).take(pa.array(row))
            ids = (out.column("list_id").to_numpy() + 1) * 1_048_576 + sub
            member = out.column("member").to_numpy(zero_copy_only=False) & store
            parts.append(pa.table({"list_id": ids, "id": out.column("id"), "code": out.column("code"), "member": member}))
        return pa.concat_tables(parts)

    divided = cut(rows.groupBy("list_id", "chunk").cogroup(centres.groupBy("list_id", "chunk")).applyInArrow(assign, "list_id long, id long, code binary, member boolean"))
    return lists.join(large.select("list_id"), "list_id", "left_anti").unionByName(divided)


def posting_blocks(vectors: DataFrame, params: IndexParams = IndexParams(), key: str = "photo_id") -> tuple[DataFrame, DataFrame]:
    """The stored lists of each vector, and (list_id, block, id, code, member, searcher): every vector in every list that stores or searches it.

    ``vectors`` has ``key`` and ``vec`` (unit length) and is read twice: give it evaluated.
    The lists hold codes, which is what is shuffled; the caller may delete them by ``uncut`` once the blocks are read.
    """
    total = vectors.count()
    spark = vectors.sparkSession
    part = min(1.0, params.fit_sample / max(total, 1))
    picked = vectors.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1_000_000)) < int(part * 1_000_000) + 1)
    sample = picked.select("vec").limit(params.fit_sample).toPandas()["vec"]
    x = np.frombuffer(b"".join(sample), dtype=np.float32).reshape(-1, params.dim)
    wanted = min(params.max_centroids, math.ceil(total / params.list_target))
    centres = fit_centroids(x, max(4, math.ceil(len(x) / max(wanted, 1))), params.max_centroids) if len(x) else np.zeros((1, params.dim), np.float32)
    sent = spark.sparkContext.broadcast(CentroidGraph(centres).parts())  # at most max_centroids rows, and their links

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, built = sent.value
        graph = CentroidGraph(known, built=built)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                x = as_matrix(piece.column("vec"), params.dim)
                list_id, row, store = choose_lists(graph, x, params)
                ends = pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32))
                chosen = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (list_id.astype(np.int32), store)]
                yield pa.RecordBatch.from_arrays([piece.column(key), to_codes(x), *chosen], names=["id", "code", "lists", "stores"])

    # a row for each vector, not one for each of its lists, so its codes are stored once
    stored = cut(vectors.select(F.col(key).cast("long").alias(key), "vec").mapInArrow(assign, "id long, code binary, lists array<int>, stores array<boolean>"))
    lists = stored.select("id", "code", F.inline(F.arrays_zip(F.col("lists").cast("array<long>").alias("list_id"), F.col("stores").alias("member")))).select("list_id", "id", "code", "member")
    sizes = cut(lists.groupBy("list_id").agg(F.count_if("member").alias("m"), F.count("*").alias("s")))  # one row for each centroid
    large = sizes.where(F.col("m") > params.deepen_rows)
    if not large.isEmpty():
        lists = deepen(lists, large, params)
        sizes = cut(lists.groupBy("list_id").agg(F.count_if("member").alias("m"), F.count("*").alias("s")))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / params.block_rows)).cast("int")
    shape = sizes.select("list_id", blocks("m").alias("nm"), blocks("s").alias("ns"))
    own_m, own_s = F.pmod(F.xxhash64("id", F.lit(1)), F.col("nm")).cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("ns")).cast("int")
    spread = lists.join(broadcast_if_small(shape, params.broadcast_rows), "list_id").withColumns({"om": own_m, "os": own_s})
    as_member = F.col("member") & (F.col("block") % F.col("nm") == F.col("om"))
    as_searcher = F.floor(F.col("block") / F.col("nm")) == F.col("os")
    return stored, (
        spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nm") * F.col("ns") - 1)))
        .withColumns({"as_member": as_member, "searcher": as_searcher})
        .where("as_member or searcher")
        .select("list_id", "block", "id", "code", F.col("as_member").alias("member"), "searcher")
    )


def search_blocks(blocks: DataFrame, found: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple], schema: str, dim: int) -> DataFrame:
    """The rows ``found(searcher ids, searcher matrix, member ids, member matrix)`` gives for each block."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        x = from_codes(group.column("code"), dim)
        s, m = group.column("searcher").to_numpy(), group.column("member").to_numpy()
        return pa.table(dict(zip(names, found(ids[s], x[s], ids[m], x[m]), strict=True)))

    return blocks.groupBy("list_id", "block").applyInArrow(run, schema)


def search_in_batches(stored: DataFrame, blocks: DataFrame, collect: Callable[[DataFrame], DataFrame], params: IndexParams) -> DataFrame:
    """The union of what ``collect`` gives for ``blocks``, whole lists at a time, each stored before the next batch is shuffled.

    Every list is in one batch. So what is shuffled at once is about one row for each vector,
    however many lists it is in. ``stored`` is what ``posting_blocks`` gives beside them.
    """
    total = stored.agg(F.count("*").alias("n"), F.sum(F.size("lists")).alias("s")).first()
    n = max(1, math.ceil((total["s"] or 0) / max(params.batch_rows, total["n"])))
    found = []
    for i in range(n):
        some = blocks.where(F.pmod(F.xxhash64(F.lit(17), "list_id"), F.lit(n)) == i) if n > 1 else blocks
        found.append(cut(collect(some)))
        if n > 1:
            release(stored.sparkSession)
    return reduce(DataFrame.unionByName, found)


def top_in_block(k: int, least: float) -> Callable:
    """For each searcher its ``k`` best members of similarity at least ``least``, itself excluded."""

    def found(sid: np.ndarray, s: np.ndarray, mid: np.ndarray, m: np.ndarray) -> tuple:
        out: list[tuple] = []
        for at in range(0, len(sid), 1024):
            sims = s[at : at + 1024] @ m.T
            sims[sid[at : at + 1024, None] == mid[None, :]] = -2
            if sims.shape[1] > k:
                part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                kept = np.take_along_axis(sims, part, 1)
                row, col = np.nonzero(kept >= least)
                out.append((sid[at + row], mid[part[row, col]], kept[row, col]))
            else:
                row, col = np.nonzero(sims >= least)
                out.append((sid[at + row], mid[col], sims[row, col]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return found


# --- exact copies --------------------------------------------------------------------


def copy_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photo_id, cid) of the photos whose vector others have too, and the vectors without those copies.

    ``cid`` is the smallest photo_id of equal vectors. The key is a pair of 64-bit hashes,
    so a class of any size is aggregated before it is shuffled.
    """
    keyed = vectors.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(5), "vec")})
    shared = keyed.groupBy("h1", "h2").agg(F.min("photo_id").alias("cid"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = cut(keyed.select("photo_id", "h1", "h2").join(shared, ["h1", "h2"]).select("photo_id", "cid"))
    return copies, vectors.join(copies.where("photo_id != cid"), "photo_id", "left_anti")


def exact_similarities(pairs: DataFrame, vectors: DataFrame, dim: int, few: int = 1_000_000) -> DataFrame:
    """(a, b, w): the similarity of each pair (a, b), from the whole vectors (photo_id, vec)."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("photo_id")).distinct())
    needed = vectors.join(broadcast_if_small(ids, few), "photo_id", "left_semi")
    side = lambda c: needed.select(F.col("photo_id").alias(c), F.col("vec").alias(f"vec_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (as_matrix(batch.column(f"vec_{c}"), dim).astype(np.float64) for c in "ab")
                w = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(w.astype(np.float32))], names=["a", "b", "w"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, w float")


def neighbours(embedding: DataFrame, k: int = 5, least: float = 0.65, params: IndexParams = IndexParams()) -> DataFrame:
    """(photo_id, neighbour, similarity): for each photo about its ``k`` most similar photos of at least ``least``.

    Ties go to the smaller photo_id. Equal vectors are searched once: a class of copies
    stands in the index by one vector, its ``k + 1`` smallest members stand for it in every
    result (no others can be among the first ``k``), and each of its members gets the
    class's neighbours. Empty tables give no rows.
    """
    vectors = cut(latest_vectors(embedding, params.dim))
    copies, distinct = copy_classes(vectors)
    some = not copies.isEmpty()
    base = cut(distinct) if some else vectors
    lists, blocks = posting_blocks(base, params)
    hits = cut(search_blocks(blocks, top_in_block(k, least), "id long, other long, similarity float", params.dim))
    uncut(lists)
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    best = hits.groupBy("id", "other").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not some:
        return best.select(F.col("id").alias("photo_id"), F.col("other").alias("neighbour"), "similarity")
    first = copies.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("photo_id"))).where(F.col("r") <= k + 1).select("cid", F.col("photo_id").alias("m"))
    wide = best.join(first, best.other == first.cid, "left").select("id", F.coalesce("m", "other").alias("other"), "similarity")
    wide = wide.unionByName(first.select(F.col("cid").alias("id"), F.col("m").alias("other"), F.lit(1.0).cast("float").alias("similarity")))
    lists = wide.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    owners = copies.select(F.col("cid").alias("id"), "photo_id")
    each = lists.join(owners, "id", "left").withColumn("photo_id", F.coalesce("photo_id", "id")).where("photo_id != other")
    again = Window.partitionBy("photo_id").orderBy("r")
    return each.withColumn("q", F.row_number().over(again)).where(F.col("q") <= k).select("photo_id", F.col("other").alias("neighbour"), "similarity")


def similar_pairs(embedding: DataFrame, k: int = 5, least: float = 0.65, params: IndexParams = IndexParams()) -> DataFrame:
    """(photo_a, photo_b), photo_a < photo_b: one of the two is among the ``k`` nearest of the other."""
    near = neighbours(embedding, k, least, params)
    return near.select(F.least("photo_id", "neighbour").alias("photo_a"), F.greatest("photo_id", "neighbour").alias("photo_b")).distinct()
