"""Near-duplicate photos by a hierarchical index over fingerprints in Gray order.

Fingerprints of 64 bits that differ in at most ``most_bits`` bits share one of four blocks of
16 bits up to ``most_bits // 4`` bits. For each block the bits are rotated so that it leads,
and the fingerprints sorted by Gray rank form a tree: an upper node holds what its
fingerprints share in the first eight bits, a node below it the next eight, a leaf group of
consecutive fingerprints a mask with the further bits all of them agree on. A query adds up
its differences from the shared patterns on the way down and leaves a whole group as soon
as they exceed what is allowed. Upper nodes are the unit of distribution.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import cut

BLOCKS, BLOCK_BITS, UPPER_BITS, LEAF = 4, 16, 8, 16


def usable_photos(accepted: DataFrame, bins: int = 24) -> DataFrame:
    """(photo_id, hash, hist): photos with a perceptual hash and a histogram of ``bins`` values, not all zero.

    ``hist`` has the channels in the order r, g, b and length one, so the unit of the
    counts doesn't matter. A null channel_order means rgb; an order that doesn't name each
    of the three once, and values that are null, negative or not finite, make a photo
    unusable. Of several rows of a photo the greatest usable one counts.
    """
    order = F.lower(F.trim(F.coalesce("channel_order", F.lit("rgb"))))
    width = bins // 3
    place = lambda c: F.instr(F.col("__order"), c)
    block = lambda c: F.slice("color_histogram", (place(c) - 1) * width + 1, width)
    named = (F.length("__order") == 3) & (place("r") > 0) & (place("g") > 0) & (place("b") > 0)
    fine = F.forall("color_histogram", lambda x: F.coalesce((x >= 0) & (x < float("inf")), F.lit(False))) & F.exists("color_histogram", lambda x: x > 0)
    rows = accepted.where("photo_id is not null and perceptual_hash is not null").select("photo_id", "perceptual_hash", F.col("color_histogram").cast("array<double>").alias("color_histogram"), order.alias("__order"))
    rows = rows.where((F.size("color_histogram") == bins) & named & fine)
    hist = F.concat(block("r"), block("g"), block("b"))
    one = rows.select("photo_id", F.struct(F.col("perceptual_hash").alias("hash"), hist.alias("hist")).alias("row")).groupBy("photo_id").agg(F.max("row").alias("row")).select("photo_id", "row.*")
    norm = F.sqrt(F.aggregate("hist", F.lit(0.0), lambda s, x: s + x * x))
    return one.withColumn("__n", norm).withColumn("hist", F.transform("hist", lambda x: x / F.col("__n"))).drop("__n")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of all positions first[i] .. first[i] + count[i] - 1."""
    owner = np.repeat(np.arange(len(first)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, first[owner] + within


class GrayNode:
    """The tree below one upper node: fingerprints, already rotated, in Gray order."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints[np.argsort(_gray_rank(prints), kind="stable")]
        middle = (self.prints >> np.uint64(64 - BLOCK_BITS)).astype(np.int64) & ((1 << (BLOCK_BITS - UPPER_BITS)) - 1)
        starts = np.flatnonzero(np.r_[True, middle[1:] != middle[:-1]]) if len(middle) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(middle)] if len(starts) else starts
        self.first, self.count = np.zeros(1 << (BLOCK_BITS - UPPER_BITS), np.int64), np.zeros(1 << (BLOCK_BITS - UPPER_BITS), np.int64)
        groups, at = -(-(ends - starts) // LEAF), 0
        self.first[middle[starts]], self.count[middle[starts]] = np.cumsum(groups) - groups, groups
        owner, at = _spans(np.zeros(len(starts), np.int64), groups)
        self.leaf_first = starts[owner] + at * LEAF
        self.leaf_count = np.minimum(LEAF, ends[owner] - self.leaf_first)
        if len(self.leaf_first):
            alike = np.bitwise_and.reduceat(self.prints, self.leaf_first), np.bitwise_or.reduceat(self.prints, self.leaf_first)
            rest = np.uint64((1 << (64 - BLOCK_BITS)) - 1)
            self.mask, self.pattern = ~(alike[0] ^ alike[1]) & rest, alike[0]

    def search(self, q: np.ndarray, spent: np.ndarray, most: int, near: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) of all fingerprints within ``most`` bits of queries that differ from the node in ``spent`` bits."""
        low = (q >> np.uint64(64 - BLOCK_BITS)).astype(np.int64) & ((1 << (BLOCK_BITS - UPPER_BITS)) - 1)
        flips = np.array([0] + [1 << i for i in range(BLOCK_BITS - UPPER_BITS)]) if near else np.array([0])
        cost = (flips > 0).astype(np.int64)
        who, flip = np.nonzero(spent[:, None] + cost[None, :] <= near)
        node = low[who] ^ flips[flip]
        owner, leaf = _spans(self.first[node], self.count[node])
        who, used = who[owner], (spent[who] + cost[flip])[owner]
        used = used + _popcount((q[who] ^ self.pattern[leaf]) & self.mask[leaf]) if len(leaf) else used
        keep = used <= most  # a group whose shared bits differ too much is left as a whole
        who, leaf = who[keep], leaf[keep]
        owner, at = _spans(self.leaf_first[leaf], self.leaf_count[leaf])
        who = who[owner]
        right = _popcount(q[who] ^ self.prints[at]) <= most
        return who[right], at[right]


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return x if bits == 0 else (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def close_hashes(hashes: DataFrame, most_bits: int = 6) -> DataFrame:
    """(x, y), x < y, of distinct 64-bit values ``hash`` that differ in at most ``most_bits`` bits; exact up to 7 bits.

    Each value goes to the upper node of each of its four blocks as a member, and to the
    nodes one bit above it as a query. A pair is reported by the first block in which its
    two values are near, so no pair comes twice.
    """
    near = most_bits // BLOCKS
    if near > 1:
        raise ValueError("four blocks serve up to seven bits")
    part = lambda b: F.shiftrightunsigned("hash", 64 - BLOCK_BITS * b - UPPER_BITS).bitwiseAND(F.lit((1 << UPPER_BITS) - 1)).cast("int")
    own = [F.struct(F.lit(b).alias("b"), part(b).alias("node"), F.lit(0).alias("spent")) for b in range(BLOCKS)]
    set_bit = lambda b, i: F.when(part(b).bitwiseAND(F.lit(1 << i)) == 0, F.struct(F.lit(b).alias("b"), part(b).bitwiseOR(F.lit(1 << i)).alias("node"), F.lit(1).alias("spent")))
    others = [set_bit(b, i) for b in range(BLOCKS) for i in range(UPPER_BITS)] if near else []
    sent = hashes.select("hash", F.explode(F.filter(F.array(*own, *others), lambda s: s.isNotNull())).alias("s")).select("s.*", "hash")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        b = key[0].as_py()
        prints = _rotate(group.column("hash").to_numpy().view(np.uint64), BLOCK_BITS * b)
        spent = group.column("spent").to_numpy().astype(np.int64)
        node = GrayNode(prints[spent == 0])
        found_x, found_y = [], []
        for mine in (True, False):
            queries = node.prints if mine else prints[spent == 1]
            for at in range(0, len(queries), 4096):
                q = queries[at : at + 4096]
                who, pos = node.search(q, np.full(len(q), 0 if mine else 1), most_bits, near)
                x, y = q[who], node.prints[pos]
                keep = (at + who < pos) if mine else np.ones(len(who), bool)
                for earlier in range(b):  # rotated by b blocks, an earlier block lies at the end
                    shift = np.uint64(16 * (b - earlier - 1))
                    keep &= _popcount(((x ^ y) >> shift) & np.uint64(0xFFFF)) > near
                found_x.append(_rotate(x[keep], (64 - BLOCK_BITS * b) % 64))
                found_y.append(_rotate(y[keep], (64 - BLOCK_BITS * b) % 64))
        x = np.concatenate(found_x or [np.zeros(0, np.uint64)]).view(np.int64)
        y = np.concatenate(found_y or [np.zeros(0, np.uint64)]).view(np.int64)
        return pa.table({"x": np.minimum(x, y), "y": np.maximum(x, y)})

    return sent.groupBy("b", "node").applyInArrow(run, "x long, y long")


def _cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def near_duplicate_pairs(accepted: DataFrame, most_bits: int = 6, least_cosine: float = 0.98, block_rows: int = 2048) -> DataFrame:
    """(photo_a, photo_b), photo_a < photo_b: hashes and histograms of both are close.

    Pairs of hashes come from the index; where many photos share a hash, the pairs of
    photos are formed by blocks of at most ``block_rows`` times as many, otherwise by a
    join, and only those whose histograms agree are put out. Unusable photos are in no
    pair, empty tables give none.
    """
    photos = cut(usable_photos(accepted))
    sizes = cut(photos.groupBy("hash").agg(F.count("*").alias("n")))
    pairs = close_hashes(sizes.select("hash"), most_bits).union(sizes.where("n > 1").select("hash", "hash"))
    left, right = sizes.select(F.col("hash").alias("x"), F.col("n").alias("nx")), sizes.select(F.col("hash").alias("y"), F.col("n").alias("ny"))
    sized = cut(pairs.toDF("x", "y").join(left, "x").join(right, "y"))
    heavy = (F.col("nx") > block_rows) | (F.col("ny") > block_rows)
    side = lambda k, s: photos.select(F.col("hash").alias(k), F.col("photo_id").alias(f"id{s}"), F.col("hist").alias(f"hist{s}"))
    within = (F.col("x") != F.col("y")) | (F.col("id0") < F.col("id1"))
    light = sized.where(~heavy).select("x", "y").join(side("x", 0), "x").join(side("y", 1), "y").where(within & (_cosine(F.col("hist0"), F.col("hist1")) >= least_cosine - 1e-12)).select("id0", "id1")
    out = light
    big = sized.where(heavy)
    if not big.isEmpty():
        out = out.union(_heavy_pairs(big, photos, least_cosine, block_rows))
    return out.select(F.least("id0", "id1").alias("photo_a"), F.greatest("id0", "id1").alias("photo_b"))


def _heavy_pairs(big: DataFrame, photos: DataFrame, least_cosine: float, block_rows: int) -> DataFrame:
    """Pairs of photos of pairs of hashes that many photos have, block by block."""
    count = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    shaped = big.withColumns({"bx": count("nx"), "by": count("ny")})
    rows = photos.withColumnRenamed("hash", "h")

    def spread(key: str, own: str, other: str, first: bool) -> DataFrame:
        slot = F.pmod(F.xxhash64("photo_id"), F.col(own)).cast("int")
        joined = shaped.join(rows, F.col(key) == F.col("h")).withColumn("slot", slot).withColumn("o", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("slot", "o") if first else ("o", "slot")
        kept = (F.col("x") != F.col("y")) | (F.col(i) <= F.col(j))
        return joined.where(kept).select("x", "y", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(first).alias("first"), "photo_id", "hist")

    sent = spread("x", "bx", "by", True).unionByName(spread("y", "by", "bx", False))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        x, y, i, j = (k.as_py() for k in key)
        first = group.column("first").to_numpy()
        ids = group.column("photo_id").to_numpy()
        hist = group.column("hist").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        row, col = np.nonzero(hist[a] @ hist[b].T >= least_cosine - 1e-12)
        one, two = ids[a[row]], ids[b[col]]
        keep = one < two if x == y and i == j else one != two
        return pa.table({"id0": one[keep], "id1": two[keep]})

    return sent.groupBy("x", "y", "i", "j").applyInArrow(run, "id0 long, id1 long")
