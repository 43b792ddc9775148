"""The Gray-order index against all comparisons, and the photos it may use."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lumenfold.llm import near_duplicates as D

ROW = "photo_id long, perceptual_hash long, color_histogram array<double>, channel_order string, hash string"


def near_hashes(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n // 3, dtype=np.int64)
    out = [base]
    for _ in range(2):
        flips = np.zeros(len(base), np.int64)
        for _ in range(8):
            flips ^= np.left_shift(np.int64(1), rng.integers(0, 64, len(base)).astype(np.int64))
        few = rng.random(len(base)) < 0.6
        flips[few] &= rng.integers(-(2**63), 2**63 - 1, few.sum(), dtype=np.int64)
        out.append(base ^ flips)
    return np.unique(np.concatenate([*out, [0, -1, 1, -(2**63)]]))


@pytest.mark.parametrize("bits", [6, 3, 7, 0])
def test_index_finds_every_pair_once(spark, bits):
    h = near_hashes(1500, bits)
    got = [tuple(r) for r in D.close_hashes(spark.createDataFrame([(int(v),) for v in h], "hash long"), bits).collect()]
    u = h.view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= bits)
    want = {(int(min(h[i], h[j])), int(max(h[i], h[j]))) for i, j in zip(a, b) if i < j}
    assert len(got) == len(set(got)) and set(got) == want


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.integers(0, 64))
@settings(max_examples=50, deadline=None)
def test_node_search_is_exact(values, spread):
    prints = np.unique(np.array(values, dtype=np.uint64) >> np.uint64(8))  # one upper node
    node = D.GrayNode(prints)
    who, at = node.search(node.prints, np.zeros(len(prints), np.int64), 6, 1)
    got = set(zip(who.tolist(), at.tolist()))
    diff = np.bitwise_count(node.prints[:, None] ^ node.prints[None, :])
    block = np.bitwise_count((node.prints[:, None] ^ node.prints[None, :]) >> np.uint64(48))
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero((diff <= 6) & (block <= 1)))))


def test_gray_rank_orders_neighbours_by_one_bit():
    x = np.arange(256, dtype=np.uint64)
    order = x[np.argsort(D._gray_rank(x))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def hist(seed, scale=1.0):
    return (np.random.default_rng(seed).random(24) * scale).tolist()


def test_usable_photos_and_channel_orders(spark):
    h = hist(1)
    turned = h[16:] + h[8:16] + h[:8]
    rows = [
        (1, 5, h, None, "x"), (2, 7, turned, " BGR", "x"), (3, 5, [v * 1000 for v in h], "rgb", "x"), (4, None, h, "rgb", "x"), (5, 5, h[:23], "rgb", "x"), (6, 5, [0.0] * 24, "rgb", "x"), (7, 5, None, "rgb", "x"),
        (8, 5, h, "xyz", "x"), (9, 5, [float("nan"), *h[1:]], "rgb", "x"), (10, 5, [None, *h[1:]], "rgb", "x"), (11, 5, turned, "rgb", "x"), (1, 5, h, None, "x"), (None, 5, h, "rgb", "x"), (12, 5, [], "rgb", "x"),
    ]
    df = spark.createDataFrame(rows, ROW)
    assert {r["photo_id"] for r in D.usable_photos(df).collect()} == {1, 2, 3, 11}
    assert {tuple(r) for r in D.near_duplicate_pairs(df).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert D.near_duplicate_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_pairs_agree_with_brute_force_with_a_hot_hash(spark, block):
    rng = np.random.default_rng(4)
    codes = near_hashes(90, 3)
    base = [rng.random(24) for _ in range(6)]
    rows = []
    for i in range(150):
        code = 0 if i % 3 == 0 else int(codes[rng.integers(len(codes))])
        rows.append((i, code, (base[rng.integers(6)] + 0.05 * rng.random(24)).tolist(), "rgb", "x"))
    got = [tuple(r) for r in D.near_duplicate_pairs(spark.createDataFrame(rows, ROW), block_rows=block).collect()]
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = np.array([r[1] for r in rows], dtype=np.int64).view(np.uint64)
    ok = (np.bitwise_count(u[:, None] ^ u[None, :]) <= 6) & (x @ x.T >= 0.98)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if ok[i, j]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_more_bits_than_the_index_serves(spark):
    with pytest.raises(ValueError):
        D.close_hashes(spark.createDataFrame([(1,)], "hash long"), 8)
