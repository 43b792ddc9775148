"""Encoding against the public library, round trips, and mixtures against a direct simulation."""

import random

import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lumenfold.llm import mixing, tokens

RANKS = tokens.read_ranks(tokens.VOCABULARY)
PUBLIC = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=RANKS, special_tokens={})
NBSP, IDEO = chr(0xA0), chr(0x3000)
TEXTS = [None, "", "   ", "Hello world, it's me!", "a" * 5_000, "<|endoftext|> is text", f"no{NBSP}break{IDEO}space \r\n\t x", "naïve Straße 東京タワー 道は湿原を越える。" * 30, "12345 67 ½ ٣", "=" * 300 + " " * 50 + "x", "".join(random.Random(1).choice("abc deÜ語\n '") for _ in range(20_000)), "\x00\x01 zero", "🦊🦊 fox", "we've they'll I'M"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_ids_equal_those_of_the_public_library(spark):
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(frame(spark, TEXTS)).collect()}
    assert got == {i: PUBLIC.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_pieces_beyond_the_dictionary_and_the_fold_come_out_the_same(spark):
    small = tokens.TokenParams(most_words=3, fold_bytes=4)
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(frame(spark, TEXTS), small).collect()}
    assert got == {i: PUBLIC.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_decoding_gives_the_text_back(spark):
    got = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(frame(spark, TEXTS))).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_counts_and_repeated_rows_and_empty(spark):
    df = frame(spark, ["one two", "x"]).union(frame(spark, ["one two"]))
    assert sorted(r["n_tokens"] for r in tokens.encode(df, count_only=True).collect()) == [1, 2, 2]
    assert tokens.encode(df.limit(0)).count() == 0


@given(st.binary(min_size=1, max_size=120))
@settings(max_examples=200, deadline=None)
def test_heap_merges_equal_the_library(piece):
    assert tokens.merge_bytes(piece, RANKS) == PUBLIC._encode_single_piece(piece)


def test_the_fold_merges_every_distinct_piece(spark):
    words = sorted({w for t in TEXTS if t for w in __import__("regex").findall(tokens.PATTERN, t)} - {""})
    short = [w for w in words if len(w.encode()) <= 512]
    got = {r["word"]: list(r["ids"]) for r in tokens.fold_merges(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {w: PUBLIC._encode_single_piece(w.encode()) for w in short}


def test_java_and_python_cut_the_same_pieces(spark):
    import regex

    got = {r["word"]: r["n"] for r in tokens.distinct_pieces(frame(spark, TEXTS)).collect()}
    want: dict = {}
    for t in TEXTS:
        for w in regex.findall(tokens.PATTERN, t or ""):
            want[w] = want.get(w, 0) + 1
    assert got == want


def docs(spark, n=300):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.randint(1, 9)), rng.choice(["A ", "a", "b", "B", "c", None, "unlisted"]) if i % 3 else "a") for i in range(n)]
    return rows, spark.createDataFrame([*rows, (1000, None, "a"), (1001, "", "b")], "doc_id long, text string, source string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_are_reached_and_repeats_capped(spark):
    rows, df = docs(spark)
    goal = targets(spark, [("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 4), ("empty", 0.0, 2)])
    mixed = mixing.mixture(df, goal)
    shares = {r["source"]: r for r in mixing.reached_shares(mixed, goal).collect()}
    assert all(abs(shares[s]["actual_share"] - t) < 0.02 for s, t in (("a", 0.2), ("b", 0.5), ("c", 0.3)))
    assert shares["a"]["most_copies"] == 1 and shares["b"]["most_copies"] <= 3 and shares["empty"]["n_tokens"] == 0


def test_mixture_equals_a_simulated_queue(spark):
    _, df = docs(spark, 120)
    goal = targets(spark, [("a", 0.6, 2), ("b", 0.4, 2)])
    timed = mixing.virtual_times(df, goal, bucket_rows=7).collect()
    for source in ("a", "b"):
        mine = sorted((r for r in timed if r["source"] == source), key=lambda r: r["finish"])
        total = 0
        for r in mine:  # running sums across buckets are those of the whole order
            total += r["n_tokens"]
            assert r["source_tokens"] == total
        assert [r["copy"] for r in mine] == sorted(r["copy"] for r in mine)
    for budget in (50, 400, 10**6):
        got = {(r["doc_id"], r["copy"]) for r in mixing.mixture(df, goal, budget, bucket_rows=11).collect()}
        want, total = set(), 0
        for r in sorted(timed, key=lambda r: (r["finish"], r["doc_id"], r["copy"])):
            total += r["n_tokens"]
            if total <= budget:
                want.add((r["doc_id"], r["copy"]))
        assert got == want


def test_mixture_of_nothing(spark):
    _, df = docs(spark, 5)
    assert mixing.mixture(df.limit(0), targets(spark, [("a", 1.0, 1)])).count() == 0
    assert mixing.mixture(df, targets(spark, [("zzz", 1.0, 1), (None, 0.5, 1), ("a", None, 2)])).count() == 0
